"""Forecasting many series at once.

A table of series holds one row per series and period, so each series is as long as its
history. The simple methods are window and regression expressions; the full bake-off folds
every method over the array of each series and origin, all of them in parallel.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.calendar import period_index
from tallyloom.functions.numbers import round2, round_half_up
from tallyloom.operators.stats import anomalies, trend_line

SEASON = 12
WINDOWS = [2, 3, 4, 6, 12]


def period_plus(period: Column, steps: Column) -> Column:
    """The key `steps` periods later; twelve periods make a year in every calendar."""
    retail = period.startswith("FY")
    year = F.regexp_extract(period, "([0-9]{4})", 1).cast("int")
    months = year * 12 + period_index(period) - 1 + steps
    key = F.concat(F.lpad(F.floor(months / 12).cast("string"), 4, "0"), F.when(retail, "-P").otherwise("-"),
                   F.lpad((months % 12 + 1).cast("string"), 2, "0"))
    return F.when(retail, F.concat(F.lit("FY"), key)).otherwise(key)


def _placed(series: DataFrame, by: list[str]) -> DataFrame:
    """Each point with its index from 0, the series' length and its slot in the year."""
    whole = Window.partitionBy(*by)
    return series.select(*by, "period", F.col("value").cast("double").alias("value"),
                         (F.row_number().over(whole.orderBy("period")) - 1).alias("x"), F.count("*").over(whole).alias("n"),
                         (period_index(F.col("period")) - 1).alias("slot"))


def _ahead(last: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """One row per series and step, with the period it falls in. `last` has `period` and `n`."""
    steps = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.withColumn("period", period_plus(F.col("period"), F.col("step")))


def _last(placed: DataFrame, by: list[str]) -> DataFrame:
    return placed.groupBy(*by).agg(F.max_by("value", "x").alias("last"), F.max("period").alias("period"), F.max("n").alias("n"))


def naive(series: DataFrame, by: list[str], horizon: int = 3) -> DataFrame:
    """The last value, repeated."""
    ahead = _ahead(_last(_placed(series, by), by), by, horizon)
    return ahead.select(*by, "step", "period", round2(F.col("last")).alias("value"))


def seasonal_naive(series: DataFrame, by: list[str], horizon: int = 3) -> DataFrame:
    """The value of the same slot a year before; needs more than a year of history."""
    placed = _placed(series, by).where(F.col("n") > SEASON)
    # Only the last year is looked up.
    year = placed.where(F.col("x") >= F.col("n") - SEASON).select(*by, (F.col("x") - F.col("n") + SEASON).alias("i"), F.col("value").alias("v"))
    ahead = _ahead(_last(placed, by), by, horizon).withColumn("i", (F.col("step") - 1) % SEASON)
    return ahead.join(year, [*by, "i"]).select(*by, "step", "period", round2(F.col("v")).alias("value"))


def moving_average(series: DataFrame, by: list[str], horizon: int = 3) -> DataFrame:
    """The mean of the last w values; w is the window with the smallest one-step error."""
    placed = _placed(series, by).where("n >= 4")
    order = Window.partitionBy(*by).orderBy("x")
    fits = placed.select("*", *[F.avg("value").over(order.rowsBetween(-w, -1)).alias(f"f{w}") for w in WINDOWS])
    errors = fits.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("period").alias("period"),
        *[F.sum((F.col("value") - F.col(f"f{w}")) ** 2).alias(f"e{w}") for w in WINDOWS],
        *[F.avg(F.when(F.col("x") >= F.col("n") - w, F.col("value"))).alias(f"m{w}") for w in WINDOWS])
    choices = F.filter(F.array(*[
        F.struct(F.col(f"e{w}").alias("sse"), F.lit(w).alias("window"), F.col(f"m{w}").alias("mean")) for w in WINDOWS]),
        lambda c: c["window"] <= F.floor(F.col("n") / 2))
    best = errors.select(*by, "n", "period", F.array_min(choices).alias("b"))
    return _ahead(best, by, horizon).select(*by, "step", "period", F.col("b.window").alias("window"), round2(F.col("b.mean")).alias("value"))


def trend(series: DataFrame, by: list[str], horizon: int = 3) -> DataFrame:
    """The least-squares line, continued."""
    placed = _placed(series, by).where("n >= 2")
    ahead = _ahead(_last(placed, by), by, horizon).join(trend_line(placed.select(*by, "period", "value"), by).drop("n"), by)
    return ahead.select(*by, "step", "period", round2(
        F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))).alias("value"))


def seasonal_trend(series: DataFrame, by: list[str], horizon: int = 3, multiplicative: bool = False) -> DataFrame:
    """The line plus (or times) how each slot of the year usually lies against it.

    Needs two years, every slot covered and, for ratios, positive values and a positive line.
    """
    placed = _placed(series, by).where(F.col("n") >= 2 * SEASON)
    lined = placed.join(trend_line(placed.select(*by, "period", "value"), by).drop("n"), by).withColumn(
        "line", F.col("intercept") + F.col("slope") * F.col("x"))
    against = F.col("value") / F.when(F.col("line") > 0, F.col("line")) if multiplicative else F.col("value") - F.col("line")
    slots = lined.groupBy(*by, "slot").agg(
        F.avg(against).alias("s"), F.count_if((F.col("line") <= 0) | (F.col("value") <= 0)).alias("bad"))
    whole = Window.partitionBy(*by)  # twelve rows per series
    level = F.avg("s").over(whole)
    centred = slots.select(*by, "slot", (F.col("s") / level if multiplicative else F.col("s") - level).alias("s"),
                           F.count("slot").over(whole).alias("covered"), F.sum("bad").over(whole).alias("bad"))
    usable = F.col("covered") == SEASON
    if multiplicative:
        usable = usable & (F.col("bad") == 0)
    ahead = _ahead(lined.groupBy(*by).agg(
        F.max("period").alias("period"), F.max("n").alias("n"), F.max("slope").alias("slope"), F.max("intercept").alias("intercept")),
        by, horizon).withColumn("slot", period_index(F.col("period")) - 1)
    line = F.col("intercept") + F.col("slope") * (F.col("n") - 1 + F.col("step"))
    value = line * F.col("s") if multiplicative else line + F.col("s")
    return ahead.join(centred.where(usable), [*by, "slot"]).select(*by, "step", "period", round2(value).alias("value"))


def winsorise(series: DataFrame, by: list[str]) -> DataFrame:
    """Points outside their normal band moved to its edge."""
    judged = anomalies(series, by)
    clamped = F.least(F.col("upper"), F.greatest(F.col("lower"), F.col("value")))
    out = judged.select(*by, "period", F.when(F.col("is_anomaly"), clamped).otherwise(F.col("value")).alias("fitted_value"),
                        F.col("is_anomaly").alias("clamped"))
    return series.select(*by, "period", "value").join(out, [*by, "period"], "left").select(
        *by, "period", "value", F.coalesce("fitted_value", "value").alias("fitted_value"),
        F.coalesce("clamped", F.lit(False)).alias("clamped"))


def flat(series: DataFrame, by: list[str], horizon: int = 3) -> DataFrame:
    """What a series of a single point gets: the point, with 20 % to either side."""
    placed = _placed(series, by).where("n < 2")
    v = F.col("last")
    return _ahead(_last(placed, by), by, horizon).select(
        *by, "step", "period", v.alias("value"), (v * 0.8).alias("lower"), (v * 1.2).alias("upper"))


def goal_status(points: DataFrame, value: str, goal: str) -> DataFrame:
    """on_track at or above the goal, at_risk up to 10 % below it, missed beyond."""
    v, g = F.col(value), F.col(goal)
    gap_pct = F.when(g == 0, 0.0).otherwise(F.floor((g - v) / F.nullif(F.abs(g), F.lit(0.0)) * 1000 + 0.5) / 10)
    return points.select("*", round2(g - v).alias("gap"), gap_pct.alias("gap_pct")).withColumn(
        "status", F.when(v >= g, "on_track").when(F.col("gap_pct") <= 10, "at_risk").otherwise("missed"))


# --- the bake-off: every method at every origin, as folds over arrays ---------------------------------

GRID = [0.1, 0.3, 0.5, 0.7, 0.9]
DAMPING = [0.8, 0.85, 0.9, 0.95, 0.98]
TOLERANCE = 1.05
MAX_SCORED_HORIZON = 6
Z95 = 1.96

# Method, shortest history. Fewest fitted parameters first, which is the tie-break.
METHODS = [
    ("naive", 2), ("seasonal_naive", 13), ("moving_average", 4), ("simple_exponential_smoothing", 3),
    ("linear_regression", 2), ("holt", 4), ("damped_holt", 5), ("seasonal_additive", 24),
    ("seasonal_multiplicative", 24), ("holt_winters_additive", 24), ("holt_winters_multiplicative", 24),
]
POSITIVE_ONLY = {"seasonal_multiplicative", "holt_winters_multiplicative"}
SEASONAL = ("seasonal_additive", "seasonal_multiplicative", "holt_winters_additive", "holt_winters_multiplicative")

# The texts below are Spark SQL over one row per series and origin: `_y` the values a method is
# fitted to, `_r` the raw ones, `_cut` their number, `_m` their slots in the year, `_h` the steps
# ahead and `_hm` the slots of those. A fit is its raw squared error, its parameters and its steps.
_FIT = "named_struct('q', {q}, 'params', {params}, 'ahead', transform(_h, h -> {ahead}))"


def _plain(fitted: str, ahead: str) -> str:
    """A method without parameters: its value at `t` and at `h` steps ahead."""
    error = f"aggregate(sequence(0, _cut - 1), 0D, (e, t) -> e + pow(_r[t] - ({fitted}), 2))"
    return _FIT.format(q=error, params="cast(null as string)", ahead=ahead)


_FINITE = "coalesce(nullif({}, double('NaN')), double('infinity'))"
_STATE = "array<struct<cut:int,e:double,q:double,l:double,b:double,z:array<double>>>"
_GRIDS = {
    "moving_average": {"window": WINDOWS}, "simple_exponential_smoothing": {"alpha": GRID}, "holt": {"alpha": GRID, "beta": GRID},
    "damped_holt": {"alpha": GRID, "beta": GRID, "phi": DAMPING}, "holt_winters_additive": {"alpha": GRID, "beta": GRID, "gamma": GRID},
    "holt_winters_multiplicative": {"alpha": GRID, "beta": GRID, "gamma": GRID},
}


def _points(methods: list[str] | None) -> str:
    """Every point of the grids of the methods asked for, as an array of structs; a grid's last axis runs fastest."""
    usual = {"window": 0, "alpha": 0.0, "beta": 0.0, "gamma": 0.0, "phi": 1.0}
    rows = []
    for m, (method, least) in enumerate(METHODS):
        if method in _GRIDS and (methods is None or method in methods):
            for i, values in enumerate(product(*_GRIDS[method].values())):
                named = dict(zip(_GRIDS[method], values))
                text = ", ".join(f"{k}={v:g}" for k, v in named.items())
                fields = ", ".join(f"'{k}', {v}" + ("" if k == "window" else "D") for k, v in (usual | named).items())
                rows.append(f"named_struct('m', {m}, 'i', {i}, 'least', {least}, 'params', '{text}', {fields})")
    return f"array({', '.join(rows)})"


def _shared(start: str, first: int, step: str) -> str:
    """One fold over a whole history that keeps its state wherever a history is cut.

    `start` and `step` give the fields l, b, z, e (error of the fitted values), q (of the raw ones).
    """
    kept = "named_struct('cut', {}, 'e', s.e, 'q', s.q, 'l', s.l, 'b', s.b, 'z', s.z)"
    return f"""aggregate(sequence({first}, _n - 1), named_struct({start}, 'a', cast(array() as {_STATE})),
      (s, t) -> named_struct({step}, 'a', if(array_contains(_cuts, t), concat(s.a, array({kept.format('t')})), s.a)),
      s -> concat(s.a, array({kept.format('_n')})))"""


def _smoothing() -> str:
    """Exponential smoothing: level, and with a trend a slope that may die away."""
    expected = "(s.l + _g.phi * s.b)"
    after = f"(_g.alpha * _fit[t] + (1 - _g.alpha) * {expected})"
    simple = [m for m, _ in METHODS].index("simple_exponential_smoothing")
    return _shared(f"'l', _fit[0], 'b', if(_g.m = {simple}, 0D, _fit[1] - _fit[0]), 'z', cast(null as array<double>), 'e', 0D, 'q', pow(_raw[0] - _fit[0], 2)", 1,
                   f"'l', {after}, 'b', _g.beta * ({after} - s.l) + (1 - _g.beta) * _g.phi * s.b, 'z', s.z, 'e', s.e + pow(_fit[t] - {expected}, 2), 'q', s.q + pow(_raw[t] - {expected}, 2)")


def _winters(multiplicative: bool) -> str:
    """Holt-Winters with one season value for each slot of the year."""
    def put(season, slot, value):
        return f"concat(slice({season}, 1, {slot}), array({value}), slice({season}, {slot} + 2, {SEASON}))"

    begin = "try_divide(_fit[t], _base)" if multiplicative else "_fit[t] - _base"
    seasons = f"aggregate(sequence(0, {SEASON - 1}), array_repeat({'1D' if multiplicative else '0D'}, {SEASON}), (z, t) -> {put('z', '_slots[t]', begin)})"
    along, usual = "(s.l + s.b)", "s.z[_slots[t]]"
    fitted = f"({along} * {usual})" if multiplicative else f"({along} + {usual})"
    bare = f"try_divide(_fit[t], {usual})" if multiplicative else f"(_fit[t] - {usual})"
    after = f"(_g.alpha * {bare} + (1 - _g.alpha) * {along})"
    left = f"try_divide(_fit[t], {after})" if multiplicative else f"(_fit[t] - {after})"
    return _shared(f"'l', _base, 'b', _rise, 'z', {seasons}, 'e', 0D, 'q', 0D", 0,
                   f"""'l', {after}, 'b', _g.beta * ({after} - s.l) + (1 - _g.beta) * s.b, 'z', {put('s.z', '_slots[t]', f'_g.gamma * {left} + (1 - _g.gamma) * {usual}')},
        'e', s.e + if(t = 0, 0D, pow(_fit[t] - {fitted}, 2)), 'q', s.q + pow(_raw[t] - {fitted}, 2)""")


def _mean_of(start: str, size: str) -> str:
    return f"aggregate(slice(_fit, {start} + 1, {size}), 0D, (u, v) -> u + v) / {size}"


def _window_mean() -> str:
    """The mean of the last values; a state needs none of them, only the errors so far."""
    before = _mean_of("greatest(t - _g.window, 0)", "least(_g.window, t)")
    return _shared("'l', 0D, 'b', 0D, 'z', cast(null as array<double>), 'e', 0D, 'q', pow(_raw[0] - _fit[0], 2)", 1,
                   f"'l', 0D, 'b', 0D, 'z', s.z, 'e', s.e + pow(_fit[t] - {before}, 2), 'q', s.q + pow(_raw[t] - {before}, 2)")


def _grid_fits(histories: DataFrame, by: list[str], horizon: int, methods: list[str] | None) -> DataFrame:
    """One row per series and cut with `_f`: the best point of each grid, by its one-step error up to the cut.

    Every point is folded once over the whole history; what it is like at a cut is the state kept
    there, so more origins cost no more folds. The first point of equals wins.
    """
    at = {m: i for i, (m, _) in enumerate(METHODS)}
    usable = "filter({}, g -> g.least <= _n and (g.m != {} or _positive) and (g.m not in ({}, {}) or _seasonal))".format(
        _points(methods), at["holt_winters_multiplicative"], at["holt_winters_additive"], at["holt_winters_multiplicative"])
    fold = (f"case when _g.m = {at['moving_average']} then {_window_mean()} when _g.m = {at['holt_winters_additive']} then {_winters(False)} "
            f"when _g.m = {at['holt_winters_multiplicative']} then if(_base > 0, {_winters(True)}, cast(array() as {_STATE})) else {_smoothing()} end")
    year = lambda k: f"aggregate(slice(_fit, {k * SEASON + 1}, {SEASON}), 0D, (u, v) -> u + v)"
    points = histories.selectExpr(*[f"`{c}`" for c in histories.columns], "transform(_origin, o -> o.cut) as _cuts", f"{year(0)} / {SEASON} as _base",
                                  f"({year(1)} - {year(0)}) / {SEASON} / {SEASON} as _rise", f"explode({usable}) as _g")
    states = points.selectExpr(*[f"`{c}`" for c in by], "_n", "_held", "_fit", "_slots", "_origin", "_g", f"explode({fold}) as _st").where(
        f"_st.cut >= _g.least and (_g.m != {at['moving_average']} or _g.window <= _st.cut div 2)")
    # a state without a slope or level is no fit
    error = f"if(_st.l + _st.b is null, double('infinity'), {_FINITE.format('_st.e')})"
    best = states.where(f"{error} < double('infinity')").groupBy(*by, F.col("_st.cut").alias("_cut"), F.col("_g.m").alias("_m")).agg(
        F.min(F.expr(f"struct({error} as e, _g.i as i, _st.q as q, _g.params as params, _st.l as l, _st.b as b, _st.z as z, _g.phi as phi, _g.window as window)")).alias("_b"),
        *[F.first(c).alias(c) for c in ("_n", "_held", "_fit", "_slots", "_origin")])
    each = best.selectExpr("*", "explode(filter(_origin, o -> o.cut = _cut)) as _o").selectExpr(
        "*", "_o.k as _k", f"if(_o.k = 0, sequence(1, {horizon}), sequence(1, _held)) as _h",
        f"if(_o.k = 0, transform(sequence(1, {horizon}), h -> (_slots[_n - 1] + h) % {SEASON}), slice(_slots, _cut + 1, _held)) as _hm")
    ahead = (f"case when _m = {at['moving_average']} then {_mean_of('(_cut - _b.window)', '_b.window')} when _m = {at['holt_winters_additive']} then _b.l + _b.b * h + _b.z[_hm[h - 1]] "
             f"when _m = {at['holt_winters_multiplicative']} then (_b.l + _b.b * h) * _b.z[_hm[h - 1]] else _b.l + _b.b * aggregate(sequence(1, h), 0D, (p, j) -> p + pow(_b.phi, j)) end")
    fit = F.expr(f"named_struct('m', _m, 'fit', {_FIT.format(q='_b.q', params='_b.params', ahead=ahead)})")
    return each.select(*by, "_k", "_cut", fit.alias("_x")).groupBy(*by, "_k", "_cut").agg(F.collect_list("_x").alias("_f"))


def _by_slot(multiplicative: bool) -> str:
    sign, usual = ("*", "_times") if multiplicative else ("+", "_plus")
    fit = _plain(f"(_start + _slope * t) {sign} {usual}[_m[t]]", f"(_start + _slope * (_cut - 1 + h)) {sign} {usual}[_hm[h - 1]]")
    return f"if({usual} is null, null, {fit})"


def _method_sql(method: str) -> str:
    return {
        "naive": lambda: _plain("if(t = 0, _y[0], _y[t - 1])", "_y[_cut - 1]"),
        "seasonal_naive": lambda: _plain(f"if(t >= {SEASON}, _y[t - {SEASON}], _y[t])", f"_y[greatest(0, _cut - {SEASON} + (h - 1) % {SEASON})]"),
        "linear_regression": lambda: _plain("_start + _slope * t", "_start + _slope * (_cut - 1 + h)"),
        "seasonal_additive": lambda: _by_slot(False),
        "seasonal_multiplicative": lambda: _by_slot(True),
    }[method]()


def _usual(against: str) -> str:
    """The mean of `against` for each slot, or null unless every slot occurs."""
    each = f"""transform(sequence(0, {SEASON - 1}), m -> aggregate(sequence(0, _cut - 1), named_struct('s', 0D, 'k', 0),
      (u, t) -> if(_m[t] = m, named_struct('s', u.s + {against}, 'k', u.k + 1), u), u -> try_divide(u.s, u.k)))"""
    return f"get(filter(array({each}), z -> not exists(z, v -> v is null)), 0)"


def _histories(series: DataFrame, by: list[str], horizon: int, origins: bool) -> DataFrame:
    """One row per series of at least two points: its values raw and clamped, and where it is cut.

    `_origin` has the whole history as k = 0 and, with `origins`, the rolling origins from k = 1.
    """
    points = winsorise(series.select(*by, "period", F.col("value").cast("double").alias("value")), by)
    point = F.struct("period", "value", "fitted_value", (period_index(F.col("period")) - 1).cast("int").alias("slot"))
    rows = points.groupBy(*by).agg(F.sort_array(F.collect_list(point)).alias("_p")).where(F.size("_p") >= 2)
    return rows.select(
        *by, F.size("_p").alias("_n"), F.col("_p.value").alias("_raw"), F.col("_p.fitted_value").alias("_fit"), F.col("_p.slot").alias("_slots"),
        F.element_at("_p.period", -1).alias("last_period")).select(
        "*", F.expr("not exists(_slots, s -> s is null)").alias("_seasonal"), F.expr("forall(_raw, v -> v > 0)").alias("_positive"),
        F.greatest(F.lit(1), F.least(F.lit(min(horizon, MAX_SCORED_HORIZON)), F.col("_n") - 2)).alias("_held"),
        F.when(F.col("_n") < 12, 1).when(F.col("_n") < 24, 3).when(F.col("_n") < 48, 5).otherwise(8).alias("_origins")).select("*", F.expr(
            "filter(transform(" + ("sequence(0, _origins)" if origins else "array(0)") + ", k -> named_struct('k', k, 'cut', if(k = 0, _n, _n - _held - k + 1))), o -> o.cut >= 2)").alias("_origin"))


def method_fits(series: DataFrame, by: list[str], horizon: int = 3, methods: list[str] | None = None, origins: bool = False) -> DataFrame:
    """One row per series with `_fits`: for each method its fit to the whole history and, with
    `origins`, to the history up to each rolling origin.

    Grids are tried inside the row of a series and origin, so nothing is moved for them and a
    method that is not asked for costs nothing.
    """
    histories = _histories(series, by, horizon, origins)
    # Few bytes but much to compute: series are dealt over all tasks, whatever their size, and stay there.
    tasks = 4 * int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    histories = histories.repartition(tasks, *by)
    rows = histories.selectExpr("*", "inline(_origin)").withColumnsRenamed({"k": "_k", "cut": "_cut"}).selectExpr(
        "*", "slice(_fit, 1, _cut) as _y", "slice(_raw, 1, _cut) as _r", "slice(_slots, 1, _cut) as _m",
        f"if(_k = 0, sequence(1, {horizon}), sequence(1, _held)) as _h",
        f"if(_k = 0, transform(sequence(1, {horizon}), h -> (_slots[_n - 1] + h) % {SEASON}), slice(_slots, _cut + 1, _held)) as _hm").selectExpr(
        "*", "(_cut - 1) / 2D as _middle", "aggregate(_y, 0D, (u, v) -> u + v) / _cut as _mean",
        f"if(_k = 0, 0D, if(_cut > {SEASON}, aggregate(sequence({SEASON}, _cut - 1), 0D, (u, t) -> u + abs(_r[t] - _r[t - {SEASON}])) / (_cut - {SEASON}), "
        "aggregate(sequence(1, _cut - 1), 0D, (u, t) -> u + abs(_r[t] - _r[t - 1])) / (_cut - 1))) as _scale").selectExpr(
        "*", "aggregate(sequence(0, _cut - 1), 0D, (u, t) -> u + (t - _middle) * (_y[t] - _mean)) "
        "/ aggregate(sequence(0, _cut - 1), 0D, (u, t) -> u + (t - _middle) * (t - _middle)) as _slope").selectExpr(
        "*", "_mean - _slope * _middle as _start")
    wanted = [(i, m, least) for i, (m, least) in enumerate(METHODS) if m not in _GRIDS and (methods is None or m in methods)]
    if any(m.startswith("seasonal_") and m in SEASONAL for _, m, _ in wanted):
        year = f"_seasonal and _cut >= {2 * SEASON}"
        rows = rows.selectExpr(
            "*", f"if({year}, {_usual('_y[t] - (_start + _slope * t)')}, null) as _by_plus",
            f"if({year} and _start > 0 and _start + _slope * (_cut - 1) > 0, {_usual('_y[t] / (_start + _slope * t)')}, null) as _by_times").selectExpr(
            "*", f"transform(_by_plus, v -> v - aggregate(_by_plus, 0D, (u, w) -> u + w) / {SEASON}) as _plus",
            f"transform(_by_times, v -> try_divide(v, aggregate(_by_times, 0D, (u, w) -> u + w) / {SEASON})) as _times")
    each = []
    for i, m, least in wanted:
        may = f"_cut >= {least}" + (" and _positive" if m in POSITIVE_ONLY else "") + (" and _seasonal" if m in SEASONAL else "")
        each.append(f"named_struct('m', {i}, 'fit', if({may}, {_method_sql(m)}, null))")
    none = "array(named_struct('m', -1, 'fit', " + _FIT.format(q="0D", params="cast(null as string)", ahead="0D") + "))"
    plain = f"array({', '.join(each)})" if each else none
    kept = [c for c in histories.columns if c not in by]
    fitted = rows.selectExpr(*[f"`{c}`" for c in histories.columns], "_k", "_cut", "_scale", f"filter({plain}, f -> f.fit is not null and f.m >= 0) as _f")
    if methods is None or any(m in _GRIDS for m in methods):
        fitted = fitted.unionByName(_grid_fits(histories, by, horizon, methods), allowMissingColumns=True)
    # two entries for each origin: the plain methods, which carry the history, and the tuned ones
    same = [F.first(c, ignorenulls=True).alias(c) for c in kept]
    scale = F.max("_scale").over(Window.partitionBy(*by, "_k"))
    fitted = fitted.withColumn("_scale", scale)
    return fitted.groupBy(*by).agg(*same, F.sort_array(F.collect_list(F.struct("_k", "_cut", "_scale", "_f"))).alias("_fits"))


_HALF_UP = "floor(({}) * {f} + 0.5) / {f}"
# means of amounts often end on a half: eight places first, so that the order of a sum decides nothing
_HALF_UP_OF_MEAN = "floor(coalesce(cast(try_cast({0} as decimal(38,8)) as double), {0}) * {f} + 0.5) / {f}"
_MEAN = "try_divide(aggregate({0}, 0D, (u, v) -> u + v.{1}), size({0}))"


def _board(fits: DataFrame, by: list[str]) -> DataFrame:
    """One row per series and method: its errors at the rolling origins and whether it wins."""
    listed = ", ".join(f"named_struct('m', {i}, 'method', '{m}', 'least', {least}, 'positive_only', {str(m in POSITIVE_ONLY).lower()})"
                       for i, (m, least) in enumerate(METHODS))
    mine = "filter(transform(_fits, x -> named_struct('k', x._k, 'cut', x._cut, 'scale', x._scale, 'fit', get(filter(x._f, f -> f.m = _x.m), 0).fit)), z -> z.fit is not null)"
    rows = fits.selectExpr("*", f"explode(array({listed})) as _x").selectExpr("*", f"{mine} as _mine").selectExpr(
        "*", "get(filter(_mine, z -> z.k = 0), 0).fit as _full").selectExpr(
        "*", "if(_full is null, null, transform(filter(_mine, z -> z.k > 0), z -> named_struct('scale', z.scale, 'actual', slice(_raw, z.cut + 1, _held), "
        "'off', zip_with(slice(_raw, z.cut + 1, _held), z.fit.ahead, (a, p) -> a - p)))) as _errors").selectExpr(
        "*", "filter(flatten(transform(_errors, z -> zip_with(z.off, z.actual, (o, a) -> named_struct('off', abs(o), 'scaled', if(z.scale > 0, abs(o) / z.scale, 0D), "
        "'share', if(a = 0, null, abs(o) / abs(a)))))), v -> v.off < double('infinity')) as _each").selectExpr(
        "*", "coalesce(size(_errors), 0) as origins").selectExpr(
        "*", f"if(origins > 0 and forall(_errors, z -> z.scale > 0), {_HALF_UP_OF_MEAN.format(_MEAN.format('_each', 'scaled'), f='10000')}, null) as mase",
        f"if(origins > 0 and not exists(_each, v -> v.share is null), {_HALF_UP_OF_MEAN.format(_MEAN.format('_each', 'share') + ' * 100', f='10000')}, null) as mape",
        f"if(origins > 0, {_HALF_UP_OF_MEAN.format(_MEAN.format('_each', 'off'), f='10000')}, null) as mae",
        """case when _n < _x.least then concat('needs ', _x.least, ' periods of history, has ', _n) when _x.positive_only and not _positive then 'needs every period above zero'
          when _full is null then 'could not be fitted to this history' when origins = 0 then concat('needs ', _held + _x.least, ' periods to hold any out, has ', _n) end as reason""")
    whole = Window.partitionBy(*by)  # one row per method
    scored = rows.select("*", F.max(F.col("mase").isNotNull()).over(whole).alias("_any")).select(
        "*", F.when(F.col("_any"), F.col("mase")).otherwise(F.col("mae")).alias("_score"))
    near = F.min("_score").over(whole) * TOLERANCE
    judged = scored.select("*", F.coalesce(F.col("_score") <= near, F.lit(False)).alias("_near"))
    first = F.coalesce(F.min(F.when(F.col("_near"), F.col("_x.m"))).over(whole), F.min(F.when(F.col("_full").isNotNull(), F.col("_x.m"))).over(whole))
    return judged.select("*", F.coalesce(F.col("_x.m") == first, F.lit(False)).alias("winner"), F.col("_x.method").alias("method"),
                         F.col("_full").isNotNull().alias("eligible"), F.col("_full.params").alias("params"))


def _projected(board: DataFrame, by: list[str], horizon: int) -> DataFrame:
    """The winner's periods ahead with their bands.

    Eight origins give bands by rank, three a mean and a deviation, fewer the spread of the fit.
    """
    spread = "sqrt(_full.q / _n)"
    rows = board.where("winner").selectExpr(
        "*", f"{spread} as _sd", f"{spread} / sqrt(aggregate(sequence(0, _n - 1), 0D, (u, t) -> u + pow(t - (_n - 1) / 2D, 2))) as _fan",
        "if(origins >= 8, 'empirical', if(origins >= 3, 'normal', 'residual')) as basis", f"explode(sequence(1, {horizon})) as step").selectExpr(
        "*", "transform(_errors, z -> z.off[least(step, _held) - 1]) as _o", "if(step > _held, sqrt(step / _held), 1D) as _stretch",
        "_full.ahead[step - 1] as _p").selectExpr(
        "*", "array_sort(_o) as _s", "try_divide(aggregate(_o, 0D, (u, v) -> u + v), size(_o)) as _mu",
        "greatest(0D, if(_p is null or isnan(_p) or abs(_p) = double('infinity'), _raw[_n - 1], _p)) as _v").selectExpr(
        "*", "sqrt(try_divide(aggregate(_o, 0D, (u, v) -> u + pow(v - _mu, 2)), size(_o))) as _dev")

    def rank(p):
        at = f"{p} * (size(_s) - 1)"
        return f"(_s[int(floor({at}))] + (_s[int(ceil({at}))] - _s[int(floor({at}))]) * ({at} - floor({at})))"

    by_fit = f"{Z95}D * _sd * sqrt(1 + step / _n)"
    low = f"case basis when 'residual' then -({by_fit}) when 'empirical' then {rank('0.025D')} * _stretch else (_mu - {Z95}D * _dev) * _stretch end"
    high = f"case basis when 'residual' then {by_fit} when 'empirical' then {rank('0.975D')} * _stretch else (_mu + {Z95}D * _dev) * _stretch end"
    return rows.selectExpr("*", f"{low} as _low", f"{high} as _high").selectExpr(
        *[f"`{c}`" for c in by], "last_period", "step", *[f"{_HALF_UP.format(e, f='100')} as {name}" for e, name in (
            ("_v", "value"), ("greatest(0D, least(_v, _v + _low))", "lower"), ("greatest(_v, _v + _high)", "upper"),
            ("_v + _fan * step", "best"), ("greatest(0D, _v - _fan * step)", "worst"))], "method", "basis")


def bake_off(series: DataFrame, by: list[str], horizon: int = 3) -> DataFrame:
    """Every method against every series: `kind` is 'score' for a method's held-out errors and
    'point' for a projected period of the winner.

    `series` is already one row per period, so an array is one short history, whatever the
    size of the fact table behind it. A series of one point is projected flat.
    """
    board = _board(method_fits(series, by, horizon, origins=True), by)
    scores = board.select(*by, "last_period", F.lit("score").alias("kind"), "method", "mase", "mape", "mae", "origins", "eligible", "reason", "winner", "params")
    points = _projected(board, by, horizon).withColumn("kind", F.lit("point"))
    single = series.select(*by, "period", F.col("value").cast("double").alias("value"), F.count("*").over(Window.partitionBy(*by)).alias("_n")).where(
        "_n = 1").select(*by, F.col("period").alias("last_period"), F.lit("point").alias("kind"), F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"),
                         "value", (F.col("value") * 0.8).alias("lower"), (F.col("value") * 1.2).alias("upper"), F.col("value").alias("best"),
                         F.col("value").alias("worst"), F.lit("flat").alias("method"), F.lit("residual").alias("basis"))
    return scores.unionByName(points, allowMissingColumns=True).unionByName(single, allowMissingColumns=True)


def method_forecasts(series: DataFrame, by: list[str], horizon: int, methods: list[str]) -> DataFrame:
    """What each of the named methods projects from the whole history, with its parameters."""
    fits = method_fits(series, by, horizon, methods)
    names = F.array(*[F.lit(m) for m, _ in METHODS])
    each = fits.select(*by, "last_period", F.explode(F.flatten("_fits._f")).alias("_x")).select(
        *by, "last_period", names[F.col("_x.m")].alias("method"), F.col("_x.fit.params").alias("params"), F.posexplode("_x.fit.ahead").alias("_i", "value"))
    return each.select(*by, "method", "params", (F.col("_i") + 1).alias("step"), period_plus(F.col("last_period"), F.col("_i") + 1).alias("period"),
                       round2(F.col("value")).alias("value"))


def forecast_points(results: DataFrame, by: list[str]) -> DataFrame:
    return results.where("kind = 'point'").select(
        *by, period_plus(F.col("last_period"), F.col("step")).alias("period"), "step", "method", "basis",
        "value", "lower", "upper", "best", "worst")


def scoreboard(results: DataFrame, by: list[str]) -> DataFrame:
    return results.where("kind = 'score'").select(
        *by, "method", "mase", "mape", "mae", "origins", "eligible", "reason", "winner", "params")


def what_if(series: DataFrame, by: list[str], delta: float, horizon: int = 3) -> DataFrame:
    """The forecast as it is and with the last point of each series moved by `delta`."""
    latest = F.max("period").over(Window.partitionBy(*by))
    moved = series.select("*", latest.alias("_last")).select(
        *by, "period", (F.col("value") + F.when(F.col("_last") == F.col("period"), delta).otherwise(0.0)).alias("value"))
    both = series.select(F.lit("base").alias("case"), *by, "period", "value").unionByName(
        moved.select(F.lit("scenario").alias("case"), *by, "period", "value"))
    return forecast_points(bake_off(both, ["case", *by], horizon), ["case", *by])


# --- how forecasts turned out ------------------------------------------------------------------------


def score_points(points: DataFrame, actuals: DataFrame, by: list[str]) -> DataFrame:
    """Saved points against what happened, for periods with a later one in the same series."""
    last = actuals.groupBy(*by).agg(F.max("period").alias("_last"))
    known = actuals.select(*by, "period", F.col("value").alias("actual"))
    off = F.abs(F.col("actual") - F.col("value"))
    return points.join(known, [*by, "period"]).join(last, by).where("period < _last").select(
        *[c for c in points.columns if c not in ("value", "lower", "upper")],
        round2(F.col("value")).alias("predicted"), round2(F.col("lower")).alias("lower"), round2(F.col("upper")).alias("upper"),
        round2(F.col("actual")).alias("actual"), round2(off).alias("abs_error"),
        F.when(F.col("actual") != 0, round2(off / F.abs("actual") * 100)).alias("pct_error"),
        F.col("actual").between(F.col("lower"), F.col("upper")).alias("within_band"))


def accuracy(scores: DataFrame, by: list[str] = ()) -> DataFrame:
    """How good the scored predictions were; stale ones are counted apart."""
    fresh = ~F.coalesce(F.col("stale"), F.lit(False)) if "stale" in scores.columns else F.lit(True)

    def mean(c):
        return F.avg(F.when(fresh, F.col(c)))

    mape, n = mean("pct_error"), F.count_if(fresh)
    return scores.groupBy(*by).agg(
        n.alias("predictions"), F.count_if(~fresh).alias("stale"),
        round2(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - mape))).alias("accuracy_pct"), round2(mape).alias("mape"),
        F.coalesce(round2(mean("abs_error")), F.lit(0.0)).alias("mae"),
        F.when(n > 0, round2(F.count_if(fresh & F.col("within_band")) / F.nullif(n, F.lit(0)) * 100)).alias("within_band_pct"))


def upsert_scores(existing: DataFrame, incoming: DataFrame, key: list[str], version: str) -> DataFrame:
    """One score per key: the one with the latest version."""
    rows = existing.unionByName(incoming)
    latest = rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), version).alias("_r"))
    return latest.select(*key, "_r.*")
