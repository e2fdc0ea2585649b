"""Forecasts of many series and how they turned out."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tallyloom.functions.numbers import round2, round_half_up
from tallyloom.operators import forecast as FC, insights as IN, metrics as MT
from tallyloom.plans import oracle as O
from tallyloom.plans.analysis import MONTHLY_SQL, _MAD_SQL, monthly
from tallyloom.plans.bake_off_sql import bake_off_sql
from tallyloom.plans.registry import query
from tallyloom.plans.views import SALES_SCHEMA as S, SALES_SQL, sales

BY = ["series"]
_SERIES_SQL = f"""{SALES_SQL}, s as (select region || ' / ' || category as series, strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 1, 2),
x as (select *, row_number() over (partition by series order by period) - 1 as x, count(*) over (partition by series) as n, cast(right(period, 2) as integer) - 1 as slot from s),
l as (select series, max_by(value, x) as last, max(period) as lp, max(n) as n from x group by 1),
a as (select *, unnest([1, 2, 3]) as step from l),
ahead as (select *, strftime(cast(lp || '-01' as date) + to_months(step), '%Y-%m') as period from a),
ln as (select series, regr_slope(value, x) as b, regr_intercept(value, x) as i from x group by 1)"""


def many_series(spark, sf):
    df = sales(spark, sf, "date", "region", "category", "revenue")
    named = df.withColumn("series", F.concat_ws(" / ", "region", "category"))
    return MT.time_series(named, S, by=["series"])


@query("m1_naive", f"with {_SERIES_SQL} select series, step, period, {O.r2('last')} as value from ahead")
def _(spark, sf):
    return FC.naive(many_series(spark, sf), BY)


@query("m2_seasonal_naive", f"""with {_SERIES_SQL} select h.series, step, h.period, {O.r2('x.value')} as value from ahead h
join x on x.series = h.series and x.x = h.n - 12 + (step - 1) % 12 where h.n > 12""")
def _(spark, sf):
    return FC.seasonal_naive(many_series(spark, sf), BY)


_MA = " union all ".join(f"""select series, {w} as w, sum((value - f) ** 2) as sse, avg(value) filter (x >= n - {w}) as m from (
  select *, avg(value) over (partition by series order by x rows between {w} preceding and 1 preceding) as f from x) where {w} <= floor(n / 2) group by 1""" for w in FC.WINDOWS)


@query("m3_moving_average", f"""with {_SERIES_SQL}, c as ({_MA}), best as (select series, min_by(w, sse) as w, min_by(m, sse) as m from c group by 1)
select ahead.series, step, period, w as "window", {O.r2('m')} as value from ahead join best on ahead.series = best.series""")
def _(spark, sf):
    return FC.moving_average(many_series(spark, sf), BY)


@query("m5_trend_line", f"""with {_SERIES_SQL} select h.series, step, period, {O.r2('i + b * (n - 1 + step)')} as value from ahead h join ln on h.series = ln.series""")
def _(spark, sf):
    return FC.trend(many_series(spark, sf), BY)


def _seasonal_sql(against, centre, value):
    return f"""with {_SERIES_SQL}, r as (select x.series, slot, avg({against}) as s from x join ln on x.series = ln.series where n >= 24 group by 1, 2),
c as (select series, slot, {centre} as s from r)
select h.series, step, h.period, {O.r2(value)} as value from ahead h join ln on h.series = ln.series join c on c.series = h.series and c.slot = cast(right(h.period, 2) as integer) - 1"""


@query("m8_seasonal_additive", _seasonal_sql("value - (i + b * x)", "s - avg(s) over (partition by series)", "i + b * (n - 1 + step) + s"))
def _(spark, sf):
    return FC.seasonal_trend(many_series(spark, sf), BY)


@query("m9_seasonal_multiplicative", _seasonal_sql("value / (i + b * x)", "s / avg(s) over (partition by series)", "(i + b * (n - 1 + step)) * s"))
def _(spark, sf):
    return FC.seasonal_trend(many_series(spark, sf), BY, multiplicative=True)


_CLAMPED_SQL = f"""with recursive {MONTHLY_SQL}, {_MAD_SQL.format(k='region')},
c as (select region, period, cast(case when abs(z) >= 3.5 then least({O.r2('med + 3.5 * sc')}, greatest({O.r2('med - 3.5 * sc')}, value)) else value end as double) as y, cast(right(period, 2) as integer) - 1 as slot,
  row_number() over (partition by region order by period) - 1 as t, count(*) over (partition by region) as n, max(period) over (partition by region) as lp from m4)"""
_BEST_SQL = """w as (select st.*, grid.params, n, lp, row_number() over (partition by st.region order by e, st.i) as r from st join grid on st.i = grid.i join (select distinct region, n, lp from c) z on st.region = z.region where t = n - 1)
select region, params, step, strftime(cast(lp || '-01' as date) + to_months(step), '%Y-%m') as period, {value} as value from (select *, unnest([1, 2, 3]) as step from w where r = 1)"""


def _grid_sql(**axes):
    rows = []
    for i, values in enumerate(product(*axes.values())):
        text = ", ".join(f"{k}={v:g}" for k, v in zip(axes, values))
        rows.append(f"({i}, '{text}', {', '.join(f'{v}::double' for v in values)})")
    return f"grid(i, params, {', '.join(axes)}) as (values {', '.join(rows)})"


def _smoothing_sql(least, **axes):
    beta, phi = ("beta" if "beta" in axes else "0"), ("phi" if "phi" in axes else "1")
    expected = f"(l + {phi} * b)"
    after = f"(alpha * y + (1 - alpha) * {expected})"
    return f"""{_CLAMPED_SQL}, {_grid_sql(**axes)},
st as (select c.region, grid.i, c.t, c.y as l, {'d.y - c.y' if 'beta' in axes else '0.0::double'} as b, 0.0::double as e, {phi}::double as f from c join c d on c.region = d.region and c.t = 0 and d.t = 1, grid where c.n >= {least}
  union all select st.region, st.i, c.t, {after}, {beta} * ({after} - l) + (1 - {beta}) * {phi} * b, e + (y - {expected}) * (y - {expected}), f
  from st join c on c.region = st.region and c.t = st.t + 1 join grid on grid.i = st.i),
""" + _BEST_SQL.format(value=O.r2("l + b * list_sum(list_transform(range(1, step + 1), lambda j: pow(f, j)))"))


def _winters_sql(times):
    along, usual = "(l + b)", "z[slot + 1]"
    fitted, bare = (f"({along} * {usual})", f"(y / {usual})") if times else (f"({along} + {usual})", f"(y - {usual})")
    after = f"(alpha * {bare} + (1 - alpha) * {along})"
    left = f"(y / {after})" if times else f"(y - {after})"
    return f"""{_CLAMPED_SQL}, {_grid_sql(alpha=FC.GRID, beta=FC.GRID, gamma=FC.GRID)},
y1 as (select region, sum(y) filter (t < 12) / 12 as base, (sum(y) filter (t between 12 and 23) - sum(y) filter (t < 12)) / 12 / 12 as rise from c where n >= 24 group by 1),
z1 as (select c.region, list({'y / base' if times else 'y - base'} order by slot) as z from c join y1 on c.region = y1.region where t < 12 group by 1),
st as (select y1.region, grid.i, cast(-1 as bigint) as t, base as l, rise as b, 0.0::double as e, z, 0 as m from y1 join z1 on y1.region = z1.region, grid where {'base > 0' if times else 'true'}
  union all select st.region, st.i, c.t, {after}, beta * ({after} - l) + (1 - beta) * b, e + case when c.t = 0 then 0 else ({fitted} - y) * ({fitted} - y) end,
    z[1:slot] || [gamma * {left} + (1 - gamma) * {usual}] || z[slot + 2:], slot from st join c on c.region = st.region and c.t = st.t + 1 join grid on grid.i = st.i),
""" + _BEST_SQL.format(value=O.r2(f"(l + b * step) {'*' if times else '+'} z[(m + step) % 12 + 1]"))


def _one_method(method):
    def build(spark, sf):
        return FC.method_forecasts(monthly(spark, sf), ["region"], 3, [method]).drop("method")
    return build


query("m4_exponential_smoothing", _smoothing_sql(3, alpha=FC.GRID))(_one_method("simple_exponential_smoothing"))
query("m6_holt", _smoothing_sql(4, alpha=FC.GRID, beta=FC.GRID))(_one_method("holt"))
query("m7_damped_holt", _smoothing_sql(5, alpha=FC.GRID, beta=FC.GRID, phi=FC.DAMPING))(_one_method("damped_holt"))
query("m10_holt_winters_additive", _winters_sql(False))(_one_method("holt_winters_additive"))
# The ratios need every period above zero, which monthly revenue is.
query("m11_holt_winters_multiplicative", _winters_sql(True))(_one_method("holt_winters_multiplicative"))


_MANY_SQL = f"{SALES_SQL}, s as (select region || ' / ' || category as k, strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 1, 2)"


@query("m12_rolling_origin", f"""with recursive {bake_off_sql(_MANY_SQL, 6)}
select k as series, method, mase, mape, mae, origins, eligible, reason, winner, params from board""")
def _(spark, sf):
    return FC.scoreboard(FC.bake_off(many_series(spark, sf), BY, 6), BY)


@query("m13_selection", f"""with recursive {bake_off_sql(_MANY_SQL, 3)}
select k as series, method, mase, origins from board where winner""")
def _(spark, sf):
    return FC.scoreboard(FC.bake_off(many_series(spark, sf), BY), BY).where("winner").select("series", "method", "mase", "origins")


@query("m14_winsorise", f"""with s as (select event_type, strftime(ts, '%Y-%m-%d') as period, floor(sum(value) * 100 + 0.5) / 100 as value from events group by 1, 2), {_MAD_SQL.format(k='event_type')}
select event_type, period, value, case when abs(z) >= 3.5 then least({O.r2('med + 3.5 * sc')}, greatest({O.r2('med - 3.5 * sc')}, value)) else value end as fitted_value, abs(z) >= 3.5 as clamped from m4""")
def _(spark, sf):
    from tallyloom.plans.views import load

    daily = load(spark, sf, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("period")).agg(
        round_half_up(F.sum("value"), 2).alias("value"))
    return FC.winsorise(daily, ["event_type"])


def _points(spark, sf, horizon=3):
    return FC.forecast_points(FC.bake_off(many_series(spark, sf), BY, horizon), BY)


@query("m15_forecast_bands", f"""with recursive {bake_off_sql(_MANY_SQL, 8)}
select k as series, period, step, method, basis, value, lower, upper from dated""")
def _(spark, sf):
    return _points(spark, sf, 8).select("series", "period", "step", "method", "basis", "value", "lower", "upper")


@query("m16_scenario_fan", f"""with recursive {bake_off_sql(_MANY_SQL, 3)}
select k as series, period, value, best, worst from dated""")
def _(spark, sf):
    return _points(spark, sf).select("series", "period", "value", "best", "worst")


@query("m17_goal_status", f"""with {_SERIES_SQL}, g as (select series, last as value, avg_ * 1.05 as goal from l join (select series as s2, avg(value) as avg_ from s group by 1) on s2 = series)
select series, {O.r2('value')} as value, {O.r2('goal')} as goal, {O.r2('goal - value')} as gap, floor((goal - value) / abs(goal) * 1000 + 0.5) / 10 as gap_pct,
  case when value >= goal then 'on_track' when floor((goal - value) / abs(goal) * 1000 + 0.5) / 10 <= 10 then 'at_risk' else 'missed' end as status from g""")
def _(spark, sf):
    latest = many_series(spark, sf).groupBy("series").agg(F.max_by("value", "period").alias("value"), (F.avg("value") * 1.05).alias("goal"))
    return FC.goal_status(latest, "value", "goal").withColumn("goal", round2(F.col("goal")))


_MOVED_SQL = f"""{SALES_SQL}, s0 as (select region, strftime(date, '%Y-%m') as period, {O.r2('sum(revenue)')} as value from sales group by 1, 2),
s as (select 'base|' || region as k, period, value from s0 union all select 'scenario|' || region, period, value + case when period = max(period) over (partition by region) then 1000000.0 else 0 end from s0)"""


@query("m18_what_if", f"""with recursive {bake_off_sql(_MOVED_SQL, 3)}
select split_part(k, '|', 1) as "case", split_part(k, '|', 2) as region, period, step, method, basis, value, lower, upper, best, worst from dated""")
def _(spark, sf):
    return FC.what_if(monthly(spark, sf), ["region"], 1_000_000.0)


@query("m19_flat_fallback", f"""with {SALES_SQL}, s as (select customer_id, min(strftime(date, '%Y-%m')) as p, {O.r2('sum(revenue)')} as v from sales group by 1 having count(distinct strftime(date, '%Y-%m')) = 1),
a as (select *, unnest([1, 2, 3]) as step from s)
select customer_id, step, strftime(cast(p || '-01' as date) + to_months(step), '%Y-%m') as period, v as value, v * 0.8 as lower, v * 1.2 as upper from a""")
def _(spark, sf):
    return FC.flat(MT.time_series(sales(spark, sf, "date", "customer_id", "revenue"), S, by=["customer_id"]), ["customer_id"])


# Forecasts saved at the end of 1999: each step one percent above the last value, 10 % to either side.
_SAVED_SQL = f"""{_SERIES_SQL}, o as (select series, max_by(value, period) as v0, max(period) as p0 from s where period <= '1999-12' group by 1),
p as (select *, unnest(generate_series(1, 30)) as step from o),
saved as (select series, step, strftime(cast(p0 || '-01' as date) + to_months(step), '%Y-%m') as period, v0 * (1 + 0.01 * step) as value, v0 * (0.9 + 0.01 * step) as lower, v0 * (1.1 + 0.01 * step) as upper from p),
scored as (select p.series, step, p.period, {O.r2('p.value')} as predicted, {O.r2('lower')} as lower, {O.r2('upper')} as upper, {O.r2('s.value')} as actual, {O.r2('abs(s.value - p.value)')} as abs_error,
  case when s.value <> 0 then {O.r2('abs(s.value - p.value) / abs(s.value) * 100')} end as pct_error, s.value between lower and upper as within_band
  from saved p join s on p.series = s.series and p.period = s.period where p.period < (select max(period) from s z where z.series = p.series))"""


def _saved(spark, sf, history):
    origin = history.where("period <= '1999-12'").groupBy("series").agg(F.max_by("value", "period").alias("v"), F.max("period").alias("p"))
    steps = origin.select("*", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("step"))
    v, up = F.col("v"), 0.01 * F.col("step")
    return steps.select("series", "step", FC.period_plus(F.col("p"), F.col("step")).alias("period"), (v * (1 + up)).alias("value"),
                        (v * (0.9 + up)).alias("lower"), (v * (1.1 + up)).alias("upper"))


def _scored(spark, sf):
    history = many_series(spark, sf)
    return FC.score_points(_saved(spark, sf, history), history, BY)


@query("m20_forecast_scoring", f"with {_SAVED_SQL} select * from scored")
def _(spark, sf):
    return _scored(spark, sf)


_ACC = f"""{{}} count(*) filter (not stale) as predictions, count(*) filter (stale) as stale, {O.r2('least(100, greatest(0, 100 - avg(pct_error) filter (not stale)))')} as accuracy_pct,
  {O.r2('avg(pct_error) filter (not stale)')} as mape, coalesce({O.r2('avg(abs_error) filter (not stale)')}, 0) as mae,
  {O.r2('count(*) filter (not stale and within_band) / nullif(count(*) filter (not stale), 0) * 100')} as within_band_pct"""


@query("m21_accuracy_summary", f"with {_SAVED_SQL}, t as (select *, step > 12 and series like 'ASIA%' as stale from scored) select {_ACC.format('step,')} from t group by 1")
def _(spark, sf):
    scores = _scored(spark, sf).withColumn("stale", (F.col("step") > 12) & F.col("series").startswith("ASIA"))
    return FC.accuracy(scores, ["step"])


@query("m22_score_upsert", f"""with {_SAVED_SQL}, u as (select series, period, actual, abs_error, 1 as version from scored where step <= 10
  union all select series, period, actual, abs_error + 1, 2 from scored where step > 5)
select series, period, max_by(actual, version) as actual, max_by(abs_error, version) as abs_error, max(version) as version from u group by 1, 2""")
def _(spark, sf):
    scores = _scored(spark, sf)
    old = scores.where("step <= 10").select("series", "period", "actual", "abs_error", F.lit(1).alias("version"))
    new = scores.where("step > 5").select("series", "period", "actual", (F.col("abs_error") + 1).alias("abs_error"), F.lit(2).alias("version"))
    return FC.upsert_scores(old, new, ["series", "period"], "version")


@query("l10_forecast_risk", f"""with recursive {bake_off_sql(_MANY_SQL, 1)}
select dated.k as series, 'forecast_risk' as type, 'MEDIUM' as severity, {O.r2('value')} as projected, {O.r2('last_raw')} as last from dated join hist using (k) where value < last_raw * 0.9""")
def _(spark, sf):
    history = many_series(spark, sf)
    following = FC.forecast_points(FC.bake_off(history, BY, 1), BY).select("series", "value")
    last = history.groupBy("series").agg(F.max_by("value", "period").alias("last"))
    return IN.forecast_risk(following, last, BY)
