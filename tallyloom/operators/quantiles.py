"""Exact quantiles of distributed values, narrowed by rank.

Spark's exact `percentile` keeps every distinct value of a group in one buffer. Here a quantile
sketch, merged from one small state for each task, cuts a group's values into slices of about
equal numbers of rows, whatever their distribution. A second pass counts the rows below the slices
around a wanted rank and keeps their own values with counts, a small share of the table. So it is
known for certain whether they hold the rank, and only they go on: to rounds of narrower slices
while they are many, then into order. Should the sketch have missed, the rounds go over the whole
table. The sketch decides how narrow a slice is, never which value is returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.session import materialise

#: Slices of a round (a power of two), the sketch's parameter (about 0.2 % of rank error), and the values put in order at most.
SLICES, SKETCH, FEW = 256, 2048, 50_000
_SPAN = ["_lo", "_hi", "_before", "_total"]


def _slice_of(value: Column, cuts: Column) -> Column:
    """The place of a value among the sorted `cuts`: twice how many are at most the value, by bisection.

    A value that is a cut has an even place, one between two cuts an odd one, so a very frequent
    value is a slice of its own.
    """
    steps = F.array(*[F.lit(1 << k) for k in range(SLICES.bit_length() - 2, -1, -1)])
    place = F.aggregate(steps, F.lit(0), lambda at, step: F.when(value >= F.get(cuts, at + step - 1), at + step).otherwise(at))
    return F.transform(F.array(place), lambda at: at * 2 + F.when((at > 0) & (value == F.get(cuts, at - 1)), 0).otherwise(1))[0]


def _cuts(value: Column) -> Column:
    """The values that part a group's rows into SLICES about equal parts."""
    ranks = F.array(*[F.lit(k / SLICES) for k in range(1, SLICES)])
    return F.kll_sketch_get_quantile_double(F.kll_sketch_agg_double(value, SKETCH), ranks)


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: Column, weight: str | None = None,
             few_keys: bool = False) -> DataFrame:
    """(keys, total, rank, value): the values at given places, from 0, of each group in order.

    `ranks` is an array over `total`, the group's number of non-null rows. A row counts `weight`
    times. With no keys, or `few_keys` such as the columns of a table, the spans sought (one row
    for each key and rank) are broadcast.
    """
    small = F.broadcast if few_keys or not keys else (lambda frame: frame)
    v = F.col(value)
    by = [f"_k{i}" for i in range(len(keys))] or ["_all"]
    key = [F.col(k).alias(b) for k, b in zip(keys, by)] or [F.lit(0).alias("_all")]
    count = F.lit(1) if weight is None else F.col(weight)
    values = rows.where(v.isNotNull()).select(*key, v.cast("double").alias("_v"), count.cast("bigint").alias("_n"))

    # A span is a range of values of one key with the rows before it and the ranks sought in it.
    seek = F.transform(F.array_distinct(ranks), lambda r: r.cast("bigint"))
    spans = values.groupBy(*by).agg(
        F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.lit(0).cast("bigint").alias("_before"), F.sum("_n").alias("total"),
        F.count("*").alias("_held"), _cuts(F.col("_v")).alias("_cuts"))
    spans = materialise(spans.select(*by, "_lo", "_hi", "_before", F.col("total").alias("_total"), "_held", seek.alias("_seek"), "_cuts"), "spans")

    def many(spans: DataFrame) -> bool:
        return (spans.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_held")))).first()[0] or 0) > FEW

    groups = by
    if weight is None and many(spans):  # the sketch ranks rows, not weights
        near = _around(values, spans, by, small)
        if near is not None:
            values, spans, by = *near, [*by, "_span"]
    same = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in by]
    within = [*same, F.col("_v").between(F.col("_lo"), F.col("_hi"))]

    def inside(spans: DataFrame) -> DataFrame:
        rows = values.alias("a").join(small(spans).alias("b"), within)
        return rows.select(*[f"a.{b}" for b in by], "_v", "_n", *[c for c in spans.columns if c not in by])

    while many(spans):
        slices = inside(spans).groupBy(*by, *_SPAN, _slice_of(F.col("_v"), F.col("_cuts")).alias("_slice")).agg(
            F.sum("_n").alias("_m"), F.count("*").alias("_held"), F.min("_v").alias("_first"), F.max("_v").alias("_last"), F.any_value("_seek").alias("_seek"))
        # At most 2 * SLICES rows per span.
        upto = F.col("_before") + F.sum("_m").over(Window.partitionBy(*by, *_SPAN).orderBy("_slice"))
        summed = slices.select(*by, F.col("_first").alias("_lo"), F.col("_last").alias("_hi"), (upto - F.col("_m")).alias("_before"), "_total", "_held",
                               upto.alias("_to"), "_seek")
        sought = F.filter("_seek", lambda r: (r >= F.col("_before")) & (r < F.col("_to")))
        found = summed.withColumn("_seek", sought).where(F.size("_seek") > 0).drop("_to")
        # the narrower spans with cuts of their own, written once: a sketch differs between evaluations
        found = materialise(found, "spans")
        cuts = inside(found).groupBy(*by, *_SPAN).agg(_cuts(F.col("_v")).alias("_cuts"))
        again = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*by, *_SPAN]]
        spans = found.alias("a").join(cuts.alias("b"), again).select("a.*", "_cuts")
        spans = materialise(spans, "spans")

    distinct = inside(spans.drop("_cuts", "_held")).groupBy(*by, *_SPAN, "_v").agg(F.sum("_n").alias("_n"), F.any_value("_seek").alias("_seek"))
    # FEW values per span at most, or a single one
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, *_SPAN).orderBy("_v"))
    # the sums are taken before the ranks are told apart, or values would count once for each rank
    placed = distinct.select("*", upto.alias("_to")).select(*by, "_total", "_v", F.filter(
        "_seek", lambda r: (r >= F.col("_to") - F.col("_n")) & (r < F.col("_to"))).alias("_hit"))
    hits = placed.where(F.size("_hit") > 0).select("*", F.explode("_hit").alias("rank"))
    return hits.select(*[F.col(b).alias(k) for k, b in zip(keys, groups)], F.col("_total").alias("total"), "rank", F.col("_v").alias("value"))


def _around(values: DataFrame, spans: DataFrame, by: list[str], small) -> tuple[DataFrame, DataFrame] | None:
    """The values near the ranks sought, with their counts, and their spans; None where a rank is not among them.

    A rank lies in the slice of the sketch that its share of the rows points at, or in one beside
    it. The table is read once: of rows below a span only their number is kept, rows above it go.
    """
    slice_ = F.floor(F.col("_rank") * SLICES / F.col("_total")).cast("int")
    sought = spans.select(*by, "_lo", "_hi", "_total", "_cuts", F.explode("_seek").alias("_rank"))
    wide = sought.select(*by, F.coalesce(F.get("_cuts", slice_ - 2), "_lo").alias("_lo"), F.coalesce(F.get("_cuts", slice_ + 1), "_hi").alias("_hi"), "_total", "_rank")
    wanted = wide.groupBy(*by, "_lo", "_hi", "_total").agg(F.collect_list("_rank").alias("_seek"))
    # numbered once: the number stands for the span in every later table
    wanted = materialise(wanted.withColumn("_span", F.monotonically_increasing_id()), "sought")
    same = [F.col(f"a.{b}").eqNullSafe(F.col(f"b.{b}")) for b in by]
    met = values.alias("a").join(small(wanted.select(*by, "_lo", "_hi", "_span")).alias("b"), [*same, F.col("_v") <= F.col("_hi")])
    inner = F.when(F.col("_v") >= F.col("_lo"), F.col("_v"))  # null below the span
    counted = materialise(met.select("_span", inner.alias("_v"), "_n").groupBy("_span", "_v").agg(F.sum("_n").alias("_n")), "near")
    below = counted.where("_v is null").select("_span", F.col("_n").alias("_below"))
    held = counted.where("_v is not null")
    inside = held.groupBy("_span").agg(F.sum("_n").alias("_m"), F.count("*").alias("_held"), _cuts(F.col("_v")).alias("_cuts"))
    told = wanted.join(inside, "_span", "left").join(below, "_span", "left").select(
        *by, "_span", "_lo", "_hi", F.coalesce("_below", F.lit(0).cast("bigint")).alias("_before"), "_total", F.coalesce("_held", F.lit(0).cast("bigint")).alias("_held"), "_seek", "_cuts",
        F.coalesce("_m", F.lit(0).cast("bigint")).alias("_m"))
    told = materialise(told, "spans")
    missed = F.exists("_seek", lambda r: (r < F.col("_before")) | (r >= F.col("_before") + F.col("_m")))
    if not told.where(missed).isEmpty():
        return None
    return held.join(small(wanted.select("_span", *by)), "_span").select(*by, "_span", "_v", "_n"), told.drop("_m")


def exact_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float], weight: str | None = None,
                    few_keys: bool = False) -> DataFrame:
    """One row per key: `total` and the linearly interpolated quantiles `q0`, `q1`, ..."""
    place = lambda p: F.lit(float(p)) * (F.col("total") - 1)
    ranks = F.array(*[f(place(p)) for p in probs for f in (F.floor, F.ceil)])
    found = at_ranks(rows, keys, value, ranks, weight, few_keys)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("value")))
    ends = found.groupBy(*keys, "total").agg(*[at(f(place(p))).alias(f"_{n}{i}") for i, p in enumerate(probs) for n, f in (("lo", F.floor), ("hi", F.ceil))])
    quantile = lambda i, p: F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (place(p) - F.floor(place(p)))
    return ends.select(*keys, "total", *[quantile(i, p).alias(f"q{i}") for i, p in enumerate(probs)])


def approx_quantiles(rows: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """The same from one sketch for each key, in one pass: a value within about 0.2 % of each rank."""
    held = rows.where(F.col(value).isNotNull())
    sketched = held.groupBy(*keys).agg(F.count("*").alias("total"), F.kll_sketch_agg_double(F.col(value).cast("double"), SKETCH).alias("_s"))
    return sketched.select(*keys, "total", *[F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)])
