"""Places and running sums in one order of all rows, without a window over everything.

The rows are dealt into ranges of their key by Spark's range partitioner and written once, so
every later step sees the same ranges. Within a range a window numbers and sums its rows; what
lies before a range is a sum over one row for each range. No task holds more than a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.operators.formats import quoted
from tallyloom.session import materialise

#: Rows put in order for a page beyond the page's own; rows sampled to part a table.
FEW, SAMPLE = 10_000, 2_000


def _order(names: list[str]) -> list[Column]:
    """Sort columns; a name that starts with "-" is descending."""
    return [F.desc(quoted(n[1:])) if n.startswith("-") else F.asc(quoted(n)) for n in names]


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """The rows with `place`, from 0, in the order within each key, and each sum up to and with the row.

    The order should tell the rows of a key apart; of rows that it does not, any may come first.
    """
    sums = sums or {}
    keys = [F.col(quoted(c)) for c in by]
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    held = df.select("*", *[c.alias(f"_s{i}") for i, c in enumerate(sums.values())])
    ranged = materialise(held.repartitionByRange(parts, *keys, *_order(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.select("*", F.count("*").over(inside).alias("_at"), *[F.sum(f"_s{i}").over(inside).alias(f"_r{i}") for i in range(len(sums))])
    names = [f"_k{i}" for i in range(len(by))]
    whole = ranged.groupBy("_range", *[k.alias(n) for k, n in zip(keys, names)]).agg(
        F.count("*").alias("_n"), *[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(sums))])
    # Of a key at most one row for each range.
    earlier = Window.partitionBy(*names or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_range", *names, *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(b) for c, b in (
        ("_n", "_b"), *[(f"_t{i}", f"_b{i}") for i in range(len(sums))])])
    same = [F.col("l._range") == F.col("b._range"), *[F.col(f"l.{quoted(c)}").eqNullSafe(F.col(f"b.{n}")) for c, n in zip(by, names)]]
    return local.alias("l").join(before.alias("b"), same).select(
        *[F.col(f"l.{quoted(c)}") for c in df.columns], (F.col("_at") - 1 + F.col("_b")).alias("place"),
        *[(F.col(f"_r{i}") + F.col(f"_b{i}")).alias(k) for i, k in enumerate(sums)])


def rows_between(df: DataFrame, key: list[str], start: int, size: int, total: int) -> DataFrame:
    """The rows from place `start` in key order, `size` of them.

    Sampled keys part the table into slices and one pass counts each of them, so only the slices
    that the places fall into go on; this is repeated while they are many more than the page.
    """
    names = [f"k{i}" for i in range(len(key))]
    row_key = F.struct(*[F.col(quoted(k)).alias(n) for k, n in zip(key, names)])
    left, count, before = df, total, 0
    while count > FEW + 4 * size:
        drawn = left.select(row_key.alias("k")).sample(min(1.0, SAMPLE / count), seed=count).select("k.*")
        cuts = drawn.distinct().orderBy(*names).agg(F.sort_array(F.collect_set(F.struct(*names))).alias("c"))  # about SAMPLE keys
        cuts = materialise(cuts, "cuts")
        if not cuts.first()["c"]:
            break
        cut = F.array_size("c")
        # the number of cuts at most the key, by bisection; a key that is a cut is a slice of its own
        powers = F.array(*[F.lit(1 << p) for p in range(SAMPLE.bit_length() + 2, -1, -1)])
        mine = F.col("_key")
        at = F.aggregate(powers, F.lit(0), lambda a, s: F.when((a + s <= cut) & (mine >= F.get("c", F.least(a + s, cut) - 1)), a + s).otherwise(a))
        placed = left.select("*", cuts.scalar().alias("c"), row_key.alias("_key")).withColumn("_at", at)
        placed = placed.withColumn("_slice", F.col("_at") * 2 + F.when((F.col("_at") > 0) & (mine == F.get("c", F.col("_at") - 1)), 0).otherwise(1)).drop("c", "_at", "_key")
        sizes = sorted((r["_slice"], r["n"]) for r in placed.groupBy("_slice").agg(F.count("*").alias("n")).collect())  # two for each cut
        low = high = None
        seen = before
        kept = 0
        for number, n in sizes:
            if seen + n > start and seen < start + size:
                low, high = (number, number) if low is None else (low, number)
                kept += n
                first = seen if kept == n else first
            seen += n
        if low is None:
            return left.limit(0)
        single = low == high and low % 2 == 0
        left = placed.where(F.col("_slice").between(low, high)).drop("_slice")
        if single or kept == count:  # rows of one key: any order will do
            before, count = first, kept
            break
        before, count = first, kept
    return left.orderBy(*[F.col(quoted(k)) for k in key]).offset(start - before).limit(size)
