"""Result shaping: pivots, shares, ranks, running totals, buckets, funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions.numbers import exact_sum, round2, round_half_up
from tallyloom.operators.quantiles import at_ranks
from tallyloom.operators.ranges import running


def pivot_totals(df: DataFrame, rows: list[str], column: str, value: Column) -> DataFrame:
    """Totals for every prefix of the row fields by column, from all rows down to none.

    One shuffle for all levels: the expanded rows are summed in each task before they move.
    `depth` is the number of row fields a total keeps; a combination without rows is absent.
    """
    named = df.select(*[F.coalesce(F.col(r).cast("string"), F.lit("—")).alias(r) for r in rows],
                      F.coalesce(F.col(column).cast("string"), F.lit("—")).alias(column), value.alias("_v"))
    # Sum the finest cells first, so the grouping sets expand cells and not rows.
    cells = named.groupBy(*rows, column).agg(exact_sum("_v").alias("_v"))
    sets = [[F.col(c) for c in [*rows[:d], column]] for d in range(len(rows), -1, -1)]
    sums = cells.groupingSets(sets, *[F.col(c) for c in [*rows, column]]).agg(
        exact_sum("_v").alias("_v"), *[F.grouping(r).alias(f"_g_{r}") for r in rows])
    depth = sum([1 - F.col(f"_g_{r}").cast("int") for r in rows], F.lit(0))
    return sums.select(depth.alias("depth"), *rows, column, round2(F.col("_v")).alias("value"))


def pivot_matrix(df: DataFrame, rows: list[str], column: str, value: Column, columns: list[str]) -> DataFrame:
    """The matrix itself: one line per row path and subtotal, one column per value, and a total.

    An empty cell means no rows; 0 means rows that add up to it.
    """
    totals = pivot_totals(df, rows, column, value)
    return totals.groupBy("depth", *rows).agg(
        *[F.max(F.when(F.col(column) == c, F.col("value"))).alias(c) for c in columns], round2(exact_sum("value")).alias("total"))


def percent_of_row(cells: DataFrame, row: str) -> DataFrame:
    """Each cell's share of the absolute total of its row; an all-zero row has shares of 0."""
    whole = F.sum(F.abs("value")).over(Window.partitionBy(row))
    return cells.withColumn("share_pct", F.when(whole != 0, round_half_up(F.abs("value") / whole * 100, 4)).otherwise(0.0))


def rank_by_period(cells: DataFrame, series: str) -> DataFrame:
    """Each series' place within a period and where its band starts and ends when stacked.

    A period may hold any number of series: places and sums run over ranges of it.
    """
    placed = running(cells.select("period", series, "value"), ["period"], ["-value", series], {"_end": F.col("value")})
    return placed.select("period", series, "value", F.col("place").cast("int").alias("rank"),
                         round2(F.col("_end") - F.col("value")).alias("band_from"), round2(F.col("_end")).alias("band_to"))


def waterfall(deltas: DataFrame, order: str, by: list[str] = ()) -> DataFrame:
    """Signed changes as floating bars with the running total, over ranges of the order."""
    placed = running(deltas.select(*by, order, "value"), list(by), [order], {"_end": F.col("value")})
    end = F.col("_end")
    return placed.select(*by, order, "value", round2(F.least(end - F.col("value"), end)).alias("base"),
                         round2(F.abs("value")).alias("delta"), round2(end).alias("cumulative"), (F.col("value") >= 0).alias("positive"))


def quantile_breaks(totals: DataFrame, buckets: int = 5) -> DataFrame:
    """The distinct values at each n-th of the totals in order, as one sorted array."""
    ranks = F.array(*[F.floor(F.lit(b / buckets) * F.col("total")) for b in range(1, buckets)])
    spread = totals.agg((F.min("value") == F.max("value")).alias("flat"))
    kept = at_ranks(totals.select("value"), [], "value", ranks).agg(F.sort_array(F.collect_set("value")).alias("breaks"))  # fewer than buckets
    return kept.select(F.when(spread.scalar(), F.array().cast("array<double>")).otherwise(F.col("breaks")).alias("breaks"))


def quantile_buckets(totals: DataFrame, buckets: int = 5) -> DataFrame:
    """Which colour bucket each total falls into."""
    breaks = quantile_breaks(totals, buckets).scalar()
    held = totals.select("*", breaks.alias("_b"))
    return held.withColumn("bucket", F.size(F.filter("_b", lambda x: F.col("value") >= x))).drop("_b")


def funnel(df: DataFrame, stage: str, stages: list[str], value: Column) -> DataFrame:
    """A value per stage with its share of the first stage and of the one before."""
    totals = df.where(F.col(stage).isin(stages)).groupBy(stage).agg(value.cast("double").alias("value"))
    place = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col(stage)).cast("int")
    order = Window.partitionBy(F.lit(1)).orderBy("position")  # one row per stage
    placed = totals.select(place.alias("position"), F.col(stage).alias("stage"), "value")

    def share(of):
        return F.when(of != 0, round_half_up(F.col("value") / of * 100, 2))

    return placed.select("*", share(F.first("value").over(order)).alias("of_first_pct"),
                         share(F.lag("value").over(order)).alias("of_previous_pct"))


def heatmap(df: DataFrame, x: Column, y: Column, value: Column) -> DataFrame:
    return df.groupBy(x.alias("x"), y.alias("y")).agg(value.alias("value"))
