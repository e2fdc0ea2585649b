"""Why a total changed: the strongest evidence of each kind, as claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.context import SchemaMap
from tallyloom.functions.money import short_number
from tallyloom.operators.drivers import contributions, price_volume_mix, top_contributions
from tallyloom.operators.metrics import row_revenue, time_series
from tallyloom.operators.stats import anomalies, correlate_metric


def investigate(df: DataFrame, schema: SchemaMap, bounds: DataFrame, dimensions: list[str], columns: list[str],
                members: int = 1, drivers: int | None = None, moving: int | None = None, periods: int | None = None) -> DataFrame:
    """Claims of four kinds with a value each: leading drivers, price against volume,
    columns that move along, and unusual periods.

    `members` of each dimension are named. The other limits keep the strongest claims of a
    kind; without them all are listed.
    """
    def strongest(frame, limit, *order):
        return frame if limit is None else frame.orderBy(*order).limit(limit)

    value = row_revenue(df, schema)
    top = top_contributions(contributions(df, schema, dimensions, value, bounds), members).where("member <> '(other)'")
    claims = strongest(top, drivers, F.desc(F.abs("delta")), "dimension", "member").select(
        F.lit("driver").alias("kind"), F.col("dimension").alias("subject"),
        F.concat("member", F.lit(": "), short_number(F.col("delta"))).alias("detail"), F.col("delta").alias("value"))

    split = price_volume_mix(df, schema, bounds)
    parts = F.concat_ws(", ", *[
        F.when(F.abs(f"{p}_delta") > 0.01, F.concat(F.lit(p + " "), short_number(F.col(f"{p}_delta")))) for p in ("volume", "price", "mix")])
    claims = claims.unionByName(split.select(
        F.lit("decomposition").alias("kind"), F.lit("revenue").alias("subject"),
        F.concat(F.lit("Of the change: "), parts).alias("detail"), F.col("total_delta").alias("value")))

    along = correlate_metric(df, schema, F.sum(value), columns, limit=moving).where("strength <> 'weak'")
    claims = claims.unionByName(along.select(
        F.lit("correlation").alias("kind"), F.col("column").alias("subject"),
        F.concat("column", F.lit(" follows revenue, correlation "), F.format_number("pearson", 2)).alias("detail"),
        F.col("pearson").alias("value")))

    unusual = anomalies(time_series(df, schema, "revenue")).where("is_anomaly")
    unusual = strongest(unusual, periods, F.desc(F.abs("deviation")), "period")
    return claims.unionByName(unusual.select(
        F.lit("anomaly").alias("kind"), F.col("period").alias("subject"),
        F.concat("period", F.lit(": "), short_number(F.col("deviation")), F.lit(" away from the usual "),
                 short_number(F.col("expected"))).alias("detail"), F.col("deviation").alias("value")))
