"""Alerts and recommendations from series, margins, groups and stock."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.functions.numbers import pct_change, round2

# The change in percent at or below which a metric counts as dropping.
THRESHOLDS = {
    "generic": {"revenue": -5.0, "profit_margin": 10.0},
    "retail": {"revenue": -5.0, "profit_margin": 10.0},
    "saas": {"churn": 5.0, "revenue": -10.0, "arpu": -10.0},
    "pharmacy": {"expiry_risk": 5.0, "revenue": -5.0},
    "services": {"utilization": 60.0, "revenue": -5.0},
    "manufacturing": {"defect_rate": 2.0, "revenue": -5.0},
}
DEFAULT_THRESHOLD = -10.0
SPIKE = 15.0


def threshold_table(spark, industry: str = "generic") -> DataFrame:
    return spark.createDataFrame(sorted(THRESHOLDS[industry].items()), "metric string, limit_pct double")


def last_two(series: DataFrame, by: list[str]) -> DataFrame:
    """The last value of each series and the one before it."""
    latest = Window.partitionBy(*by).orderBy(F.desc("period"))
    ranked = series.select("*", F.row_number().over(latest).alias("_r")).where("_r <= 2")
    return ranked.groupBy(*by).agg(
        F.max(F.when(F.col("_r") == 1, F.col("period"))).alias("period"),
        F.max(F.when(F.col("_r") == 1, F.col("value"))).alias("current"),
        F.max(F.when(F.col("_r") == 2, F.col("value"))).alias("previous"))


def series_alerts(series: DataFrame, by: list[str], industry: str = "generic") -> DataFrame:
    """Drops beyond a metric's threshold and rises of at least 15 %, last period against the one before.

    `series` has `metric`, `period`, `value` and the columns of `by`.
    """
    thresholds = F.broadcast(threshold_table(series.sparkSession, industry))
    judged = last_two(series, [*by, "metric"]).where("previous > 0").join(thresholds, "metric", "left").select(
        *by, "metric", "period", "current", "previous", pct_change(F.col("current"), F.col("previous")).alias("change_pct"),
        F.coalesce("limit_pct", F.lit(DEFAULT_THRESHOLD)).alias("limit"))
    drop, rise = F.col("change_pct") <= F.col("limit"), F.col("change_pct") >= SPIKE
    return judged.where(drop | rise).select(
        *by, "metric", F.concat("metric", F.when(drop, "_drop").otherwise("_spike")).alias("type"),
        F.when(drop & (F.col("change_pct") <= F.col("limit") * 2), "HIGH").when(drop, "MEDIUM").otherwise("LOW").alias("severity"),
        "period", "current", "previous", "change_pct")


def thin_margin(totals: DataFrame, by: list[str]) -> DataFrame:
    """Groups with revenue and a margin below 10 %; a negative one is severe. Needs `revenue` and `profit`."""
    margin = F.floor(F.col("profit") / F.nullif(F.col("revenue"), F.lit(0.0)) * 100 * 10 + 0.5) / 10
    return totals.select("*", margin.alias("margin_pct")).where("revenue > 0 and margin_pct < 10").select(
        *by, "margin_pct", F.when(F.col("margin_pct") < 0, "HIGH").otherwise("MEDIUM").alias("severity"))


def inventory_shortage(low: DataFrame) -> DataFrame:
    """One alert with the number of short products; none when nothing is short."""
    return low.agg(F.count("*").alias("products")).where("products > 0").select(
        F.lit("inventory_shortage").alias("type"), F.lit("MEDIUM").alias("severity"), "products")


def recommendations(changes: DataFrame, fallers: int = 3) -> DataFrame:
    """The groups to look into: the few that fell most and the one that grew most."""
    fell = changes.where("change_pct <= -10").orderBy("change_pct", "label").limit(fallers).agg(
        F.sort_array(F.collect_list(F.struct("change_pct", "label"))).alias("g")).where(F.size("g") > 0)
    rose = changes.where("change_pct >= 10").orderBy(F.desc("change_pct"), "label").limit(1)
    listed = F.array_join(F.transform("g", lambda x: F.concat(x["label"], F.lit(" ("), x["change_pct"].cast("string"), F.lit("%)"))), ", ")
    return fell.select(F.lit("Shrinking groups").alias("title"), F.concat(F.lit("Below the period before: "), listed).alias("observation")).unionByName(
        rose.select(F.lit("Fastest grower").alias("title"),
                    F.concat("label", F.lit(": up "), F.col("change_pct").cast("string"), F.lit("% on the period before")).alias("observation")))


def forecast_risk(next_points: DataFrame, last_points: DataFrame, by: list[str]) -> DataFrame:
    """Series whose next projected value is more than 10 % below the last one."""
    return next_points.join(last_points, by).where(F.col("value") < F.col("last") * 0.9).select(
        *by, F.lit("forecast_risk").alias("type"), F.lit("MEDIUM").alias("severity"),
        round2(F.col("value")).alias("projected"), round2(F.col("last")).alias("last"))


def new_alerts(fresh: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """The alerts that are not open yet: one per key; a null in a key equals a null."""
    seen = known.select(*[F.col(k).alias(f"open_{k}") for k in key]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"open_{k}")) for k in key])
    return fresh.dropDuplicates(key).join(seen, same, "left_anti")


def rule_hits(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules (`rule_id`, `metric`, `comparator`, `threshold`) whose metric crosses its threshold."""
    v, t, c = F.col("value"), F.col("threshold"), F.col("comparator")
    crosses = (F.when(c == "LT", v < t).when(c == "LTE", v <= t).when(c == "GT", v > t).when(c == "GTE", v >= t).otherwise(False))
    return rules.join(metrics, "metric").where(crosses)
