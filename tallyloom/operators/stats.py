"""Series statistics: anomalies, correlation, quartiles, trend lines.

Series have one row per period, so a window over one series is as long as its history.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from tallyloom.context import DEFAULT_CALENDAR, Calendar, SchemaMap
from tallyloom.functions.calendar import period_key
from tallyloom.functions.dates import day_of
from tallyloom.functions.numbers import association_number, round2, round_half_up
from tallyloom.operators.formats import quoted
from tallyloom.operators.metrics import number
from tallyloom.operators.quantiles import approx_quantiles, exact_quantiles

#: Columns whose products are taken at once.
BLOCK = 64
THRESHOLD = 3.5
MAD_TO_SD = 0.6745


def anomalies(series: DataFrame, by: list[str] = ()) -> DataFrame:
    """Every point of a series with its normal band; series shorter than 4 points have none.

    The spread is the median distance to the median, so one wild point cannot widen the
    band it is judged by; the standard deviation stands in when that distance is 0.
    """
    whole = Window.partitionBy(*by or [F.lit(1)])
    v = F.col("value")
    centred = series.select("*", F.expr("percentile(value, 0.5)").over(whole).alias("_med"),
                            F.stddev_pop("value").over(whole).alias("_sd"), F.count("*").over(whole).alias("_n"))
    spread = centred.where("_n >= 4").select("*", F.abs(v - F.col("_med")).alias("_dist"))
    scaled = spread.select("*", F.expr("percentile(_dist, 0.5)").over(whole).alias("_mad")).select(
        "*", F.when(F.col("_mad") > 0, F.col("_mad") / MAD_TO_SD).otherwise(F.col("_sd")).alias("_scale"))
    z = F.when(F.col("_scale") > 0, (v - F.col("_med")) / F.col("_scale")).otherwise(0.0)
    judged = scaled.select("*", z.alias("_z")).select("*", (F.abs("_z") >= THRESHOLD).alias("is_anomaly"))
    flagged = F.col("is_anomaly")
    return judged.select(
        *by, "period", "value", round2(F.col("_med")).alias("expected"), round2(v - F.col("_med")).alias("deviation"),
        round2(F.col("_med") - THRESHOLD * F.col("_scale")).alias("lower"),
        round2(F.col("_med") + THRESHOLD * F.col("_scale")).alias("upper"), "is_anomaly",
        F.when(flagged, round_half_up(F.col("_z"), 2)).alias("z_score"),
        F.when(v >= F.col("_med"), "spike").otherwise("drop").alias("direction"),
        F.when(flagged, F.when(F.abs("_z") >= 5, "HIGH").otherwise("MEDIUM")).alias("severity"))


def _strength(r):
    return F.when(F.abs(r) >= 0.7, "strong").when(F.abs(r) >= 0.4, "moderate").otherwise("weak")


def correlate_pairs(points: DataFrame, by: list[str], x: str = "x", y: str = "y", order: str = "period") -> DataFrame:
    """Pearson and Spearman per group of points; ranks are by position, ties in period order."""
    def rank(column):
        return F.row_number().over(Window.partitionBy(*by).orderBy(column, order))

    ranked = points.select("*", rank(x).alias("_rx"), rank(y).alias("_ry"))
    def safe(a, b):
        r = F.corr(a, b)
        return F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r)

    return ranked.groupBy(*by).agg(
        F.count("*").alias("n"), safe(x, y).alias("_p"), safe("_rx", "_ry").alias("_s")).select(
        *by, "n", round_half_up(F.col("_p"), 3).alias("pearson"), round_half_up(F.col("_s"), 3).alias("spearman"),
        F.when(F.col("_p") >= 0, "positive").otherwise("negative").alias("direction"), _strength(F.col("_p")).alias("strength"))


def correlate_metric(df: DataFrame, schema: SchemaMap, metric, columns: list[str],
                     cal: Calendar = DEFAULT_CALENDAR, limit: int | None = None) -> DataFrame:
    """How the per-period total of each column moves with a metric."""
    day = day_of(F.col(quoted(schema["date"])))
    per_period = df.where(day.isNotNull()).groupBy(period_key(day, cal).alias("period")).agg(
        metric.alias("x"), *[F.sum(number(df, c)).alias(c) for c in columns])
    long = per_period.unpivot(["period", "x"], [F.col(quoted(c)) for c in columns], "column", "y")
    found = correlate_pairs(long, ["column"]).where("n >= 3").orderBy(F.desc(F.abs("pearson")), "column")
    return found if limit is None else found.limit(limit)


def pair_sums(numbers: DataFrame, columns: list[str], centres: list[float]) -> DataFrame:
    """(i, j, n, sx, sy, sxx, syy, sxy) of every pair of columns over the rows that have both.

    A task takes the products of its rows' matrix with itself, BLOCK columns at a time, and sends
    one row for each pair, whatever its number of rows. Values are taken from their column's
    centre, so that the sums of squares keep their places.
    """
    blocks = [list(range(k, min(k + BLOCK, len(columns)))) for k in range(0, len(columns), BLOCK)]
    middle = np.array(centres, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(p, q): np.zeros((6, len(blocks[p]), len(blocks[q]))) for p in range(len(blocks)) for q in range(p, len(blocks))}
        for batch in batches:
            x = np.stack([np.asarray(c.to_numpy(zero_copy_only=False), np.float64) for c in batch.columns], axis=1) - middle
            there = np.isfinite(x)
            x[~there] = 0
            there = there.astype(np.float64)
            for (p, q), held in sums.items():
                a, b, m, w = x[:, blocks[p]], x[:, blocks[q]], there[:, blocks[p]], there[:, blocks[q]]
                held += np.stack([m.T @ w, a.T @ w, m.T @ b, (a * a).T @ w, m.T @ (b * b), a.T @ b])
        for (p, q), held in sums.items():
            i, j = np.meshgrid(blocks[p], blocks[q], indexing="ij")
            keep = (i < j) & (held[0] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(i[keep], pa.int32()), pa.array(j[keep], pa.int32()), *(pa.array(h[keep]) for h in held)],
                                             names=["i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"])

    found = numbers.mapInArrow(run, "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double")
    return found.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])


def correlate_columns(df: DataFrame, columns: list[str], min_sample: int = 5, numeric_share: float = 0.6) -> DataFrame:
    """Correlation of every pair of numeric columns over the rows that have both, however many columns."""
    def as_number(c):
        cell = F.col(quoted(c))
        return cell.cast("double") if isinstance(df.schema[c].dataType, NumericType) else association_number(cell)

    counted = df.agg(*[a for i, c in enumerate(columns) for a in (
        F.count_if(F.col(quoted(c)).isNotNull() & (F.col(quoted(c)).cast("string") != "")).alias(f"present{i}"),
        F.count(as_number(c)).alias(f"numeric{i}"), F.avg(as_number(c)).alias(f"centre{i}"))]).first()  # one row
    usable = [i for i in range(len(columns)) if counted[f"numeric{i}"] >= max(counted[f"present{i}"] * numeric_share, 1.0)]
    names = [columns[i] for i in usable]
    finite = [c if c is not None and math.isfinite(c) else 0.0 for c in (counted[f"centre{i}"] for i in usable)]
    schema = "a string, b string, coefficient double, sample_size long, strength string, direction string"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    sums = pair_sums(df.select(*[as_number(c).alias(f"x{i}") for i, c in enumerate(names)]), names, finite)
    def spread(s, ss):  # what is left of a constant is rounding
        left = F.col(ss) - F.col(s) * F.col(s) / F.col("n")
        return F.when(left > F.col(ss) * 1e-12, left).otherwise(0.0)

    r = F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.sqrt(spread("sx", "sxx") * spread("sy", "syy")))
    listed = F.array(*[F.lit(c) for c in names])
    rows = sums.select(F.get(listed, F.col("i")).alias("a"), F.get(listed, F.col("j")).alias("b"), F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))).alias("r"), F.col("n").cast("bigint").alias("sample_size"))
    size = F.abs("r")
    strength = (F.when(size >= 0.8, "very strong").when(size >= 0.6, "strong").when(size >= 0.4, "moderate")
                .when(size >= 0.2, "weak").otherwise("negligible"))
    told = (F.col("sample_size") >= min_sample) & F.col("r").isNotNull() & ~F.isnan("r")
    return rows.where(told).select(
        "a", "b", round_half_up(F.col("r"), 3).alias("coefficient"), "sample_size", strength.alias("strength"),
        F.when(size < 0.2, "none").when(F.col("r") > 0, "positive").otherwise("negative").alias("direction"))


def describe(df: DataFrame, column: str, by: list[str], approx: bool = False) -> DataFrame:
    """Mean, population standard deviation, quartiles and the 90th percentile.

    `approx` takes the quantiles from one sketch, within about 0.2 % of their ranks.
    """
    x = F.col(quoted(column))
    basic = df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))
    quantiles = (approx_quantiles if approx else exact_quantiles)(df.select(*by, column), by, column, [0.25, 0.5, 0.75, 0.9])
    return basic.join(quantiles, by).select(
        *by, round_half_up(F.col("mean"), 4).alias("mean"), round_half_up(F.col("sd"), 4).alias("sd"),
        *[round_half_up(F.col(f"q{i}"), 4).alias(n) for i, n in enumerate(("q1", "median", "q3", "p90"))])


def trend_line(series: DataFrame, by: list[str]) -> DataFrame:
    """The least-squares line through each series at x = 0, 1, ..., with the residual spread."""
    x = F.row_number().over(Window.partitionBy(*by).orderBy("period")) - 1
    placed = series.select(*by, "value", x.cast("double").alias("x"))
    fitted = placed.groupBy(*by).agg(
        F.count("*").alias("n"), F.regr_slope("value", "x").alias("_b"), F.regr_intercept("value", "x").alias("_a"),
        F.regr_syy("value", "x").alias("_syy"), F.regr_sxy("value", "x").alias("_sxy"), F.avg("value").alias("_mean"))
    # One point has no slope: a flat line through it.
    slope, intercept = F.coalesce("_b", F.lit(0.0)), F.coalesce("_a", "_mean")
    residual = F.sqrt(F.greatest(F.col("_syy") - slope * F.col("_sxy"), F.lit(0.0)) / F.col("n"))
    return fitted.select(*by, "n", slope.alias("slope"), intercept.alias("intercept"), residual.alias("residual_sd"))
