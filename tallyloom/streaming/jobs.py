"""Structured Streaming jobs: ingest, threshold rules, forecast scores, period totals.

A batch sink may be handed the same batch again after a failure, so each one writes a
folder named by the batch and replaces it: running a batch twice leaves it there once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.operators import clean
from tallyloom.operators.forecast import score_points
from tallyloom.operators.insights import new_alerts, rule_hits
from tallyloom.session import materialise


def _start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    return (stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _batch_path(folder: str, batch: int) -> str:
    return f"{folder}/batch={batch:08d}"


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Everything the batches of a job have written."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*").drop("batch")


def ingest_files(spark: SparkSession, folder: str, schema, steps: list[clean.Step], output: str, checkpoint: str) -> StreamingQuery:
    """New files of a table, cleaned by its recipe and added to the output.

    The files must carry the agreed columns, in any order: a file with others fails the batch,
    naming what is missing and what is extra. Steps here work on single rows; whole-row
    de-duplication belongs to the batch side.
    """
    if any(s.type == "duplicate_rows" for s in steps):
        raise ValueError("duplicate rows cannot be told apart within one batch")
    lines = spark.readStream.text(folder).select("value", F.col("_metadata.file_path").alias("file"))
    agreed = spark.createDataFrame([], schema).schema

    def sink(rows: DataFrame, batch: int) -> None:
        files = sorted(r["file"] for r in rows.select("file").distinct().collect())  # the batch's file names
        # Files are read by header, so those with the columns in one order are read together.
        by_header: dict[tuple, list[str]] = {}
        for file in files:
            header = tuple(c.strip() for c in spark.read.option("header", True).csv(file).columns)
            if set(header) != set(agreed.names) or len(header) != len(agreed.names):
                raise ValueError(f"{file}: missing {sorted(set(agreed.names) - set(header))}, extra {sorted(set(header) - set(agreed.names))}")
            by_header.setdefault(header, []).append(file)
        out = spark.createDataFrame([], agreed)
        for header, same in by_header.items():
            part = spark.read.schema(", ".join(f"`{c}` {agreed[c].dataType.simpleString()}" for c in header)).option("header", True).option("mode", "FAILFAST").csv(same)
            out = out.unionByName(part)
        clean.apply_recipe(out, steps).write.mode("overwrite").parquet(_batch_path(output, batch))

    return _start(lines, sink, checkpoint)


def _latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, that of the highest version."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_r")).select(*keys, "_r.*")


def daily_totals(events: DataFrame, time: str, by: list[str], value: str, lateness: str = "1 day") -> DataFrame:
    """Totals per day with `latest`, the last time seen in the day; rows later than the watermark are dropped."""
    watched = events.withWatermark(time, lateness)
    return watched.groupBy(F.window(time, "1 day").alias("w"), *by).agg(
        F.sum(value).alias("value"), F.count("*").alias("n"), F.max(time).alias("latest")).select(
        F.to_date("w.start").alias("day"), *by, "value", "n", "latest")


def write_daily_totals(totals: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Every day that a batch changes, as it stands then; `read_daily_totals` has each day once."""
    def sink(rows: DataFrame, batch: int) -> None:
        rows.withColumn("version", F.lit(batch)).write.mode("overwrite").parquet(_batch_path(output, batch))

    return _start(totals, sink, checkpoint, "update")


def _is_final(clock: Column, closed: bool, lateness: str) -> Column:
    """Whether the watermark has passed a day; with `closed` nothing more will arrive."""
    return F.lit(True) if closed else F.col("day") + F.expr("interval 1 day") <= clock - F.expr(f"interval {lateness}")


def read_daily_totals(spark: SparkSession, output: str, by: list[str], lateness: str = "1 day", closed: bool = False) -> DataFrame:
    """Each day's latest totals and whether they are final: later rows of it would be dropped."""
    days = _latest(read_batches(spark, output), ["day", *by], "version")
    clock = days.agg(F.max("latest")).scalar()
    return days.select("day", *by, "value", "n", _is_final(clock, closed, lateness).alias("final"))


ALERT = "rule_id int, metric string, day date, value double"


def _judged(spark: SparkSession, days: DataFrame, rules: DataFrame, opened: DataFrame) -> DataFrame:
    """The first crossing of each rule without an open alert."""
    hits = rule_hits(days.select("metric", "day", "value"), rules).groupBy("rule_id").agg(F.min_by(F.struct("metric", "day", "value"), "day").alias("h")).select("rule_id", "h.*")
    return new_alerts(hits, opened, ["rule_id"])


def threshold_alerts(totals: DataFrame, rules: DataFrame, opened: DataFrame, folder: str, checkpoint: str, lateness: str = "1 day") -> StreamingQuery:
    """Days judged by the rules once they are final; a rule with an open alert raises no second one.

    `totals` has `metric`, `day`, `value`, `latest`. The state after a batch is the days still
    open, the clock and the rules with an open alert; a batch reads that of the batch before it
    and nothing older, and run again writes the same.
    """
    spark = totals.sparkSession

    def before(name: str, batch: int, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(_batch_path(f"{folder}/{name}", batch - 1)) if batch else spark.createDataFrame([], schema)

    def sink(rows: DataFrame, batch: int) -> None:
        fields = "metric string, day date, value double, latest timestamp, version int"
        now = rows.select("metric", "day", "value", "latest").withColumn("version", F.lit(batch))
        days = materialise(_latest(before("days", batch, fields).unionByName(now), ["metric", "day"], "version"), "days")
        clock = before("clock", batch, "latest timestamp").unionByName(days.select("latest")).agg(F.max("latest").alias("latest"))
        clock.write.mode("overwrite").parquet(_batch_path(f"{folder}/clock", batch))
        at = F.lit(spark.read.parquet(_batch_path(f"{folder}/clock", batch)).first()["latest"])  # one row
        final = F.coalesce(_is_final(at, False, lateness), F.lit(False))
        days.where(~final).write.mode("overwrite").parquet(_batch_path(f"{folder}/days", batch))
        known = opened.select("rule_id").unionByName(before("open", batch, "rule_id int"))
        fresh = materialise(_judged(spark, days.where(final), rules, known), "alerts")
        fresh.write.mode("overwrite").parquet(_batch_path(f"{folder}/alerts", batch))
        known.unionByName(fresh.select("rule_id")).distinct().write.mode("overwrite").parquet(_batch_path(f"{folder}/open", batch))

    return _start(totals, sink, checkpoint, "update")


def close_alerts(spark: SparkSession, rules: DataFrame, folder: str, query: StreamingQuery) -> None:
    """Judges the days left open when an input has ended for good."""
    last = query.lastProgress["batchId"]
    days = spark.read.parquet(_batch_path(f"{folder}/days", last))
    fresh = _judged(spark, days, rules, spark.read.parquet(_batch_path(f"{folder}/open", last)))
    fresh.write.mode("overwrite").parquet(_batch_path(f"{folder}/alerts", last + 1))


def score_arrivals(actuals: DataFrame, points: DataFrame, by: list[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Saved forecast points graded as actual values arrive: a feed of changed scores.

    A point counts once a later period of its series is known. So a batch needs its own rows and,
    for the series it touches, the last period known before it: one row per series is all the
    state there is, and what a batch reads does not grow with the batches before it.
    """
    spark = actuals.sparkSession

    def sink(rows: DataFrame, batch: int) -> None:
        arrived = materialise(rows.groupBy(*by, "period").agg(F.max("value").alias("value")), "arrived")
        frontier = spark.read.schema(arrived.schema).parquet(_batch_path(f"{folder}/frontier", batch - 1)) if batch else arrived.limit(0)
        touched = arrived.select(*by).distinct()
        known = materialise(arrived.unionByName(frontier.join(touched, by, "left_semi").join(arrived, [*by, "period"], "left_anti")), "known")
        scored = score_points(points.join(touched, by, "left_semi"), known, by).withColumn("version", F.lit(batch))
        scored.write.mode("overwrite").parquet(_batch_path(f"{folder}/scores", batch))
        last = known.groupBy(*by).agg(F.max_by(F.struct("period", "value"), "period").alias("_l")).select(*by, "_l.*")
        frontier.join(touched, by, "left_anti").unionByName(last).write.mode("overwrite").parquet(_batch_path(f"{folder}/frontier", batch))

    return _start(actuals, sink, checkpoint)


def latest_scores(spark: SparkSession, folder: str, by: list[str]) -> DataFrame:
    """Each point's score as the last batch that changed it left it."""
    return _latest(read_batches(spark, f"{folder}/scores"), [*by, "period"], "version")
