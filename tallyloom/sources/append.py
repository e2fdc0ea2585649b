"""Adding a later file of the same report, and taking a table in."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.operators import clean, formats, profile as PR, shape as SH
from tallyloom.operators.evidence import fingerprint
from tallyloom.session import materialise


def append_problems(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """What keeps two tables from being combined, both sides named; empty when nothing does.

    Headers must match as sets; a number column may meet a currency column and an empty
    column may meet anything.
    """
    spark, both = existing.sparkSession, [c for c in existing.columns if c in incoming.columns]
    missing = [("missing_column", c, "present", "absent") for c in existing.columns if c not in incoming.columns]
    extra = [("extra_column", c, "absent", "present") for c in incoming.columns if c not in existing.columns]
    headers = spark.createDataFrame(missing + extra, "problem string, column string, existing string, incoming string")
    left, right = PR.column_types(existing, both), PR.column_types(incoming, both).withColumnRenamed("type", "other")
    amounts = F.col("type").isin("number", "currency") & F.col("other").isin("number", "currency")
    free = (F.col("type") == "empty") | (F.col("other") == "empty")
    # One row per column of the table.
    types = left.join(right, "column").where((F.col("type") != F.col("other")) & ~amounts & ~free).select(
        F.lit("type_mismatch").alias("problem"), "column", F.col("type").alias("existing"), F.col("other").alias("incoming"))
    return headers.unionByName(types)


def append(existing: DataFrame, incoming: DataFrame, steps: list[clean.Step] = ()) -> DataFrame:
    """Both tables under one header with the recipe replayed over all rows; refused on any problem."""
    problems = [f"{r['problem']} {r['column']}: {r['existing']} / {r['incoming']}" for r in append_problems(existing, incoming).collect()]
    if problems:
        raise ValueError("cannot combine these tables: " + "; ".join(sorted(problems)))
    return clean.apply_recipe(existing.unionByName(incoming), list(steps))


@dataclass
class Ingested:
    """A table taken in: the rows as they are analysed and what was found out about them."""

    rows: DataFrame
    applied: DataFrame
    formats: DataFrame
    profile: DataFrame
    issues: DataFrame
    score: DataFrame
    shape: DataFrame
    fingerprint: DataFrame

    def write(self, folder: str, run: str) -> None:
        """All tables beside one another under the run's name, then one row that makes them current.

        A failure before that row leaves readers with the version before. The same run again
        replaces what it wrote and is current once.
        """
        spark = self.rows.sparkSession
        for name, frame in vars(self).items():
            frame.write.mode("overwrite").parquet(f"{folder}/version={run}/{name}")
        past = published(spark, folder).where(F.col("run") != run)
        number = past.agg(F.coalesce(F.max("number") + 1, F.lit(0)).alias("number"))
        number.select(F.lit(run).alias("run"), "number").coalesce(1).write.mode("overwrite").parquet(f"{folder}/published/at={run}")


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(run, number): the versions that were written to the end; the highest number is current."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/published")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "run string, number int")
    return spark.read.schema("run string, number int").option("recursiveFileLookup", True).parquet(f"{folder}/published")


def read_ingested(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    last = published(spark, folder).orderBy(F.desc("number")).first()
    if last is None:
        raise FileNotFoundError(f"nothing has been taken in at {folder}")
    return {name: spark.read.parquet(f"{folder}/version={last['run']}/{name}") for name in (f.name for f in fields(Ingested))}


def ingest(df: DataFrame, steps: list[clean.Step] = (), zone: str = "UTC") -> Ingested:
    """Clean, bring to one number and date form, profile, shape and fingerprint a text table."""
    cleaned = materialise(clean.apply_recipe(df, list(steps)), "cleaned")
    columns = cleaned.columns
    found = materialise(formats.detect_formats(cleaned, columns), "formats")
    rows = materialise(formats.normalise_columns(cleaned, columns, found, zone), "rows")
    counts = materialise(PR.value_counts(rows, columns), "values")
    statistics = materialise(PR.column_statistics(PR.column_states(rows, columns), counts), "statistics")
    profile = materialise(PR.profile(rows, columns, statistics, counts), "profile")
    issues = materialise(PR.quality_issues(rows, columns, profile), "issues")
    # small tables that look at every cell: computed once, however often they are written
    applied = materialise(clean.applied_log(df, list(steps)), "applied")
    notes = materialise(formats.format_notes(cleaned, columns, zone, found), "notes")
    return Ingested(rows, applied, notes, profile, issues, PR.quality_score(issues),
                    SH.ranked_columns(rows, columns, statistics), materialise(fingerprint(rows), "fingerprint"))
