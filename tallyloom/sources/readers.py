"""Reading tables: delimited text, database tables, folders of tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyloom.functions.numbers import all_of, is_blank
from tallyloom.operators.formats import quoted
from tallyloom.operators.ranges import rows_between


def read_csv(spark: SparkSession, path: str | list[str], header: list[str] | None = None) -> DataFrame:
    """Delimited text with every cell as text: header trimmed, blank lines skipped.

    The header is taken from the file; nothing else is read before the query runs.
    """
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", multiLine=False,
                         ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, nullValue="\0", emptyValue="")
    named = raw.toDF(*(header or [c.strip() for c in raw.columns]))
    cells = named.select(*[F.coalesce(F.col(quoted(c)), F.lit("")).alias(c) for c in named.columns])
    return cells.where(~all_of([is_blank(F.col(quoted(c))) for c in cells.columns]))


def union_ragged(frames: list[DataFrame]) -> DataFrame:
    """Tables with different headers under the union of their columns, in first-seen order."""
    order = list(dict.fromkeys(c for f in frames for c in f.columns))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out.select(*[F.col(quoted(c)) for c in order])


def row_cap(df: DataFrame, limit: int | None = None) -> DataFrame:
    """At most `limit` rows; no cap unless one is asked for."""
    return df if limit is None else df.limit(limit)


# How each engine quotes an identifier and its driver's URL.
DIALECTS = {
    "postgres": ('"', '"', "jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mysql": ("`", "`", "jdbc:mysql://{host}:{port}/{database}", 3306),
    "sqlserver": ("[", "]", "jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
}


def jdbc_options(engine: str, host: str, database: str, table: str, user: str, password: str, port: int | None = None,
                 partition_column: str | None = None, lower=None, upper=None, partitions: int = 1) -> dict[str, str]:
    """Reader options for one whole table; names may be plain identifiers only.

    With a partition column the table is read by that many tasks side by side.
    """
    opening, closing, url, usual_port = DIALECTS[engine]
    for part in [*table.split("."), *([partition_column] if partition_column else [])]:
        if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", part):
            raise ValueError(f"{part!r} is not a plain identifier")
    options = {
        "url": url.format(host=host, port=port or usual_port, database=database),
        "dbtable": ".".join(f"{opening}{p}{closing}" for p in table.split(".")),
        "user": user, "password": password, "fetchsize": "10000", "pushDownLimit": "true",
    }
    if partition_column:
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, limit: int | None = None, **connection) -> DataFrame:
    return row_cap(spark.read.format("jdbc").options(**jdbc_options(**connection)).load(), limit)


def read_tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Each table of a folder as its own frame. Relations between them are only suggested."""
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}


def page(df: DataFrame, key: list[str], number: int, size: int = 50, total: int | None = None) -> DataFrame:
    """One page in key order, with the total and whether more follows.

    The page is found by counts of slices of the key, however deep it lies; only rows near it are
    put in order. A caller that turns pages passes the total on, so it is counted once.
    """
    start = max(0, number) * size
    total = df.count() if total is None else total
    return rows_between(df, key, start, size, total).select("*", F.lit(total).cast("bigint").alias("total"), F.lit(start + size < total).alias("has_more"))


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows with the total."""
    return df.limit(rows).select("*", df.agg(F.count("*")).scalar().alias("total"))
