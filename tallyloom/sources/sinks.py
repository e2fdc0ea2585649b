"""Writing tables: safe CSV and the blocks of a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

from tallyloom.operators.formats import quoted


def formula_safe(df: DataFrame) -> DataFrame:
    """Text cells a spreadsheet would run as a formula get a leading quote."""
    out = []
    for field in df.schema.fields:
        cell = F.col(quoted(field.name))
        if isinstance(field.dataType, StringType):
            cell = F.when(cell.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)
        out.append(cell.alias(field.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    (formula_safe(df).write.option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


REPORT_BLOCKS = ("summary", "kpis", "sections", "forecast", "recommendations")


def select_blocks(blocks: dict[str, DataFrame], include: dict[str, bool] | None = None) -> dict[str, DataFrame]:
    """The blocks a template keeps; a block is dropped only when it says so."""
    return {n: b for n, b in blocks.items() if (include or {}).get(n.split(".")[0], True)}


def write_report(blocks: dict[str, DataFrame], folder: str, include: dict[str, bool] | None = None) -> list[str]:
    """One Parquet folder per block."""
    paths = []
    for name, block in select_blocks(blocks, include).items():
        paths.append(f"{folder}/{name}")
        block.write.mode("overwrite").parquet(paths[-1])
    return paths
