"""What-if levers: percentage changes to one business quantity, applied to the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tallyloom.context import SchemaMap
from tallyloom.operators.metrics import kpi_table, number, revenue_columns

FIELDS = ("revenue", "unit_price", "quantity", "cost")


@dataclass(frozen=True)
class Lever:
    field: str
    change_pct: float


def lever_column(schema: SchemaMap, field: str) -> str | None:
    """The column a lever moves: for revenue, the one revenue is really read from."""
    return schema.get("revenue") or schema.get("sales") if field == "revenue" else schema.get(field)


def apply_levers(df: DataFrame, schema: SchemaMap, levers: list[Lever]) -> DataFrame:
    """The rows with every lever applied; levers on one column compound.

    Levers without a column or without an effect leave the table as it is.
    """
    factors: dict[str, float] = {}
    for lever in levers:
        column = lever_column(schema, lever.field)
        if column and lever.change_pct:
            factors[column] = factors.get(column, 1.0) * (1 + lever.change_pct / 100)
    scaled = {c: F.floor(number(df, c) * f * 1e6 + 0.5) / 1e6 for c, f in factors.items()}
    return df.withColumns(scaled) if scaled else df


def lever_effects(schema: SchemaMap, levers: list[Lever]) -> list[dict]:
    """Which headline figures each lever can move on this table."""
    derived = len(revenue_columns(schema)) == 2
    profit_derived = not schema.get("profit") and bool(schema.get("cost"))
    out = []
    for lever in levers:
        column = lever_column(schema, lever.field)
        moves = bool(column) and (not derived if lever.field == "revenue" else derived and lever.field != "cost")
        reached = (["revenue"] if moves else []) + (
            ["profit"] if column and profit_derived and (moves or lever.field == "cost") else [])
        out.append({"field": lever.field, "column": column, "applied": bool(column and lever.change_pct), "moves": reached})
    return out


def compare_scenario(df: DataFrame, schema: SchemaMap, levers: list[Lever], bounds: DataFrame) -> DataFrame:
    """Every key figure as it is and under the levers."""
    base = kpi_table(df, schema, bounds=bounds).select("kpi", F.col("value").alias("base"))
    changed = kpi_table(apply_levers(df, schema, levers), schema, bounds=bounds).select("kpi", F.col("value").alias("scenario"))
    return base.join(changed, "kpi").select("kpi", "base", "scenario", (F.floor((F.col("scenario") - F.col("base")) * 100 + 0.5) / 100).alias("difference"))
