"""Which rows and which formula a figure comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.context import DEFAULT_CALENDAR, Calendar, Filters, SchemaMap
from tallyloom.operators.compare import period_bounds
from tallyloom.operators.drivers import contributions, top_contributions
from tallyloom.operators.filters import apply_filters, cascade_exclusions
from tallyloom.operators.formats import quoted
from tallyloom.operators.metrics import kpi_table, overview, revenue_columns, row_profit, row_revenue, value_inclusion

_PART = 12  # hex digits per part: sums stay exact in a decimal(38,0)


def fingerprint(df: DataFrame) -> DataFrame:
    """A digest of the rows of a table, whatever their order and their column order.

    Each row is hashed with its columns in name order; the hashes are cut into parts and
    the parts summed, so tasks combine their own sums and no row is moved. Equal digests
    mean the same rows with the same multiplicities. (Row order is not part of it.)
    """
    columns = [F.col(quoted(c)).alias(c) for c in sorted(df.columns)]
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring("h", 1 + i * _PART, _PART), 16, 10).cast("decimal(20,0)") for i in range(5)]
    return df.select(digest.alias("h")).agg(
        F.count("*").alias("n_rows"),
        *[F.coalesce(F.sum(p), F.lit(0)).cast("decimal(38,0)").cast("string").alias(f"part_{i}") for i, p in enumerate(parts)])


def kpi_evidence(df: DataFrame, schema: SchemaMap, kpi: str = "revenue", dimension: str = "product_name",
                 filters: Filters = Filters(), compare: str = "previous_period", cal: Calendar = DEFAULT_CALENDAR,
                 bounds: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything behind one key figure, as frames: the figure, its inputs, what was left
    out and why, the windows compared, the largest drivers and the rows' fingerprint."""
    bounds = bounds if bounds is not None else period_bounds(df, schema, filters, compare, cal)
    if kpi not in ("revenue", "profit", "orders", "customers", "margin"):
        raise ValueError(f"no evidence for {kpi}: revenue, profit, orders, customers or margin")
    profit = [schema["profit"]] if schema.get("profit") else revenue_columns(schema) + [schema.get("cost")]
    sources = {"margin": revenue_columns(schema) + profit, "revenue": revenue_columns(schema),
               "profit": profit,
               "orders": [schema.get("order_id")], "customers": [schema.get("customer_id")]}[kpi]
    sources = list(dict.fromkeys(c for c in sources if c))
    kind = "sum" if kpi in ("revenue", "profit", "margin") else "distinct"
    spark, earned = df.sparkSession, " * ".join(revenue_columns(schema)) or "0"
    gained = schema.get("profit") or (f"{earned} - {schema['cost']}" if schema.get("cost") else "0")
    formula = {"revenue": f"SUM({earned})", "profit": f"SUM({gained})", "margin": f"SUM({gained}) / SUM({earned}) x 100",
               "orders": f"COUNT(DISTINCT {schema['order_id']})" if schema.get("order_id") else "COUNT(rows)",
               "customers": f"COUNT(DISTINCT {schema.get('customer_id') or schema.get('customer_name')})"}[kpi]
    rule = {c: slot for slot, c in schema.items()}
    out = {
        "figure": kpi_table(df, schema, filters, compare, cal, bounds=bounds).where(F.col("kpi") == kpi),
        "formula": spark.createDataFrame([(kpi, formula)], "kpi string, formula string"),
        "sources": spark.createDataFrame([(c, rule.get(c)) for c in sources], "column string, slot string"),
        "compared": overview(df, schema, filters, compare, cal, bounds=bounds).where(F.col("measure") == kpi),
        "inputs": value_inclusion(apply_filters(df, schema, filters), kind, sources),
        "exclusions": cascade_exclusions(df, schema, filters),
        "windows": bounds,
        "fingerprint": fingerprint(df),
    }
    if kpi in ("revenue", "profit"):  # only totals can be attributed to members
        value = row_revenue(df, schema) if kpi == "revenue" else row_profit(df, schema)
        out["drivers"] = top_contributions(contributions(df, schema, [dimension], value, bounds, filters), 10)
    return out


def evidence_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """The evidence as one table of (block, line) rows, each line a JSON object."""
    out = None
    for block, frame in parts.items():
        line = frame.select(F.lit(block).alias("block"), F.to_json(F.struct("*")).alias("line"))
        out = line if out is None else out.unionByName(line)
    return out
