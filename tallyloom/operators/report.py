"""The blocks of an executive report, as frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyloom.context import SchemaMap
from tallyloom.functions.money import usd
from tallyloom.operators import forecast as FC
from tallyloom.operators.compare import change_by_group
from tallyloom.operators.insights import recommendations
from tallyloom.operators.metrics import kpi_table, ranking, row_revenue, time_series


def report(df: DataFrame, schema: SchemaMap, bounds: DataFrame, horizon: int = 3, limit: int | None = None) -> dict[str, DataFrame]:
    """Summary, key figures, ranked sections (all groups without a limit), a forecast and recommendations."""
    kpis = kpi_table(df, schema, bounds=bounds)
    revenue = F.max(F.when(F.col("kpi") == "revenue", F.col("value")))
    change = F.max(F.when(F.col("kpi") == "revenue", F.col("change_pct")))
    moved = F.when(change.isNull(), "no period before to compare with").otherwise(
        F.concat(F.lit("change on the period before: "), change.cast("string"), F.lit("%")))
    series = time_series(df, schema, "revenue").withColumn("series", F.lit("revenue"))
    return {
        "summary": kpis.agg(F.concat(F.lit("Total revenue: "), usd(revenue), F.lit("; "), moved).alias("text")),
        "kpis": kpis,
        "sections.products": ranking(df, schema, "product_name", limit=limit),
        "sections.regions": ranking(df, schema, "region", limit=limit),
        "forecast": FC.forecast_points(FC.bake_off(series, ["series"], horizon), ["series"]),
        "recommendations": recommendations(change_by_group(df, schema, "product_name", row_revenue(df, schema), bounds)),
    }
