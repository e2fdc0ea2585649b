"""What a table of unknown meaning can be analysed by: its columns bound to slots, and its own key figures.

The roles and ranks of the columns are rows of a frame (one per column), so the binding is too. A
financial slot is bound only where a name, the kind of amount and its scale agree; a table
without a measure gets a record count and nothing made up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyloom.context import SchemaMap
from tallyloom.functions.numbers import round2
from tallyloom.operators.metrics import MetricSpec, metric_column, row_profit, row_revenue
from tallyloom.operators.shape import NAME_COST, NAME_PROFIT, financial_pairs, humanised

#: Groupings of more values are ranked, not charted.
CHARTABLE = 50
MEASURES_SHOWN = 3


def slot_binding(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """(slot, column): which column of the table plays which part; a part nothing can play is absent.

    date is the best time column, revenue the best measure. profit, or else cost, is the first
    measure so named that adds up on the lead's scale; quantity the first further plain number that
    adds up. The first three groupings, those small enough to chart before the others, are category,
    region and department; product_name and customer_name are those with the most values besides
    the first. order_id and customer_id are the best keys.
    """
    c = F.col
    place = Window.partitionBy(F.lit(1))  # one row per column of the table throughout

    def taken(frame, slots, *order):
        numbered = frame.select("column", F.row_number().over(place.orderBy(*order)).alias("_n")).where(c("_n") <= len(slots))
        return numbered.select(F.get(F.array(*[F.lit(s) for s in slots]), c("_n") - 1).alias("slot"), "column")

    role = lambda r: ranked.where(c("role") == r)
    measures = role("measure")
    out = taken(role("time"), ["date"], "rank").unionByName(taken(measures, ["revenue"], "rank"))

    first = measures.where((c("rank") > 1) & (c("aggregate") == "sum") & c("additive") & (c("format") != "percent"))
    named = first.select("column", "rank", F.when(c("column").rlike(NAME_PROFIT), "profit").when(c("column").rlike(NAME_COST), "cost").alias("slot")).where("slot is not null")
    leading = named.groupBy("slot").agg(F.min_by("column", "rank").alias("column"))  # only the first of a name is looked at
    accepted = financial_pairs(df, ranked).where("accepted").select("column")
    financial = leading.join(accepted, "column", "left_semi")
    # profit makes cost unnecessary
    financial = financial.select("slot", "column").orderBy(F.desc("slot")).limit(1)
    out = out.unionByName(financial)
    plain = first.where((c("format") == "number") & ~c("column").rlike(NAME_COST) & ~c("column").rlike(NAME_PROFIT))
    out = out.unionByName(taken(plain, ["quantity"], "rank"))

    groupings = role("dimension").withColumn("wide", c("unique_values") > CHARTABLE)
    charted = taken(groupings, ["category", "region", "department"], "wide", "rank")
    lead = charted.where("slot = 'category'").select("column")
    entities = groupings.join(lead, "column", "left_anti")
    alone = groupings.agg(F.count("*")).scalar() == 1  # a single grouping is its own entity
    out = out.unionByName(charted).unionByName(taken(entities, ["product_name", "customer_name"], F.desc("unique_values"), "rank"))
    out = out.unionByName(groupings.where(alone).select(F.lit("product_name").alias("slot"), "column"))
    return out.unionByName(taken(role("identifier"), ["order_id", "customer_id"], "rank"))


def derived_schema(df: DataFrame, ranked: DataFrame) -> SchemaMap:
    """The binding as the map that every operator takes; at most one entry per slot."""
    return {r["slot"]: r["column"] for r in slot_binding(df, ranked).collect()}


def derived_metrics(ranked: DataFrame, schema: SchemaMap) -> list[MetricSpec]:
    """The figures a table can honestly show: up to three measures each the way it adds up, its keys, its records."""
    rows = ranked.where("role in ('measure', 'identifier')").select(
        "role", "rank", "column", "aggregate", "format", humanised(F.col("column")).alias("label"),
        F.substring(F.regexp_replace(F.regexp_replace(F.lower("column"), "[^a-z0-9]+", "_"), "^[_0-9]+|_+$", ""), 1, 40).alias("key")
    ).orderBy(F.desc("role"), "rank").collect()  # one row per column of the table
    specs: list[MetricSpec] = []

    def add(key, label, kind, form, field=None):
        key, n, used = key or "column", 2, {s.key for s in specs}
        base = key
        while key in used:
            key, n = f"{base[:36]}_{n}", n + 1
        specs.append(MetricSpec(key, label, kind, form, field))

    for r in [r for r in rows if r["role"] == "measure"][:MEASURES_SHOWN]:
        if r["column"] != schema.get("cost"):  # shown through the profit
            add(r["key"], r["label"], "avg" if r["aggregate"] == "avg" else "sum", r["format"] or "number", r["column"])
    for r in [r for r in rows if r["role"] == "identifier"][:1]:
        add(r["key"], r["label"], "distinct", "number", r["column"])
    measured = any(s.kind in ("sum", "avg") for s in specs)
    add("records", "Records", "count", "number")
    return specs if measured else [specs[-1], *specs[:-1]]


def derived_figures(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """(position, key, label, kind, format, value): the table's own key figures, and profit and margin where they are sound."""
    schema = derived_schema(df, ranked)
    specs = derived_metrics(ranked, schema)
    columns = [metric_column(df, schema, s).alias(f"v{i}") for i, s in enumerate(specs)]
    shown = [(s.key, s.label, s.kind, s.format) for s in specs]
    if schema.get("profit") or schema.get("cost"):
        profit, revenue = F.sum(row_profit(df, schema)), F.sum(row_revenue(df, schema))
        columns += [round2(profit).alias(f"v{len(shown)}"), F.when(revenue != 0, round2(profit / revenue * 100)).otherwise(0.0).alias(f"v{len(shown) + 1}")]
        money = next((s.format for s in specs if s.field == schema["revenue"]), "number")
        shown += [("profit", "Profit", "derived", money), ("margin", "Margin", "derived", "percent")]
    one = df.agg(*columns)
    return one.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("position"), *[F.lit(v).alias(k) for k, v in zip(("key", "label", "kind", "format"), s)], F.col(f"v{i}").cast("double").alias("value"))
        for i, s in enumerate(shown)])))
