"""Row measures, metrics, key figures, rankings and series."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tallyloom.context import DEFAULT_CALENDAR, Calendar, Filters, SchemaMap
from tallyloom.functions import calendar as C
from tallyloom.functions.dates import day_of
from tallyloom.functions.numbers import exact_sum, is_blank, number_or_zero, pct_change, plain_number, round2, round_half_up
from tallyloom.functions.strings import group_label, tidy_key, trimmed
from tallyloom.operators.compare import period_bounds, tag_periods
from tallyloom.operators.filters import apply_filters, row_condition
from tallyloom.operators.formats import quoted


def number(df: DataFrame, column: str) -> Column:
    """A column as a number with unreadable cells as zero; typed numbers are not re-read."""
    cell = F.col(quoted(column))
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.coalesce(cell.cast("double"), F.lit(0.0))
    return number_or_zero(cell)


# --- row measures ---------------------------------------------------------------------------


def revenue_columns(schema: SchemaMap) -> list[str]:
    """The columns a row's revenue is read from, by the first rule the table satisfies."""
    for single in ("revenue", "sales"):
        if schema.get(single):
            return [schema[single]]
    if schema.get("quantity") and schema.get("unit_price"):
        return [schema["quantity"], schema["unit_price"]]
    return []


def row_revenue(df: DataFrame, schema: SchemaMap) -> Column:
    columns = revenue_columns(schema)
    if not columns:
        return F.lit(0.0)
    first, *rest = [number(df, c) for c in columns]
    return first * rest[0] if rest else first


def row_profit(df: DataFrame, schema: SchemaMap) -> Column:
    if schema.get("profit"):
        return number(df, schema["profit"])
    if schema.get("cost"):
        return row_revenue(df, schema) - number(df, schema["cost"])
    return F.lit(0.0)


def row_quantity(df: DataFrame, schema: SchemaMap) -> Column:
    return number(df, schema["quantity"]) if schema.get("quantity") else F.lit(1.0)


def row_value(df: DataFrame, schema: SchemaMap, metric: str) -> Column:
    """What one row adds to a named metric; `orders` counts rows here."""
    return {
        "revenue": row_revenue, "profit": row_profit, "quantity": row_quantity,
        "orders": lambda *_: F.lit(1.0),
    }[metric](df, schema)


# --- user metrics -----------------------------------------------------------------------------


@dataclass(frozen=True)
class MetricSpec:
    """A user metric: one aggregation over one or two fields and at most one row filter."""

    key: str
    label: str
    kind: str
    format: str = "number"
    field: str | None = None
    denominator: str | None = None
    filter: tuple[str, str, object] | None = None  # field, operator, value

    def problems(self) -> list[str]:
        out = []
        if not re.fullmatch("[a-z][a-z0-9_]{0,39}", self.key or ""):
            out.append("the key must be lower-case letters, digits and underscores, starting with a letter")
        if not self.label.strip():
            out.append("a label is required")
        if self.kind not in ("sum", "avg", "count", "distinct", "ratio"):
            out.append(f"unknown kind {self.kind}")
        if self.format not in ("money", "number", "percent"):
            out.append(f"unknown format {self.format}")
        if (self.kind == "count") == bool(self.field):
            out.append("a count takes no field and every other kind needs one")
        if (self.kind == "ratio") != bool(self.denominator):
            out.append("a ratio, and only a ratio, has a denominator")
        if self.filter and (self.filter[1] not in ("eq", "ne", "gt", "gte", "lt", "lte") or self.filter[2] in (None, "")):
            out.append("a filter needs a known operator and a value")
        return out

    def column(self, schema: SchemaMap, name: str | None) -> str | None:
        return schema.get(name, name) if name else None

    def describe(self, schema: SchemaMap) -> str:
        field, below = self.column(schema, self.field), self.column(schema, self.denominator)
        text = {
            "count": "COUNT(rows)", "distinct": f"COUNT(DISTINCT {field})", "sum": f"SUM({field})",
            "avg": f"AVG({field})", "ratio": f"SUM({field}) / SUM({below})",
        }[self.kind]
        if self.kind == "ratio" and self.format == "percent":
            text += " x 100"
        if self.filter:
            text += f" WHERE {self.column(schema, self.filter[0])} {self.filter[1].upper()} {self.filter[2]}"
        return text


def metric_column(df: DataFrame, schema: SchemaMap, spec: MetricSpec, where: Column | None = None) -> Column:
    """The spec as one aggregate expression, optionally over the rows of a condition.

    A column the table does not have gives 0, and so does a filter on one.
    """
    problems = spec.problems()
    if problems:
        raise ValueError(f"metric {spec.key}: " + "; ".join(problems))
    keep = where if where is not None else F.lit(True)
    if spec.filter:
        keep = keep & row_condition(df, spec.column(schema, spec.filter[0]), spec.filter[1], spec.filter[2])
    if spec.kind == "count":
        return F.count_if(keep).cast("double")
    column = spec.column(schema, spec.field)
    if column not in df.columns:
        return F.max(F.lit(0.0))
    cell = F.col(quoted(column))
    if spec.kind == "distinct":
        return F.count_distinct(F.when(keep, F.lower(tidy_key(cell)))).cast("double")
    total = F.coalesce(exact_sum(F.when(keep, number(df, column))), F.lit(0.0))
    if spec.kind == "sum":
        return round2(total)
    if spec.kind == "avg":
        # Blank cells do not count as zeros.
        n = F.count_if(keep & ~is_blank(cell))
        filled = exact_sum(F.when(keep & ~is_blank(cell), number(df, column)))
        return F.when(n > 0, round2(filled / n)).otherwise(0.0)
    below = spec.column(schema, spec.denominator)
    if below not in df.columns:
        return F.max(F.lit(0.0))
    divisor = F.coalesce(F.sum(F.when(keep, number(df, below))), F.lit(0.0))
    ratio = total / divisor
    shown = round_half_up(ratio * 100, 1) if spec.format == "percent" else round_half_up(ratio, 2)
    return F.when(divisor != 0, shown).otherwise(0.0)


# --- key figures ------------------------------------------------------------------------------


def _customer(schema: SchemaMap) -> str | None:
    return schema.get("customer_id") or schema.get("customer_name")


_SIDES = (("value", "in_filter"), ("current", "is_current"), ("previous", "is_previous"))


def _figures(df, schema, filters, bounds, blank_counts: bool) -> DataFrame:
    """One row with the sums and both distinct counts on each side.

    Rows are summed per order and customer first, under their keys as they are stored; lines of an
    order mostly lie together, so little moves. Those sums then count once under the order and once
    under the customer: grouping by (kind, key) makes each key one row with its flags, and a count
    of flags is the distinct count. A hot key is one row per map task whenever it moves.
    """
    tagged = tag_periods(df, schema, filters, bounds)
    tidy = trimmed if blank_counts else tidy_key
    order, customer = schema.get("order_id"), _customer(schema)

    def stored(column):
        return F.col(quoted(column)) if column else F.lit(None).cast("string")

    def key_of(name, column):
        if column and isinstance(df.schema[column].dataType, T.StringType):
            return tidy(F.col(name))
        text = F.col(name).cast("string")
        return F.coalesce(text, F.lit("")) if blank_counts and column else text

    narrow = tagged.select(
        "in_filter", "is_current", "is_previous", row_revenue(df, schema).alias("revenue"), row_profit(df, schema).alias("profit"),
        stored(order).alias("order"), stored(customer).alias("customer"))
    pairs = narrow.groupBy("order", "customer").agg(
        *[exact_sum(F.when(F.col(flag), F.col(m)).otherwise(0.0)).alias(f"{m}_{s}") for m in ("revenue", "profit") for s, flag in _SIDES],
        *[F.count_if(flag).alias(f"rows_{s}") for s, flag in _SIDES])
    seen = [(F.col(f"rows_{s}") > 0).alias(f"seen_{s}") for s, _ in _SIDES]
    kinds = [F.struct(F.lit(kind).alias("kind"), key_of(kind, column).alias("key")) for kind, column in (("order", order), ("customer", customer)) if column]
    measures = [f"{m}_{s}" for m in ("revenue", "profit") for s, _ in _SIDES]
    sums = pairs.agg(*[exact_sum(c).alias(c) for c in measures], *[F.sum(f"rows_{s}").alias(f"rows_{s}") for s, _ in _SIDES])
    figures = []
    for s, _ in _SIDES:
        for kind, column in (("order", order), ("customer", customer)):
            figures.append(F.count_if((F.col("kind") == kind) & F.col(f"seen_{s}")).cast("double").alias(f"{kind}s_{s}"))
    if kinds:
        keyed = pairs.select(F.explode(F.array(*kinds)).alias("k"), *seen).select("k.*", *[f"seen_{s}" for s, _ in _SIDES]).where("key is not null")
        once = keyed.groupBy("kind", "key").agg(*[F.max(f"seen_{s}").alias(f"seen_{s}") for s, _ in _SIDES])
        counts = once.agg(*figures)
    else:
        counts = pairs.limit(0).select(F.lit("").alias("kind"), *seen).agg(*figures)
    one = sums.select("*", counts.select(F.struct("*")).scalar().alias("_c")).select("*", "_c.*").drop("_c")
    if not order:  # with no order column every row is an order
        one = one.withColumns({f"orders_{s}": F.coalesce(f"rows_{s}", F.lit(0)).cast("double") for s, _ in _SIDES})
    margin = F.when(F.col("revenue_value") != 0, F.col("profit_value") / F.col("revenue_value") * 100).otherwise(0.0)
    empty = F.lit(None).cast("double")
    return one.select("*", margin.alias("margin_value"), empty.alias("margin_current"), empty.alias("margin_previous"))


def _as_rows(one: DataFrame, figures: list[tuple[str, str, str]], first: int = 0) -> DataFrame:
    """A wide row of `<key>_<side>` columns as one row per figure."""
    return one.select(F.inline(F.array(*[
        F.struct(
            F.lit(first + i).alias("position"), F.lit(key).alias("kpi"), F.lit(label).alias("label"),
            F.lit(fmt).alias("format"),
            *[F.col(f"{key}_{s}").cast("double").alias(s) for s, _ in _SIDES],
        ) for i, (key, label, fmt) in enumerate(figures)
    ])))


# The built-in key figures.
KPIS = [("revenue", "Revenue", "money"), ("profit", "Profit", "money"), ("orders", "Orders", "number"),
        ("customers", "Customers", "number"), ("margin", "Margin", "percent")]


def kpi_table(
    df: DataFrame, schema: SchemaMap, filters: Filters = Filters(), compare: str = "previous_period",
    cal: Calendar = DEFAULT_CALENDAR, metrics: list[MetricSpec] = (), bounds: DataFrame | None = None,
) -> DataFrame:
    """One row per key figure: its value on the filtered rows and its change.

    Blank order and customer keys are not counted. `bounds` may come from a narrower
    frame of the same table.
    """
    bounds = bounds if bounds is not None else period_bounds(df, schema, filters, compare, cal)
    rows = _as_rows(_figures(df, schema, filters, bounds, blank_counts=False), KPIS)
    if metrics:
        tagged = tag_periods(df, schema, filters, bounds)
        columns = []
        for spec in metrics:
            for s, flag in _SIDES:
                shown = s == "value" or spec.kind != "ratio"  # a ratio shows no change
                figure = metric_column(df, schema, spec, F.col(flag)) if shown else F.max(F.lit(None).cast("double"))
                columns.append(figure.alias(f"{spec.key}_{s}"))
        own = [(m.key, m.label, m.format) for m in metrics]
        rows = rows.unionByName(_as_rows(tagged.agg(*columns), own, len(KPIS)))
    return rows.select(
        "position", "kpi", "label", "format", round2(F.coalesce("value", F.lit(0.0))).alias("value"),
        pct_change(F.col("current"), F.col("previous")).alias("change_pct"))


def overview(
    df: DataFrame, schema: SchemaMap, filters: Filters = Filters(), compare: str = "previous_period",
    cal: Calendar = DEFAULT_CALENDAR, bounds: DataFrame | None = None,
) -> DataFrame:
    """The four totals with what they were before; blank keys count as one value here."""
    bounds = bounds if bounds is not None else period_bounds(df, schema, filters, compare, cal)
    rows = _as_rows(_figures(df, schema, filters, bounds, blank_counts=True), KPIS)
    margin = F.col("kpi") == "margin"
    return rows.select(
        F.col("kpi").alias("measure"),
        F.when(margin, round_half_up(F.col("value"), 1)).otherwise(round2(F.col("value"))).alias("value"),
        round2(F.col("previous")).alias("previous"),
        pct_change(F.col("current"), F.col("previous")).alias("change_pct"))


# --- rankings and series ------------------------------------------------------------------------


def _aggregate(df: DataFrame, schema: SchemaMap, metric) -> Column:
    """A named metric, a user metric or a ready aggregate expression."""
    if isinstance(metric, MetricSpec):
        return metric_column(df, schema, metric)
    if isinstance(metric, Column):
        return metric
    return round2(exact_sum(row_value(df, schema, metric)))


def group_totals(df: DataFrame, schema: SchemaMap, dimension: str, metric="revenue",
                 filters: Filters = Filters()) -> DataFrame:
    column = schema.get(dimension, dimension)
    kept = apply_filters(df, schema, filters)
    return kept.groupBy(group_label(F.col(quoted(column))).alias("label")).agg(
        _aggregate(df, schema, metric).alias("value"))


def ranking(df: DataFrame, schema: SchemaMap, dimension: str, metric="revenue",
            filters: Filters = Filters(), limit: int | None = 10) -> DataFrame:
    """The top groups, all without a limit; equal values are ordered by label."""
    ordered = group_totals(df, schema, dimension, metric, filters).orderBy(F.desc("value"), "label")
    return ordered if limit is None else ordered.limit(limit)


def time_series(df: DataFrame, schema: SchemaMap, metric="revenue", filters: Filters = Filters(),
                cal: Calendar = DEFAULT_CALENDAR, grain: str = "period", by: list[str] = ()) -> DataFrame:
    """One value per period that has rows; periods without rows are absent.

    `by` gives one series per combination of those columns.
    """
    day = day_of(F.col(quoted(schema["date"])))
    kept = apply_filters(df, schema, filters).where(day.isNotNull())
    return kept.groupBy(*by, C.grain_key(day, cal, grain).alias("period")).agg(
        _aggregate(df, schema, metric).alias("value"))


def composition(df: DataFrame, schema: SchemaMap, dimension: str, filters: Filters = Filters(),
                limit: int | None = None) -> DataFrame:
    """The groups with their share of the whole; beyond a limit one row `(other)` holds the rest."""
    totals = group_totals(df, schema, dimension, "revenue", filters)
    one = totals.agg(exact_sum("value").alias("t"), F.count("*").alias("n"))
    whole = one.select("t").scalar()
    shown = totals
    if limit is not None:
        top = totals.orderBy(F.desc("value"), "label").limit(limit)
        rest = top.agg(exact_sum("value").alias("t")).select(
            F.lit("(other)").alias("label"), round2(whole - F.col("t")).alias("value"), one.select("n").scalar().alias("_n")).where(F.col("_n") > limit)
        shown = top.unionByName(rest.drop("_n"))
    return shown.select("label", "value", F.when(whole != 0, round_half_up(F.col("value") / whole * 100, 2)).alias("share_pct"))


def best_period(series: DataFrame, worst: bool = False) -> DataFrame:
    order = F.col("value").asc() if worst else F.col("value").desc()
    return series.orderBy(order, "period").limit(1)


def distinct_values(df: DataFrame, schema: SchemaMap, dimension: str, limit: int | None = None) -> DataFrame:
    """The values of a dimension in order, all of them without a limit."""
    value = tidy_key(F.col(quoted(schema.get(dimension, dimension))))
    found = df.select(value.alias("value")).where("value is not null").distinct()
    return found if limit is None else found.orderBy("value").limit(limit)


def value_inclusion(df: DataFrame, kind: str, sources: list[str]) -> DataFrame:
    """How many rows a metric can use: rows, missing, not numeric, included."""
    if not sources:
        included = F.count("*") if kind in ("distinct", "count") else F.max(F.lit(0)).cast("bigint")
        zero = F.max(F.lit(0)).cast("bigint")
        return df.agg(F.count("*").alias("n"), zero.alias("missing"), zero.alias("non_numeric"), included.alias("included"))
    cells = [F.col(quoted(c)) for c in sources]
    missing = F.lit(True)
    for c in cells:
        missing = missing & is_blank(c)
    unreadable = F.lit(False)
    if kind in ("sum", "avg", "ratio"):
        for c in cells:
            unreadable = unreadable | (~is_blank(c) & plain_number(c).isNull())
    one = df.select(missing.alias("m"), (~missing & unreadable).alias("u")).agg(
        F.count("*").alias("n"), F.count_if("m").alias("missing"), F.count_if("u").alias("non_numeric"))
    return one.select("*", (F.col("n") - F.col("missing") - F.col("non_numeric")).alias("included"))


# --- industry metrics: functions from columns to an aggregate expression -------------------------


def mrr(df: DataFrame, schema: SchemaMap) -> Column:
    named = [c for c in df.columns if re.search(r"^mrr$|monthly.*recurr|subscription.*revenue", c, re.I)]
    return round2(exact_sum(number(df, named[0]) if named else row_revenue(df, schema)))


def arpu(df: DataFrame, schema: SchemaMap) -> Column:
    customer = _customer(schema)
    if not customer:
        return F.max(F.lit(0.0))
    customers = F.count_distinct(trimmed(F.col(quoted(customer))))
    return F.when(customers > 0, round2(exact_sum(row_revenue(df, schema)) / customers)).otherwise(0.0)


def _ratio(top: Column, below: Column, factor: float, places: int) -> Column:
    return F.when(F.sum(below) != 0, round_half_up(F.sum(top) / F.sum(below) * factor, places)).otherwise(0.0)


def utilisation(billable: Column, hours: Column) -> Column:
    return _ratio(billable, hours, 100.0, 1)


def average_rate(revenue: Column, billable: Column) -> Column:
    return _ratio(revenue, billable, 1.0, 2)


def defect_rate(defects: Column, produced: Column) -> Column:
    return _ratio(defects, produced, 100.0, 1)


def expiry_risk(df: DataFrame, date: str, expiry: str) -> DataFrame:
    """Share of rows that expire within the 90 days up to the latest date of the table."""
    latest = df.agg(F.max(day_of(F.col(quoted(date))))).scalar()
    day = day_of(F.col(quoted(expiry)))
    at_risk = F.coalesce(day.between(F.date_sub(latest, 90), latest), F.lit(False))
    return df.select(at_risk.alias("r")).agg(
        F.count("*").alias("n"), F.count_if("r").alias("at_risk"),
        round_half_up(F.count_if("r") / F.count("*") * 100, 1).alias("expiry_risk_pct"))


def halfway_day(df: DataFrame, date: str) -> DataFrame:
    """The date of the row in the middle when rows are sorted by date.

    Found on one count per day: the running total over days passes the middle there.
    """
    daily = df.groupBy(day_of(F.col(quoted(date))).alias("day")).agg(F.count("*").alias("n")).where("day is not null")
    # One row per day of the data, so this running total is short however large the table is.
    running = daily.select("day", F.sum("n").over(Window.orderBy("day")).alias("upto"),
                           F.sum("n").over(Window.partitionBy(F.lit(1))).alias("total"))
    return running.where(F.col("upto") > F.floor(F.col("total") / 2)).agg(
        F.min("day").alias("day"), F.max("total").alias("total"))


def _halves(df: DataFrame, schema: SchemaMap) -> DataFrame:
    """Per customer: seen before the halfway day, seen from it on."""
    middle = halfway_day(df, schema["date"]).select(F.struct("*").alias("m")).scalar()
    day = day_of(F.col(quoted(schema["date"])))
    dated = df.where(day.isNotNull()).select(
        trimmed(F.col(quoted(schema["customer_id"]))).alias("customer"),
        (day < middle["day"]).alias("early"), (middle["total"] >= 4).alias("enough"))
    return dated.groupBy("customer").agg(
        F.bool_or("early").alias("early"), F.bool_or(~F.col("early")).alias("late"), F.max("enough").alias("enough"))


def lapsed_customers(df: DataFrame, schema: SchemaMap) -> DataFrame:
    """Customers of the first half who are absent from the second.

    Both halves are flags of one grouped pass, which is the anti-join without joining.
    """
    return _halves(df, schema).where("early and not late").select("customer")


def observed_churn(df: DataFrame, schema: SchemaMap) -> DataFrame:
    halves = _halves(df, schema)
    one = halves.agg(
        F.count_if("early").alias("customers"),
        F.count_if(F.col("early") & ~F.col("late")).alias("lapsed"),
        F.bool_or("enough").alias("enough"))
    rate = round_half_up(F.col("lapsed") / F.col("customers") * 100, 1)
    return one.select("customers", "lapsed",
                      F.when(F.col("enough") & (F.col("customers") > 0), rate).otherwise(0.0).alias("churn_pct"))


def low_inventory(df: DataFrame, product: str, inventory: str, below: float = 20.0) -> DataFrame:
    lowest = df.groupBy(trimmed(F.col(quoted(product))).alias("label")).agg(F.min(number(df, inventory)).alias("value"))
    return lowest.where(F.col("value") < below).orderBy("value", "label")
