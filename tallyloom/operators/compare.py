"""Which days are compared with which, and tagging rows with their side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.context import DEFAULT_CALENDAR, Calendar, Filters, SchemaMap
from tallyloom.functions.dates import day_of
from tallyloom.functions.numbers import all_of, exact_sum, pct_change, round2
from tallyloom.functions.strings import group_label
from tallyloom.operators.filters import date_condition, filter_condition
from tallyloom.operators.formats import quoted

MIN_DATED_ROWS = 4
RETAIL_YEAR_DAYS = 364


def period_bounds(
    df: DataFrame, schema: SchemaMap, filters: Filters = Filters(),
    compare: str = "previous_period", cal: Calendar = DEFAULT_CALENDAR,
) -> DataFrame:
    """One row: the current and the previous window, or the reason there is no comparison.

    The table is reduced to one count per day first, so everything after that handles at
    most as many rows as the data has days. `df` needs only the date column and the
    columns the filters name; pass a narrow frame to keep wide joins out of this step.
    """
    if not schema.get("date"):
        return _bounds_row(df.sparkSession.range(1), F.lit("no_date_column"))

    day = day_of(F.col(quoted(schema["date"])))
    scope = df.where(filter_condition(schema, filters.without_dates()))
    daily = scope.groupBy(day.alias("day")).agg(F.count("*").alias("n")).where("day is not null")
    inside = all_of(
        ([F.col("day") >= F.lit(filters.date_from).cast("date")] if filters.date_from else [])
        + ([F.col("day") <= F.lit(filters.date_to).cast("date")] if filters.date_to else [])
    )
    span = daily.agg(
        F.min(F.when(inside, F.col("day"))).alias("lo"),
        F.max(F.when(inside, F.col("day"))).alias("hi"),
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("dated"),
        F.collect_list("day").alias("days"),
    )
    filtered = bool(filters.date_from or filters.date_to)
    if filtered:
        start = F.lit(filters.date_from).cast("date") if filters.date_from else F.col("lo")
        end = F.lit(filters.date_to).cast("date") if filters.date_to else F.col("hi")
        enough = F.lit(True) if filters.date_from and filters.date_to else F.col("dated") > 0
    else:
        # Halved in whole days; an odd day is left out at the old end.
        half = F.floor((F.datediff("hi", "lo") + 1) / 2).cast("int")
        start, end = F.date_sub("hi", half - 1), F.col("hi")
        enough = (F.col("dated") >= MIN_DATED_ROWS) & (half > 0)
    current = span.select("days", start.alias("start"), end.alias("end"), enough.alias("enough"))

    length = F.datediff("end", "start") + 1
    if compare == "previous_year" and cal.is_retail:
        before, until = F.date_sub("start", RETAIL_YEAR_DAYS), F.date_sub("end", RETAIL_YEAR_DAYS)
    elif compare == "previous_year":
        # The day after the window moves a year too, so a leap day changes the length.
        before = F.add_months("start", -12)
        until = F.date_sub(F.add_months(F.date_add("end", 1), -12), 1)
    else:
        before, until = F.date_sub("start", length), F.date_sub("start", 1)
    windows = current.select("*", before.alias("before"), until.alias("until"))
    usable = F.col("enough") & (F.col("end") >= F.col("start")) & (F.col("until") >= F.col("before"))
    has_prior = F.exists("days", lambda d: (d >= F.col("before")) & (d <= F.col("until")))
    reason = F.when(~F.coalesce(usable, F.lit(False)), "insufficient_history").when(~has_prior, "no_prior_data")
    basis = "same_period_last_year" if compare == "previous_year" else "trailing_equal_period"
    return _bounds_row(windows, reason, basis, "filter" if filtered else "trailing_half")


def _bounds_row(df: DataFrame, reason: Column, basis: str = "unavailable", source: str | None = None) -> DataFrame:
    def when_usable(name):
        value = F.col(name) if name in df.columns else F.lit(None)
        return F.when(reason.isNull(), value.cast("date"))

    return df.select(
        F.when(reason.isNull(), F.lit(basis)).otherwise("unavailable").alias("basis"),
        reason.alias("reason"),
        F.when(reason.isNull(), F.lit(source)).alias("current_source"),
        when_usable("start").alias("current_from"),
        when_usable("end").alias("current_to"),
        when_usable("before").alias("previous_from"),
        when_usable("until").alias("previous_to"),
    )


def tag_periods(df: DataFrame, schema: SchemaMap, filters: Filters, bounds: DataFrame) -> DataFrame:
    """The rows of the comparison universe with `in_filter`, `is_current` and `is_previous`.

    The one-row bounds are read as a scalar subquery, so the whole stays one lazy plan.
    """
    scope = df.where(filter_condition(schema, filters.without_dates()))
    if not schema.get("date"):
        return scope.select("*", F.lit(True).alias("in_filter"), F.lit(True).alias("is_current"),
                            F.lit(False).alias("is_previous"))
    window = bounds.select(F.struct("*").alias("w")).scalar()
    day = day_of(F.col(quoted(schema["date"])))
    kept = date_condition(schema, filters)
    held = scope.select("*", kept.alias("in_filter"), day.alias("_day"), window.alias("_w"))

    def within(side):
        return F.coalesce(F.col("_day").between(F.col(f"_w.{side}_from"), F.col(f"_w.{side}_to")), F.lit(False))

    # Without a comparison every filtered row counts as current.
    current = F.when(F.col("_w.reason").isNotNull(), F.lit(True)).otherwise(within("current"))
    return held.select(
        *[F.col(quoted(c)) for c in df.columns], "in_filter",
        (F.col("in_filter") & current).alias("is_current"), within("previous").alias("is_previous"),
    )


def change_by_group(df: DataFrame, schema: SchemaMap, dimension: str, value: Column, bounds: DataFrame) -> DataFrame:
    """Change in percent for every group that had a positive value before.

    Both windows are summed in one pass by condition instead of joining two aggregates.
    """
    tagged = tag_periods(df, schema, Filters(), bounds)
    label = group_label(F.col(quoted(schema.get(dimension, dimension))))
    comparable = tagged.where("is_current or is_previous")
    totals = comparable.groupBy(label.alias("label")).agg(
        round2(exact_sum(F.when(F.col("is_current"), value))).alias("current"),
        round2(exact_sum(F.when(F.col("is_previous"), value))).alias("previous"),
    )
    return totals.where((F.col("previous") > 0) & F.col("current").isNotNull()).select(
        "label", "current", "previous", pct_change(F.col("current"), F.col("previous")).alias("change_pct"))


def declining(changes: DataFrame, at_most: float = -10.0) -> DataFrame:
    return changes.where(F.col("change_pct") <= at_most).orderBy("change_pct", "label")


def growing(changes: DataFrame, at_least: float = 10.0) -> DataFrame:
    return changes.where(F.col("change_pct") >= at_least).orderBy(F.desc("change_pct"), "label")


def series_change(series: DataFrame, by: list[str] = ()) -> DataFrame:
    """Each period of a series next to the one before it."""
    order = Window.partitionBy(*by or [F.lit(1)]).orderBy("period")
    return series.withColumn("previous", F.lag("value").over(order)).withColumn(
        "change_pct", pct_change(F.col("value"), F.col("previous")))
