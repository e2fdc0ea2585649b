"""Fiscal years and retail periods as column expressions.

A key is `YYYY-MM` under calendar months and `FYyyyy-Pnn` under a retail scheme; coarser
grains are `yyyy`, `yyyy-Qn`, `FYyyyy` and `FYyyyy-Qn`. Within one calendar the keys sort
in time order.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.context import DEFAULT_CALENDAR, Calendar

GRAINS = ["year", "quarter", "period"]


def retail_year_start(year: Column, cal: Calendar) -> Column:
    """The first chosen weekday on or after the first of the opening month."""
    anchor = F.make_date(year, F.lit(cal.fiscal_year_start_month), F.lit(1))
    # dayofweek counts from 1 = Sunday.
    shift = F.pmod(F.lit(cal.week_start_day + 1) - F.dayofweek(anchor), F.lit(7))
    return F.date_add(anchor, shift)


def fiscal_year(day: Column, cal: Calendar) -> Column:
    """Labelled by the calendar year the fiscal year opens in."""
    if cal.is_retail:
        opened = day >= retail_year_start(F.year(day), cal)
    else:
        opened = F.month(day) >= cal.fiscal_year_start_month
    return F.when(opened, F.year(day)).otherwise(F.year(day) - 1)


def retail_period_number(day: Column, cal: Calendar) -> Column:
    start = retail_year_start(fiscal_year(day, cal), cal)
    # Week of the year -> period; a 53rd week belongs to the last period.
    of_week = [p for p, weeks in enumerate(cal.weeks, start=1) for _ in range(weeks)] + [12, 12]
    return F.get(F.array(*[F.lit(p) for p in of_week]), F.floor(F.datediff(day, start) / 7).cast("int"))


def grain_key(day: Column, cal: Calendar = DEFAULT_CALENDAR, grain: str = "period") -> Column:
    year = fiscal_year(day, cal).cast("string")
    if not cal.is_retail:
        if grain == "period":
            return F.date_format(day, "yyyy-MM")
        if grain == "year":
            return year
        elapsed = (F.year(day) - fiscal_year(day, cal)) * 12 + F.month(day) - cal.fiscal_year_start_month
        return F.concat(year, F.lit("-Q"), (F.floor(elapsed / 3) + 1).cast("string"))
    label = F.concat(F.lit("FY"), year)
    if grain == "year":
        return label
    period = retail_period_number(day, cal)
    if grain == "quarter":
        return F.concat(label, F.lit("-Q"), F.ceil(period / 3).cast("string"))
    return F.concat(label, F.lit("-P"), F.lpad(period.cast("string"), 2, "0"))


def period_key(day: Column, cal: Calendar = DEFAULT_CALENDAR) -> Column:
    return grain_key(day, cal, "period")


def grain_of(key: Column) -> Column:
    return (
        F.when(key.rlike(r"^(FY)?[0-9]{4}$"), "year")
        .when(key.rlike(r"^(FY)?[0-9]{4}-Q[1-4]$"), "quarter")
        .when(key.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$") | key.rlike(r"^FY[0-9]{4}-P(0[1-9]|1[0-2])$"), "period")
    )


def _year_of_key(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"^(?:FY)?([0-9]{4})", 1), F.lit("")).try_cast("int")


def _number_of_key(key: Column) -> Column:
    return F.nullif(F.regexp_extract(key, r"-[QP]?([0-9]{1,2})$", 1), F.lit("")).try_cast("int")


def _range(key: Column, year: Column, n: Column, year_start: Column | None, next_start: Column | None,
           cal: Calendar) -> tuple[Column, Column]:
    opens = F.make_date(year, F.lit(cal.fiscal_year_start_month), F.lit(1))
    whole_year, quarter = key.rlike("^[0-9]{4}$"), key.rlike("^[0-9]{4}-Q[1-4]$")
    month = key.rlike("^[0-9]{4}-(0[1-9]|1[0-2])$")
    first = (
        F.when(whole_year, opens)
        .when(quarter, F.add_months(opens, (n - 1) * 3))
        .when(month, F.make_date(year, F.least(F.greatest(n, F.lit(1)), F.lit(12)), F.lit(1)))
    )
    length = F.when(whole_year, 12).when(quarter, 3).otherwise(1)
    last = F.date_sub(F.add_months(first, length), 1)
    if not cal.is_retail:
        return first, last

    starts = F.array(*[F.lit(w) for w in [0, *accumulate(cal.weeks)]])
    retail = key.startswith("FY")
    # The first and last period (1 to 12) the key spans.
    opening = F.when(key.rlike("-Q[1-4]$"), n * 3 - 2).when(key.rlike("-P(0[1-9]|1[0-2])$"), n).when(
        key.rlike("^FY[0-9]{4}$"), 1)
    closing = F.when(key.rlike("-Q[1-4]$"), n * 3).when(key.rlike("-P(0[1-9]|1[0-2])$"), n).when(
        key.rlike("^FY[0-9]{4}$"), 12)
    retail_first = F.date_add(year_start, 7 * F.get(starts, opening - 1))
    # Period 12 ends where the next year opens, which takes in a 53rd week.
    retail_last = F.date_sub(
        F.when(closing == 12, next_start).otherwise(F.date_add(year_start, 7 * F.get(starts, closing))), 1)
    return F.when(retail, retail_first).otherwise(first), F.when(retail, retail_last).otherwise(last)


def period_bounds(key: Column, cal: Calendar = DEFAULT_CALENDAR) -> tuple[Column, Column]:
    """The first and last day a key covers; null for a key this calendar does not write."""
    year = _year_of_key(key)
    starts = (retail_year_start(year, cal), retail_year_start(year + 1, cal)) if cal.is_retail else (None, None)
    return _range(key, year, _number_of_key(key), *starts, cal)


def with_period_range(df: DataFrame, key: str, cal: Calendar = DEFAULT_CALENDAR) -> DataFrame:
    """`period_from` and `period_to` of every key of a table, with the year taken apart once."""
    k = F.col(key)
    parts = df.select("*", _year_of_key(k).alias("_year"), _number_of_key(k).alias("_n"))
    year, starts = F.col("_year"), (None, None)
    if cal.is_retail:
        parts = parts.select("*", retail_year_start(year, cal).alias("_open"),
                             retail_year_start(year + 1, cal).alias("_next"))
        starts = (F.col("_open"), F.col("_next"))
    first, last = _range(k, year, F.col("_n"), *starts, cal)
    return parts.select(*df.columns, first.alias("period_from"), last.alias("period_to"))


def period_index(key: Column) -> Column:
    """The 1-based place of a period key in its year."""
    shape = r"^(?:FY[0-9]{4}-P|[0-9]{4}-)([0-9]{2})$"
    return F.nullif(F.regexp_extract(key, shape, 1), F.lit("")).try_cast("int")


def next_period(key: Column) -> Column:
    index, year = period_index(key), _year_of_key(key)
    wraps = index >= 12
    retail = key.startswith("FY")
    next_year = F.lpad(F.when(wraps, year + 1).otherwise(year).cast("string"), 4, "0")
    next_index = F.lpad(F.when(wraps, 1).otherwise(index + 1).cast("string"), 2, "0")
    mark = F.when(retail, F.lit("-P")).otherwise(F.lit("-"))
    prefix = F.when(retail, F.lit("FY")).otherwise(F.lit(""))
    return F.concat(prefix, next_year, mark, next_index)


# Short month names.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def period_label(key: Column, cal: Calendar = DEFAULT_CALENDAR) -> Column:
    fiscal = cal.fiscal_year_start_month != 1
    year = F.substring(key, 1, 4)
    month = F.regexp_extract(key, r"^[0-9]{4}-([0-9]{2})$", 1).try_cast("int")
    names = F.array(*[F.lit(m) for m in MONTHS])
    retail = F.concat(
        F.substring(key, 1, 6),
        F.when(F.length(key) > 6, F.concat(F.lit(" "), F.substring(key, 8, 1), _number_of_key(key).cast("string")))
        .otherwise(F.lit("")),
    )
    quarter = (
        F.concat(F.lit("FY"), year, F.lit(" "), F.substring(key, 6, 2)) if fiscal
        else F.concat(F.substring(key, 6, 2), F.lit(" "), year)
    )
    return (
        F.when(key.rlike(r"^FY[0-9]{4}(-[PQ][0-9]{1,2})?$"), retail)
        .when(key.rlike(r"^[0-9]{4}-Q[1-4]$"), quarter)
        .when(key.rlike(r"^[0-9]{4}-(0[1-9]|1[0-2])$"),
              F.concat(F.get(names, F.greatest(month, F.lit(1)) - 1), F.lit(" "), year))
        .when(key.rlike(r"^[0-9]{4}$"), F.concat(F.lit("FY"), year) if fiscal else year)
        .otherwise(key)
    )


def calendar_dimension(days: DataFrame, day: str, cal: Calendar = DEFAULT_CALENDAR) -> DataFrame:
    """One row per day over the span of `days`, with every key of the calendar.

    Its size is the number of days in the span, whatever the size of the fact table.
    """
    span = days.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    each = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))
    keyed = each.select(
        "day",
        fiscal_year(F.col("day"), cal).alias("fiscal_year"),
        grain_key(F.col("day"), cal, "year").alias("year_key"),
        grain_key(F.col("day"), cal, "quarter").alias("quarter_key"),
        grain_key(F.col("day"), cal, "period").alias("period"),
    ).select(
        "*",
        period_index(F.col("period")).alias("period_index"),
        period_label(F.col("period"), cal).alias("period_label"),
    )
    return with_period_range(keyed, "period", cal)
