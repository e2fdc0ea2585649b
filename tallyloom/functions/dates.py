"""Reading dates out of text.

Clock times are resolved in the session time zone, which the package keeps at UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tallyloom.functions.strings import trim_space

# The shapes a written date can take.
ISO_SHAPE = r"^([0-9]{4})[-/]([0-9]{1,2})[-/]([0-9]{1,2})([T ].*)?$"
PARTS_SHAPE = r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2,4})([T ].*)?$"
CLOCK_SHAPE = r"[0-9][T ][0-9]{1,2}:[0-9]{2}"
NAMED_MONTH_SHAPE = r"(?i)^([0-9]{1,2}[-/ ])?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[-/ ,]+[0-9]"


def day_of(value: Column) -> Column:
    """The calendar day of a date, timestamp or ISO text cell; null when unreadable."""
    return value.try_cast("date")


def looks_like_date(value: Column) -> Column:
    s = trim_space(value)
    # each shape has one of these marks; most other cells have not, and a pattern costs far more than a mark
    return (s.contains("-") | s.contains("/")) & (
        s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}")
        | s.rlike(r"^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}")
        | (s.rlike(ISO_SHAPE) | (s.rlike(NAMED_MONTH_SHAPE) & s.rlike("[/-]")))
    )


def is_date_shaped(value: Column) -> Column:
    s = trim_space(value)
    return s.rlike(ISO_SHAPE) | s.rlike(PARTS_SHAPE) | names_clock(s)


def names_clock(text: Column) -> Column:
    """Whether a time of day stands in the text."""
    return text.contains(":") & text.rlike(CLOCK_SHAPE)


def date_evidence(value: Column) -> Column:
    """'iso', 'dmy', 'mdy' or 'undecided' for one written date, null otherwise."""
    s = trim_space(value)
    above, within = "(1[3-9]|[2-9][0-9])", "(0?[0-9]|1[0-2])"
    rest = r"[-/.][0-9]{2,4}([T ].*)?$"
    return (
        F.when(s.rlike(ISO_SHAPE), "iso")
        .when(~s.rlike(PARTS_SHAPE), F.lit(None).cast("string"))
        .when(s.rlike(f"^{above}[-/.]{within}{rest}"), "dmy")
        .when(s.rlike(f"^{within}[-/.]{above}{rest}"), "mdy")
        .when(s.rlike(PARTS_SHAPE), "undecided")
    )


def zoned_day(instant: Column, zone: str | Column) -> Column:
    """The calendar day an instant falls on in a zone."""
    return F.to_date(F.from_utc_timestamp(instant.try_cast("timestamp"), zone))


def known_zone(zone: str) -> str:
    """The zone itself, or UTC when it names nothing."""
    from zoneinfo import ZoneInfo

    try:
        ZoneInfo(zone)
        return zone
    except Exception:  # an unknown or malformed name
        return "UTC"


def to_iso_date(value: Column, order: str | Column = "mdy", zone: str = "UTC") -> Column:
    """`YYYY-MM-DD` under a column's field order, or null when it is not a real day."""
    s = trim_space(value)
    order = order if isinstance(order, Column) else F.lit(order)

    def year_first(year_pattern: str, century: str) -> tuple[str, Column]:
        shape = f"^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]({year_pattern})([T ].*)?$"
        turned = F.when(order == "dmy", f"{century}$3-$2-$1").otherwise(f"{century}$3-$1-$2")
        return shape, F.regexp_replace(s, F.lit(shape), turned)

    text = F.when(s.rlike(ISO_SHAPE), F.regexp_replace(s, ISO_SHAPE, "$1-$2-$3"))
    # Two-digit years below 70 belong to this century.
    for year_pattern, century in (("[0-9]{4}", ""), ("[0-9]{3}", "0"), ("[0-6][0-9]", "20"), ("[7-9][0-9]", "19")):
        shape, turned = year_first(year_pattern, century)
        text = text.when(s.rlike(shape), turned)
    # no shape begins otherwise
    written = F.when(s.rlike("^[0-9]{1,4}[-/.]"), text).try_cast("date")
    clock = F.when(names_clock(s), zoned_day(s, known_zone(zone)))
    return F.coalesce(clock, written).cast("string")
