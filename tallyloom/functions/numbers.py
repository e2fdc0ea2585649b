"""Reading numbers out of text, and the rounding rules every result uses."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from tallyloom.functions.strings import trim_space

# The symbols and space characters that may surround a written number.
CURRENCY_SYMBOLS = "$€£₹¥₽₩﷼"
SPACE_CHARACTERS = " \t\n\r\f\u000b\u00a0\u202f\u2009"

# A plain written number: no grouping, optional exponent.
PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _to_double(text: Column) -> Column:
    """A plain number as a double, anything else null.

    The pattern goes first: a failing cast costs far more than a failing match.
    """
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double"))


def _without(text: Column, characters: str) -> Column:
    """The text without these characters.

    Most texts hold none of them, and looking for them costs far less than copying a text.
    """
    return F.when(text.rlike("[" + "".join(map(re.escape, characters)) + "]"), F.translate(text, characters, "")).otherwise(text)


def round2(value: Column) -> Column:
    """Two decimals, halves up: floor(x * 100 + 0.5) / 100.

    Amounts are decimals of six places; what a sum of doubles adds beyond them is noise that
    depends on the order of the partitions, and goes first.
    """
    value = F.round(value.cast("double"), 6)
    # floor() yields a 64-bit integer; beyond that range doubles carry no cents anyway.
    return F.when(F.abs(value) < 9e13, F.floor(value * 100 + 0.5) / 100).otherwise(F.round(value, 2))


#: From here on doubles hold no places after the point.
WHOLE = float(2**53)


def exact_sum(value: Column | str) -> Column:
    """The sum of amounts with six places, the same in whatever order rows come.

    Whole units and millionths are summed as 64-bit integers, which neither round nor depend on
    an order. Amounts beyond 2 ** 53, which have no places left, are summed as they are. Values
    that are no finite number take no part; a sum of units beyond 64 bits is an error.
    """
    value = (F.col(value) if isinstance(value, str) else value).try_cast("double")
    valid = F.abs(value) < float("inf")  # false for NaN, which is above all numbers
    fine = valid & (F.abs(value) < WHOLE)
    units = F.floor(value)
    millionths = F.floor((value - units) * 1e6 + 0.5).cast("bigint")
    zero = F.lit(0).cast("bigint")
    whole = F.sum(F.when(fine, units).when(valid, zero))
    parts = F.sum(F.when(fine, millionths).when(valid, zero))
    large = F.sum(F.when(valid & ~fine, value).otherwise(0.0))
    carried = F.floor(parts / 1_000_000)
    return (whole + carried).cast("double") + (parts - carried * 1_000_000) / 1e6 + large


def round_half_up(value: Column, places: int) -> Column:
    factor = float(10**places)
    return F.floor(value * factor + 0.5) / factor


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent with one decimal; null where there is nothing to compare with."""
    share = (current - previous) / F.abs(previous)
    return F.when(previous != 0, F.floor(share * 1000 + 0.5) / 10)


def parse_number(value: Column, decimal: str | Column = ".") -> Column:
    """A written number under a column's decimal mark; null when it is not one.

    Signs and brackets around the digits are read as a group: `(5)`, `5-` and `-5` are
    negative and a second marker flips the sign back. `decimal` may be a column, so that
    a detected format can be applied without a trip to the driver.
    """
    text = _without(value.cast("string"), SPACE_CHARACTERS + CURRENCY_SYMBOLS)
    # Grouping marks may only stand before the decimal mark, so the pattern itself
    # refuses a number written the other way round.
    with_dot = _without(F.regexp_extract(text, r"^[-+(]*([0-9,]*\.?[0-9]*)%?[-)]*$", 1), ",")
    with_comma = F.translate(
        F.translate(F.regexp_extract(text, r"^[-+(]*([0-9.]*,?[0-9]*)%?[-)]*$", 1), ".", ""), ",", "."
    )
    if isinstance(decimal, Column):
        digits = F.when(decimal == ",", with_comma).otherwise(with_dot)
    else:
        digits = with_comma if decimal == "," else with_dot
    flips = F.length(text) - F.length(_without(text, "(-"))
    balanced = F.length(_without(text, "(")) == F.length(_without(text, ")"))
    sign = F.when(flips % 2 == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    # -0.0 and 0.0 are one value everywhere else, so they are one here.
    return F.when(digits.rlike("[0-9]") & balanced, sign * digits.try_cast("double") + 0.0)


def number_or_zero(value: Column, decimal: str | Column = ".") -> Column:
    return F.coalesce(parse_number(value, decimal), F.lit(0.0))


def plain_number(value: Column) -> Column:
    """The reading a profile uses: symbols, commas and brackets dropped, sign kept as written."""
    return _to_double(trim_space(_without(value.cast("string"), "$€£₹,()")))


def lenient_number(value: Column) -> Column:
    """The model inputs' reading: exponents survive, stray words go, brackets are negative."""
    text = trim_space(value.cast("string"))
    direct = _to_double(text)
    kept = F.regexp_replace(text, r"[^0-9eE+\-.()]", "")
    found = _to_double(F.regexp_extract(kept, r"([-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?)", 1))
    bracketed = text.rlike(r"\(.*[0-9].*\)")
    return F.coalesce(direct, F.when(bracketed, -F.abs(found)).otherwise(found))


def association_number(value: Column) -> Column:
    """The correlation reading: null for blanks and text, never zero."""
    text = value.cast("string")
    negative = text.rlike(r"^\s*[$€£₹]?\s*\(.*\)\s*%?\s*$")
    number = _to_double(F.regexp_replace(F.translate(text, "$€£₹,()%", ""), r"\s", ""))
    return F.when(negative, -number).otherwise(number)


def is_blank(value: Column) -> Column:
    return value.isNull() | (trim_space(value.cast("string")) == "")


# --- which way a column writes its numbers ---------------------------------------------


def _bare(value: Column) -> Column:
    return trim_space(_without(value.cast("string"), CURRENCY_SYMBOLS + "()"))


def number_evidence(value: Column) -> Column:
    """'comma', 'dot' or 'space' where one value proves how its column is written, else null.

    Three digits after a single separator could be a group or decimals, so they prove nothing.
    """
    s = _bare(value)
    return (
        F.when(~s.rlike("[0-9]"), F.lit(None).cast("string"))
        .when(s.contains(",") & s.contains("."), F.when(s.rlike(",[^.,]*$"), "comma").otherwise("dot"))
        .when(s.rlike(",.*,"), "dot")
        .when(s.rlike(r"\..*\."), "comma")
        .when(s.rlike(",([0-9]{1,2}|[0-9]{4,})$"), "comma")
        .when(s.rlike(r"\.([0-9]{1,2}|[0-9]{4,})$"), "dot")
        .when(s.rlike("^[0-9]{1,3}([" + SPACE_CHARACTERS + "][0-9]{3})+$"), "space")
    )


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
