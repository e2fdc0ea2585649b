"""Currencies and how amounts are printed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyloom.functions.strings import trimmed

# Code, symbol, name, digit-grouping locale.
CURRENCIES = [
    ("USD", "$", "US Dollar", "en-US"),
    ("INR", "₹", "Indian Rupee", "en-IN"),
    ("EUR", "€", "Euro", "de-DE"),
    ("GBP", "£", "British Pound", "en-GB"),
    ("AED", "AED", "UAE Dirham", "en-AE"),
    ("SGD", "S$", "Singapore Dollar", "en-SG"),
    ("AUD", "A$", "Australian Dollar", "en-AU"),
    ("CAD", "C$", "Canadian Dollar", "en-CA"),
    ("JPY", "¥", "Japanese Yen", "ja-JP"),
    ("CHF", "CHF", "Swiss Franc", "de-CH"),
    ("CNY", "¥", "Chinese Yuan", "zh-CN"),
    ("ZAR", "R", "South African Rand", "en-ZA"),
    ("BRL", "R$", "Brazilian Real", "pt-BR"),
    ("MXN", "MX$", "Mexican Peso", "es-MX"),
    ("NZD", "NZ$", "New Zealand Dollar", "en-NZ"),
    ("SEK", "kr", "Swedish Krona", "sv-SE"),
]
DEFAULT_CURRENCY = "USD"

# The digit-group separator each locale writes. The Indian one groups 3 then 2s.
GROUP_MARK = {
    "en-US": ",", "en-IN": ",", "de-DE": ".", "en-GB": ",", "en-AE": ",", "en-SG": ",",
    "en-AU": ",", "en-CA": ",", "ja-JP": ",", "de-CH": "\u2019", "zh-CN": ",", "en-ZA": "\u00a0",
    "pt-BR": ".", "es-MX": ",", "en-NZ": ",", "sv-SE": "\u00a0",
}


def currencies(spark) -> DataFrame:
    """The currency table: a fixed 16 rows, small enough to broadcast by construction."""
    rows = [(c, s, n, loc, GROUP_MARK[loc], loc == "en-IN") for c, s, n, loc in CURRENCIES]
    return spark.createDataFrame(
        rows, "code string, symbol string, currency_name string, locale string, group_mark string, lakh boolean"
    )


def with_currency(df: DataFrame, code: str) -> DataFrame:
    """Attach each row's currency; an unknown or missing code reads as US dollars."""
    table = currencies(df.sparkSession)
    known = [c for c, *_ in CURRENCIES]
    wanted = F.upper(trimmed(F.col(code)))
    resolved = F.when(wanted.isin(known), wanted).otherwise(F.lit(DEFAULT_CURRENCY))
    return (
        df.withColumn("_code", resolved)
        .join(F.broadcast(table), F.col("_code") == F.col("code"), "left")
        .drop("_code")
    )


def _whole(value: Column) -> Column:
    """Rounded to a whole amount, halves up; anything that is not finite is zero."""
    x = value.cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(finite, F.floor(x + 0.5)).otherwise(F.lit(0).cast("bigint"))


def grouped_digits(whole: Column, group_mark: Column, lakh: Column) -> Column:
    """A non-negative whole number with its digits grouped the locale's way."""
    western = F.translate(F.format_number(whole, 0), ",", "|")
    text = whole.cast("string")
    head = text.substr(F.lit(1), F.greatest(F.length(text) - 3, F.lit(0)))
    tail = F.when(F.length(text) > 3, F.concat(F.lit("|"), text.substr(F.length(text) - 2, F.lit(3)))).otherwise(text)
    # Pairs counted from the right: reverse, split in twos, reverse back.
    pairs = F.reverse(F.regexp_replace(F.reverse(head), r"([0-9]{2})(?=[0-9])", "$1|"))
    indian = F.concat(F.when(F.length(text) > 3, pairs).otherwise(F.lit("")), tail)
    return F.replace(F.when(lakh, indian).otherwise(western), F.lit("|"), group_mark)


def money(value: Column, symbol: Column, group_mark: Column, lakh: Column) -> Column:
    whole = _whole(value)
    return F.concat(
        F.when(whole < 0, "-").otherwise(""), symbol, grouped_digits(F.abs(whole), group_mark, lakh)
    )


def usd(value: Column) -> Column:
    return money(value, F.lit("$"), F.lit(","), F.lit(False))


def short_number(value: Column) -> Column:
    """Whole and grouped from 1000 up, else at most two decimals."""
    small = F.regexp_replace((F.floor(value * 100 + 0.5) / 100).cast("string"), r"\.0$", "")
    # Above a thousand the nearest whole number, halves away from zero.
    large = F.concat(F.when(value < 0, "-").otherwise(""), F.format_number(F.floor(F.abs(value) + 0.5), 0))
    return F.when(F.abs(value) >= 1000, large).otherwise(small)
