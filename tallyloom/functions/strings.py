"""Keys, labels and the small text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


# The characters that count as surrounding space.
WHITESPACE = " \t\n\r\f\u00a0\u2009\u202f\ufeff"


def trim_space(value: Column) -> Column:
    return F.btrim(value.cast("string"), F.lit(WHITESPACE))


def trimmed(value: Column) -> Column:
    """Text without surrounding space; a missing cell is the empty string."""
    return trim_space(F.coalesce(value.cast("string"), F.lit("")))


def tidy_key(value: Column) -> Column:
    """An identifier: trimmed, blank is missing."""
    return F.nullif(trim_space(value), F.lit(""))


def join_key(value: Column) -> Column:
    """A join key: trimmed, case-insensitive; a blank never matches anything."""
    return F.lower(tidy_key(value))


def group_label(value: Column) -> Column:
    """The label a row is grouped under."""
    return F.coalesce(tidy_key(value), F.lit("Unknown"))


def title_case(value: Column) -> Column:
    """Each whitespace-separated word capitalised, with `McX` spelled that way."""
    capital = F.initcap(F.lower(value))
    pieces = F.split(capital, r"\bMc(?=[a-z])")
    rest = F.transform(
        F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))),
        lambda p: F.concat(F.lit("Mc"), F.upper(p.substr(F.lit(1), F.lit(1))), p.substr(F.lit(2), F.length(p))),
    )
    return F.when(value.isNotNull(), F.concat(pieces[0], F.array_join(rest, "")))


# Accented Latin letters and the plain letters they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def normalise_region(name: Column) -> Column:
    """A place name reduced to its letters and digits."""
    return F.regexp_replace(F.translate(F.lower(name), ACCENTED, PLAIN), "[^a-z0-9]+", "")


# Spellings found in business data -> the name used on the map.
REGION_ALIASES = {
    "usa": "United States of America",
    "us": "United States of America",
    "unitedstates": "United States of America",
    "unitedstatesofamerica": "United States of America",
    "america": "United States of America",
    "uk": "United Kingdom",
    "greatbritain": "United Kingdom",
    "england": "United Kingdom",
    "britain": "United Kingdom",
    "uae": "United Arab Emirates",
    "southkorea": "South Korea",
    "korea": "South Korea",
    "republicofkorea": "South Korea",
    "northkorea": "North Korea",
    "democraticpeoplesrepublicofkorea": "North Korea",
    "russia": "Russia",
    "russianfederation": "Russia",
    "czechrepublic": "Czechia",
    "ivorycoast": "Côte d'Ivoire",
    "drc": "Dem. Rep. Congo",
    "democraticrepublicofthecongo": "Dem. Rep. Congo",
    "burma": "Myanmar",
    "swaziland": "eSwatini",
    "northmacedonia": "Macedonia",
    "bosnia": "Bosnia and Herz.",
    "dominicanrepublic": "Dominican Rep.",
    "centralafricanrepublic": "Central African Rep.",
    "southsudan": "S. Sudan",
    "equatorialguinea": "Eq. Guinea",
    "easttimor": "Timor-Leste",
    "westernsahara": "W. Sahara",
    "solomonislands": "Solomon Is.",
    "holland": "Netherlands",
    "netherland": "Netherlands",
}


def region_aliases(spark) -> DataFrame:
    """The alias table as a DataFrame (a fixed 34 rows)."""
    return spark.createDataFrame(sorted(REGION_ALIASES.items()), "alias string, map_name string")


def window_phrase(days: Column, basis: Column | None = None) -> Column:
    """How a comparison window is named from its length in days."""
    word = (
        F.when(days <= 10, "week").when(days <= 45, "month").when(days <= 135, "quarter")
        .when(days <= 400, "year").otherwise("period")
    )
    phrase = F.when(days > 0, F.concat(F.lit("the previous "), word)).otherwise(F.lit("the previous period"))
    if basis is None:
        return phrase
    return F.when(basis == "same_period_last_year", F.lit("the same period last year")).otherwise(phrase)


def row_identity(customer: Column, date: Column) -> Column:
    """The order key used where a table has no order ids."""
    return F.concat_ws("|", customer.cast("string"), date.cast("string"))


# --- questions --------------------------------------------------------------------------

# The words a question names a grouping with, checked in this order.
DIMENSION_WORDS = {
    "customer": "customer_name", "customers": "customer_name", "client": "customer_name",
    "product": "product_name", "products": "product_name", "item": "product_name",
    "region": "region", "regions": "region", "state": "state", "states": "state",
    "category": "category", "categories": "category", "department": "department",
    "month": "date", "monthly": "date", "time": "date", "trend": "date",
}

# The words that name one of the built-in metrics.
METRIC_WORDS = {
    "revenue": ["revenue", "sales", "income", "turnover", "gross"],
    "profit": ["profit", "margin", "earnings", "net income", "net"],
    "quantity": ["quantity", "units", "volume", "items sold", "count"],
    "orders": ["orders", "order", "transactions", "invoices"],
}


def _word(word: str) -> str:
    return r"\b" + word + r"\b"


def question_dimension(question: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for word, dimension in DIMENSION_WORDS.items():
        out = out.when(question.rlike(_word(word)), F.lit(dimension))
    return out


def question_metric(question: Column, default: str = "revenue") -> Column:
    """The metric whose longest word appears; longer words are tried first."""
    words = [(w, metric) for metric, ws in METRIC_WORDS.items() for w in ws]
    out = F.when(F.lit(False), F.lit(""))
    for word, metric in sorted(words, key=lambda pair: -len(pair[0])):
        out = out.when(question.rlike(_word(word)), F.lit(metric))
    return out.otherwise(F.lit(default))


def question_limit(question: Column, default: int = 10, most: int | None = None) -> Column:
    """How many rows a question asks for, at most `most` where that is given."""
    pattern = r"top\s+([0-9]+)|([0-9]+)\s+(customers|products|regions|items)"
    first = F.nullif(F.regexp_extract(question, pattern, 1), F.lit(""))
    second = F.nullif(F.regexp_extract(question, pattern, 2), F.lit(""))
    asked = F.coalesce(first, second).try_cast("int")  # null where nothing was asked
    chosen = F.when(asked == 0, F.lit(default)).otherwise(F.coalesce(asked, F.lit(default)))
    wanted = F.greatest(F.lit(1), chosen)
    return wanted if most is None else F.least(F.lit(most), wanted)


def question_intent(question: Column) -> Column:
    """What a question asks for, by the first rule that matches its words."""
    rising = question.rlike("grow|rising|fastest|climbing")
    return (
        F.when(question.rlike("predict|forecast|next month|next quarter|projection|will be"), "forecast")
        .when(question.rlike("why|reason|cause"), "explain_change")
        .when(question.rlike("declin|falling|dropping|grow|rising|fastest|climbing"),
              F.when(rising, "growing_groups").otherwise("declining_groups"))
        .when(question.rlike("highest|lowest|best|worst"),
              F.when(question.rlike("lowest|worst"), "min_period").otherwise("max_period"))
        .when(question_dimension(question) == "date", "trend")
        .otherwise("top_n")
    )


def tag_questions(df: DataFrame, text: str, most: int | None = None) -> DataFrame:
    """Intent, metric, dimension, row limit and chart for every question of a table."""
    q = F.lower(F.col(text))
    intent = question_intent(q)
    dimension = (
        F.when(intent.isin("forecast", "explain_change", "max_period", "min_period", "trend"), F.lit("date"))
        .when(intent.isin("growing_groups", "declining_groups"),
              F.coalesce(question_dimension(q), F.lit("product_name")))
        .otherwise(F.coalesce(question_dimension(q), F.lit("")))
    )
    return df.select(
        "*",
        intent.alias("intent"),
        question_metric(q).alias("metric"),
        dimension.alias("dimension"),
        question_limit(q, most=most).alias("row_limit"),
        F.when(intent.isin("forecast", "trend"), "line").otherwise("bar").alias("chart"),
    )
