"""What each column of any table is for, read from its values.

Everything is derived from the per-column statistics of the profile: one row per column,
whatever the size of the table. Column names only break ties, except where a rule says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import numbers as N
from tallyloom.functions.strings import trimmed
from tallyloom.operators.formats import quoted
from tallyloom.session import materialise
from tallyloom.operators.profile import statistics_of, with_types

# Name hints. They order equals and never make a role on their own.
HINT_MONEY = "(?i)(revenue|sales|amount|price|cost|profit|margin|spend|budget|value|fee|charge|payment|total|salary|income)"
HINT_RATE = "(?i)(pct|percent|rate|ratio|share|%|score|index|average|avg|mean)"
HINT_PERCENT = "(?i)(pct|percent|%|rate|share)"
HINT_ID = r"(?i)((^|[_\s])(id|no|num|number|code|key|ref|uuid|guid|sku|barcode)$|^(id|uuid|guid)$)"
HINT_TIME = "(?i)(date|time|day|month|year|period|timestamp|created|updated|when)"
NAME_COST = r"(?i)((^|[_\s])(cost|cogs|expense|expenses|spend|outlay)([_\s]|$)|cost[_\s]?of[_\s]?goods)"
NAME_PROFIT = r"(?i)(^|[_\s])(profit|margin|net[_\s]?income|earnings|gross[_\s]?profit)([_\s]|$)"
MAX_SCALE_RATIO = 50


def column_evidence(df: DataFrame, columns: list[str], statistics: DataFrame | None = None) -> DataFrame:
    """Per column: coverage, distinctness, date and code checks, spread.

    `statistics` are those of the table where they are already at hand.
    """
    typed = with_types(statistics if statistics is not None else statistics_of(df, columns))
    filled, n = F.col("filled"), F.col("n_number")
    mean = F.col("total") / n
    variance = F.greatest(F.col("total_squares") / n - mean * mean, F.lit(0.0))
    return typed.select(
        "column", "type", "n_rows", "missing", "filled", F.col("distinct").alias("unique_values"), "lo", "hi", "avg_length",
        F.when(F.col("n_rows") > 0, filled / F.col("n_rows")).otherwise(0.0).alias("coverage"),
        F.when(filled > 0, F.col("distinct") / filled).otherwise(0.0).alias("distinctness"),
        F.when(filled > 0, F.col("n_plausible") / filled >= 0.8).otherwise(False).alias("plausible_dates"),
        ((F.col("all_digits")) & (F.col("shortest") == F.col("longest")) & (F.col("shortest") >= 4)
         & (filled >= 8)).alias("fixed_width"),
        (F.col("whole") & (F.col("lo") >= 1900) & (F.col("hi") <= 2100) & (F.col("hi") - F.col("lo") <= 120)).alias("years"),
        "whole",
        F.when((n >= 2) & (mean != 0), F.abs(F.sqrt(variance) / mean)).otherwise(0.0).alias("variation"),
    )


def classify(evidence: DataFrame) -> DataFrame:
    """The role of every column with a confidence and the reason."""
    c, name = F.col, F.col("column")
    coverage, distinctness, unique, filled = c("coverage"), c("distinctness"), c("unique_values"), c("filled")
    span = c("hi") - c("lo")
    density = F.when(span > 0, unique / (span + 1)).otherwise(0.0)
    numeric = c("type").isin("number", "currency") & c("lo").isNotNull()  # codes like "A-17" hold digits, but no number
    key_like = (c("type") == "number") & c("whole") & (distinctness > 0.9) & (filled >= 8)
    few_wholes = c("whole") & (unique <= 12) & (distinctness < 0.05) & (filled >= 40)
    grouping = (c("type") == "category") | ((unique <= F.greatest(F.lit(50.0), c("n_rows") * 0.2)) & (distinctness <= 0.5))

    def verdict(role, confidence, reason):
        value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
        clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
        return F.struct(F.lit(role).alias("role"), clamped.alias("confidence"), F.lit(reason).alias("reason"))

    small = F.when(unique <= 25, 0.35).otherwise(0.15)
    decided = (
        F.when((c("type") == "empty") | (filled == 0), verdict("ignored", 1, "column is empty"))
        .when(coverage < 0.05, verdict("ignored", 0.9, "too few rows have a value"))
        .when(unique <= 1, verdict("ignored", 0.95, "every row holds the same value"))
        .when(~name.rlike(HINT_ID) & (c("type") == "date") & c("plausible_dates"),
              verdict("time", 0.7 + coverage * 0.3, "values parse as dates"))
        .when(c("type") == "boolean", verdict("dimension", 0.9, "two-valued true/false column"))
        .when(key_like & (density >= 0.9),
              verdict("identifier", 0.6 + density * 0.35, "consecutive whole numbers, one per row"))
        .when(key_like & name.rlike(HINT_ID),
              verdict("identifier", 0.6, "a different whole number on almost every row"))
        .when(numeric & c("years"), verdict("dimension", 0.85, "whole numbers in the calendar-year range"))
        .when(numeric & c("fixed_width") & (distinctness > 0.9),
              verdict("identifier", 0.8, "every value has the same digit count"))
        .when(numeric & c("fixed_width"), verdict("dimension", 0.8, "every value has the same digit count"))
        .when(numeric & (c("lo") == c("hi")), verdict("ignored", 0.9, "the same number on every row"))
        .when(numeric & few_wholes, verdict("dimension", 0.7, "a few whole numbers that repeat"))
        .when(numeric, verdict("measure", 0.55 + F.least(c("variation"), F.lit(1.0)) * 0.25 + coverage * 0.2,
                               "numeric values"))
        .when(grouping, verdict("dimension", 0.5 + small + coverage * 0.15, "a set of repeated values"))
        .when((distinctness > 0.9) & (c("avg_length") <= 40),
              verdict("identifier", 0.5 + distinctness * 0.3, "a different short value on almost every row"))
        .otherwise(verdict("text", 0.8, "free text"))
    )
    return evidence.select("*", decided.alias("_v")).select(
        *evidence.columns, c("_v.role").alias("role"),
        N.round_half_up(c("_v.confidence"), 3).alias("confidence"), c("_v.reason").alias("reason"))


def measure_traits(classified: DataFrame) -> DataFrame:
    """How each measure may be aggregated and printed; a rate is averaged."""
    c, name = F.col, F.col("column")
    measure = c("role") == "measure"
    bounded = (c("lo") >= 0) & (c("hi") <= 100) & (c("hi") != F.floor("hi"))
    rate = name.rlike(HINT_RATE) | (bounded & (c("type") != "currency") & (c("distinctness") > 0.2))
    shown = F.when(c("type") == "currency", "money").when(name.rlike(HINT_RATE) & name.rlike(HINT_PERCENT), "percent").otherwise("number")
    return classified.select(
        "*",
        F.when(measure, F.when(rate, "avg").otherwise("sum")).alias("aggregate"),
        F.when(measure, c("lo") >= 0).alias("additive"),
        F.when(measure, shown).alias("format"),
    )


def separation(df: DataFrame, dimensions: list[str], measure: Column) -> DataFrame:
    """How unevenly a measure is spread over the groups of each dimension, 0 to 1.

    All dimensions are summed in one grouped pass over (dimension, group) rows.
    """
    value = F.abs(F.coalesce(measure, F.lit(0.0)))
    wide = df.select(value.alias("_value"), *[trimmed(F.col(quoted(d))).alias(d) for d in dimensions])
    long = wide.unpivot(["_value"], [F.col(quoted(d)) for d in dimensions], "column", "label")
    groups = long.where("label <> ''").groupBy("column", "label").agg(F.sum("_value").alias("v"))
    # One row per dimension named by the caller.
    wholes = groups.groupBy("column").agg(F.sum("v").alias("whole"), F.count("*").alias("k"))
    spread = F.sum(F.abs(F.col("v") / F.nullif(F.col("whole"), F.lit(0.0)) - 1 / F.col("k"))) / 2
    return groups.join(F.broadcast(wholes), "column").groupBy("column").agg(
        F.when(F.max("k") < 2, 0.0).otherwise(N.round_half_up(F.coalesce(spread, F.lit(0.0)), 3)).alias("separation"))


def ranked_columns(df: DataFrame, columns: list[str], statistics: DataFrame | None = None) -> DataFrame:
    """Every column with its role, traits, score and rank within the role."""
    c, name = F.col, F.col("column")
    # One row per column, read three times below.
    traits = materialise(measure_traits(classify(column_evidence(df, columns, statistics))), "traits")
    moves = F.least(c("variation"), F.lit(1.5)) / 1.5
    hint = F.when(name.rlike(HINT_MONEY), 0.002).otherwise(0.0)
    measure_score = (
        moves * 0.45 + c("coverage") * 0.3 + F.when(c("additive"), 0.15).otherwise(0.0)
        + F.when(c("format") == "money", 0.1).otherwise(0.0) + hint
        - F.when(c("aggregate") == "avg", 0.05).otherwise(0.0))
    measures = traits.where("role = 'measure'").select("column", N.round_half_up(measure_score, 3).alias("s"))
    lead = measures.orderBy(F.desc("s"), "column").limit(1).select("column").scalar()
    # The lead measure is only known from the data, so the rows carry a map to pick it from;
    # without one every row counts 1.
    picked = F.try_element_at(
        F.create_map(*[e for n in columns for e in (F.lit(n), N.plain_number(F.col(quoted(n)).cast("string")))]),
        F.coalesce(lead, F.lit("")))
    value = F.when(lead.isNull(), F.lit(1.0)).otherwise(picked)
    spread = separation(df, columns, value)

    card = c("unique_values")
    fit = (
        F.when(card <= 1, 0.0).when(card == 2, 0.55).when(card <= 8, 1.0).when(card <= 25, 0.9)
        .when(card <= 50, 0.7).when(card <= 200, 0.35).otherwise(0.1))
    id_hint = name.rlike(HINT_ID)
    score = (
        F.when(c("role") == "time", c("coverage") * 0.6 + F.least(c("distinctness") * 2, F.lit(1.0)) * 0.4
               + F.when(name.rlike(HINT_TIME), 0.001).otherwise(0.0))
        .when(c("role") == "measure", measure_score)
        .when(c("role") == "dimension", fit * 0.45 + F.coalesce("separation", F.lit(0.0)) * 0.35 + c("coverage") * 0.2
              - F.when(id_hint, 0.05).otherwise(0.0))
        .when(c("role") == "identifier", c("distinctness") * 0.5 + c("coverage") * 0.4
              + F.when(id_hint, 0.002).otherwise(0.0))
        .otherwise(0.0))
    scored = traits.join(spread, "column", "left").select("*", N.round_half_up(score, 3).alias("score"))
    # One row per column of the table, so a window over them is short.
    tie = F.when(c("role") == "dimension", -card).otherwise(0)
    place = Window.partitionBy("role").orderBy(F.desc("score"), tie, "column")
    return materialise(scored.withColumn("rank", F.row_number().over(place)), "shape")


def shape_kind(ranked: DataFrame) -> DataFrame:
    """Which kind of table this is, from how many columns play each role."""
    def has(role):
        return F.count_if(F.col("role") == role) > 0

    usable = F.count_if(F.col("role") != "ignored")
    kind = (
        F.when(usable == 0, "unusable").when(usable == 1, "single_column")
        .when(has("measure") & has("time"), "measure_over_time").when(has("measure"), "measure")
        .when(has("time"), "events_over_time").when(has("dimension"), "categorical").otherwise("unusable"))
    return ranked.agg(kind.alias("kind"), usable.alias("usable_columns"))


def dimension_list(ranked: DataFrame) -> DataFrame:
    """Every grouping of the table with a filter key, a label and its size.

    Names that give one key are told apart by a number, in rank order.
    """
    name = F.col("column")
    key = F.substring(F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, 40)
    keyed = ranked.where("role = 'dimension'").select(
        "rank", F.when(key == "", "column").otherwise(key).alias("key"), "column", humanised(name).alias("label"),
        F.col("unique_values").alias("cardinality"))
    # One row per column of the table.
    place = F.row_number().over(Window.partitionBy("key").orderBy("rank", "column"))
    return keyed.withColumn("key", F.when(place == 1, F.col("key")).otherwise(F.concat_ws("_", "key", place)))


def humanised(name: Column) -> Column:
    """`bed_days` or `bedDays` as `Bed Days`; short capitals stay."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"[_\-.]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    words = F.split(F.trim(F.regexp_replace(spaced, r"\s+", " ")), " ")
    return F.array_join(F.transform(words, lambda w: F.when(
        (F.length(w) <= 3) & (w == F.upper(w)), w).otherwise(F.initcap(F.lower(w)))), " ")


def financial_pairs(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """Whether a named cost or profit column may be read against the lead measure.

    It must be a summable amount, be named so, and total within 50 times the lead.
    """
    summable = (F.col("role") == "measure") & (F.col("aggregate") == "sum") & F.col("additive") & (F.col("format") != "percent")
    columns = df.columns
    totals = df.agg(*[F.sum(F.abs(N.plain_number(F.col(quoted(c)).cast("string")))).alias(c) for c in columns]).unpivot(
        [], [F.col(quoted(c)) for c in columns], "column", "abs_total")
    name = F.col("column")
    both = ranked.where(summable).join(totals, "column").select(
        "column", "rank", "abs_total",
        F.when(name.rlike(NAME_PROFIT), "profit").when(name.rlike(NAME_COST), "cost").alias("named"))
    lead = both.where("rank = 1").select(F.struct("column", "abs_total")).scalar()
    ratio = F.greatest("abs_total", "_l.abs_total") / F.nullif(F.least("abs_total", "_l.abs_total"), F.lit(0.0))
    paired = both.where("rank > 1 and named is not null").select("*", lead.alias("_l")).where("_l is not null")
    return paired.select(
        F.col("_l.column").alias("lead"), "column", "named", N.round_half_up(ratio, 4).alias("scale_ratio"),
        F.coalesce(ratio <= MAX_SCALE_RATIO, F.lit(False)).alias("accepted"))
