"""How each column of a table writes its numbers and dates, and bringing them to one form.

Format belongs to a column, not to a value: all evidence of a column is counted in one
grouped pass over (column, value) cells, and every value of the table counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from tallyloom.functions import dates as D, numbers as N
from tallyloom.functions.strings import trim_space
from tallyloom.session import materialise


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) rows, every value as text."""
    texts = df.select(*[F.col(quoted(c)).cast("string").alias(c) for c in columns])
    return texts.unpivot([], [F.col(quoted(c)) for c in columns], "column", "value")


def format_evidence(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with the counts every decision is made from."""
    v = F.col("value")
    # no number has these marks
    readable = ~(v.contains("/") | v.contains(":")) & (N.parse_number(v).isNotNull() | N.parse_number(v, ",").isNotNull())
    # Each cell is judged once here; the counts below only look at the verdicts.
    judged = cells(df, columns).where(~N.is_blank(v)).select(
        "column",
        D.is_date_shaped(v).alias("dateish"),
        readable.alias("numeric"),
        D.names_clock(trim_space(v)).alias("instant"),
        N.number_evidence(v).alias("number"),
        D.date_evidence(v).alias("date"),
    )
    number, date = F.col("number"), F.col("date")
    return judged.groupBy("column").agg(
        F.count("*").alias("n"),
        F.count_if("dateish").alias("n_dateish"),
        F.count_if("numeric").alias("n_numeric"),
        F.count_if("instant").alias("n_instants"),
        F.count_if(number == "comma").alias("n_comma"),
        F.count_if(number == "dot").alias("n_dot"),
        F.count_if(number == "space").alias("n_space"),
        F.count_if(date == "iso").alias("n_iso"),
        F.count_if(date == "dmy").alias("n_dmy"),
        F.count_if(date == "mdy").alias("n_mdy"),
        F.count_if(date == "undecided").alias("n_undecided"),
    )


def _number_decision() -> tuple[Column, Column, Column]:
    comma, dot, space = F.col("n_comma"), F.col("n_dot"), F.col("n_space")
    total = comma + dot + space
    spaced = (space >= comma) & (space >= dot)
    european = comma > dot
    decided = F.when(total == 0, F.struct(F.lit(".").alias("d"), F.lit(",").alias("g"), F.lit(0.3).alias("c"))) \
        .when(spaced, F.struct(F.lit(".").alias("d"), F.lit(" ").alias("g"), (space / total).alias("c"))) \
        .when(european, F.struct(F.lit(",").alias("d"), F.lit(".").alias("g"), (comma / total).alias("c"))) \
        .otherwise(F.struct(F.lit(".").alias("d"), F.lit(",").alias("g"), (dot / total).alias("c")))
    return decided["d"], decided["g"], decided["c"]


def number_formats(evidence: DataFrame) -> DataFrame:
    decimal, grouping, confidence = _number_decision()
    comma, dot, space = F.col("n_comma"), F.col("n_dot"), F.col("n_space")
    total = (comma + dot + space).cast("string")
    # The wording is part of the result (fixed values).
    reason = (
        F.when(comma + dot + space == 0, F.lit("no separator evidence in the column; assumed 1,234.56"))
        .when((space >= comma) & (space >= dot),
              F.concat(space.cast("string"), F.lit(" of "), total, F.lit(" values group thousands with a space")))
        .when(comma > dot,
              F.concat(comma.cast("string"), F.lit(" of "), total, F.lit(" values use a comma as the decimal point")))
        .otherwise(
            F.concat(dot.cast("string"), F.lit(" of "), total, F.lit(" values use a dot as the decimal point")))
    )
    return evidence.select(
        "column", "n_comma", "n_dot", "n_space",
        decimal.alias("decimal"), grouping.alias("grouping"),
        N.round_half_up(confidence, 4).alias("confidence"), reason.alias("reason"),
    )


def _date_decision() -> tuple[Column, Column, Column]:
    dmy, mdy, open_, iso = F.col("n_dmy"), F.col("n_mdy"), F.col("n_undecided"), F.col("n_iso")
    mixed = (dmy > 0) & (mdy > 0)
    only_one = (dmy > 0) | (mdy > 0)
    order = (
        F.when(mixed, "unknown").when(dmy > 0, "dmy").when(mdy > 0, "mdy").when(open_ > 0, "unknown")
        .when(iso > 0, "ymd").otherwise("unknown")
    )
    confidence = (
        F.when(mixed, 0.0)
        .when(only_one, F.least(F.lit(1.0), 0.8 + F.greatest(dmy, mdy) / 100))
        .when(open_ > 0, 0.0).when(iso > 0, 1.0).otherwise(0.0)
    )
    return order, mixed | (~only_one & (open_ > 0)), confidence


def date_orders(evidence: DataFrame) -> DataFrame:
    order, ambiguous, confidence = _date_decision()
    return evidence.select(
        "column", "n_iso", "n_dmy", "n_mdy", "n_undecided",
        order.alias("date_order"), ambiguous.alias("ambiguous"),
        N.round_half_up(confidence, 4).alias("confidence"),
    )


def detect_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """What was decided for every number and date column; other columns have no row."""
    evidence = format_evidence(df, columns)
    decimal, grouping, number_confidence = _number_decision()
    order, ambiguous, date_confidence = _date_decision()
    both = evidence.select(
        "*", decimal.alias("decimal"), grouping.alias("grouping"),
        N.round_half_up(number_confidence, 4).alias("number_confidence"),
        order.alias("date_order"), ambiguous.alias("ambiguous"),
        N.round_half_up(date_confidence, 4).alias("date_confidence"),
    )
    is_date = F.col("n_dateish") / F.col("n") >= 0.8
    is_number = ~is_date & (F.col("n_numeric") / F.col("n") >= 0.8)
    date_word = F.when(F.col("date_order") != "unknown", F.col("date_order")) \
        .when(F.col("ambiguous"), "ambiguous").otherwise("not a date column")
    number_word = F.when(F.col("decimal") == ",", "1.234,56").when(F.col("grouping") == " ", "1 234.56") \
        .otherwise("1,234.56")
    # Dates are rewritten only where they are day-first or name an instant.
    rewrite = (
        F.when(is_date & (F.col("date_order") == "dmy"), "dmy")
        .when(is_date & (F.col("n_instants") > 0), "mdy")
        .when(is_number, F.col("decimal"))
    )
    return both.where(is_date | is_number).select(
        "column",
        F.when(is_date, "date").otherwise("number").alias("kind"),
        F.when(is_date, date_word).otherwise(number_word).alias("decision"),
        F.when(is_date, F.col("date_confidence")).otherwise(F.col("number_confidence")).alias("confidence"),
        rewrite.alias("rewrite"),
    )


def _plain_text(number: Column) -> Column:
    """A number as plain decimal text without trailing zeros."""
    text = number.try_cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+$", ""), r"\.$", "")


def _decided(formats: DataFrame) -> dict[str, str]:
    """The columns that are rewritten and how; `formats` has one row per column of the table."""
    return {r["column"]: r["rewrite"] for r in formats.where("rewrite is not null").select("column", "rewrite").collect()}


def _readings(value: Column, rewrite: Column, zone: str) -> Column:
    """The cell as its column's decision reads it, and as the plain reading does."""
    plain = trim_space(F.translate(value, "$€£₹,()", ""))
    as_number = rewrite.isin(",", ".")
    return F.struct(
        F.when(rewrite.isin("dmy", "mdy"), D.to_iso_date(value, rewrite, zone)).alias("iso"),
        F.when(as_number, N.parse_number(value, rewrite)).alias("number"),
        F.when(as_number, F.when(plain == "", F.lit(0.0)).otherwise(N.plain_number(value))).alias("legacy"),
    )


def _rewritten(value: Column, readings: Column) -> Column:
    """The cell in canonical form; untouched where it already read right."""
    iso, number = readings["iso"], readings["number"]
    changed = (
        F.when(iso.isNotNull() & (iso != trim_space(value)), iso)
        .when(number.isNotNull() & ~number.eqNullSafe(readings["legacy"]), _plain_text(number))
    )
    return F.coalesce(changed, value)


def normalise_columns(df: DataFrame, columns: list[str], formats: DataFrame, zone: str = "UTC") -> DataFrame:
    """The table with misread cells rewritten.

    The decisions are looked at first, so a cell is read in the one way decided for its column.
    """
    decided = _decided(formats)
    read = df.select(
        "*",
        *[_readings(F.col(quoted(c)).cast("string"), F.lit(decided[c]), zone).alias(f"_read_{i}")
          for i, c in enumerate(columns) if c in decided],
    )
    out = [F.col(quoted(c)) for c in df.columns]
    for i, c in enumerate(columns):
        text = F.col(quoted(c)).cast("string")
        out[df.columns.index(c)] = (_rewritten(text, F.col(f"_read_{i}")) if c in decided else text).alias(c)
    return read.select(*out)


def with_dates(df: DataFrame, columns: list[str], zone: str = "UTC") -> DataFrame:
    """The table with written dates as dates, each column under the order its own values prove.

    Series, filters and windows then read day-first, month-first and two-digit years alike. The
    order is decided over the whole column; where nothing proves one it is month first. Cells
    that are no real day become null; columns that hold dates already stay.
    """
    texts = [c for c in columns if isinstance(df.schema[c].dataType, StringType)]
    if not texts:
        return df
    day_first = detect_formats(df, texts).where("rewrite = 'dmy'").agg(F.collect_set("column")).scalar()
    held = df.select("*", day_first.alias("_day_first"))
    order = lambda c: F.when(F.array_contains("_day_first", c), "dmy").otherwise("mdy")
    return held.select(*[D.to_iso_date(F.col(quoted(c)), order(c), zone).try_cast("date").alias(c) if c in texts else F.col(quoted(c)) for c in df.columns])


def format_notes(df: DataFrame, columns: list[str], zone: str = "UTC", formats: DataFrame | None = None) -> DataFrame:
    """The decisions with the number of cells each one rewrote.

    `formats` are the table's where they are already at hand. Only columns that are rewritten are read again.
    """
    if formats is None:
        formats = materialise(detect_formats(df, columns), "formats")
    decided = _decided(formats)
    changed = df.sparkSession.createDataFrame([], "column string, rewritten bigint")
    for way in sorted(set(decided.values())):  # four at most; each reads its own columns
        judged = cells(df, [c for c in columns if decided.get(c) == way])
        read = judged.select("column", "value", _readings(F.col("value"), F.lit(way), zone).alias("read"))
        differs = ~_rewritten(F.col("value"), F.col("read")).eqNullSafe(F.col("value"))
        changed = changed.unionByName(read.select("column", differs.alias("differs")).groupBy("column").agg(
            F.count_if("differs").alias("rewritten")))
    return formats.join(changed, "column", "left").select(
        "column", "kind", "decision", "confidence", F.coalesce("rewritten", F.lit(0)).alias("rewritten")
    )


def day_first(df: DataFrame, columns: list[str]) -> DataFrame:
    """Whether a column as a whole is written day first: a first field above 12 proves it,
    a second field above 12 rules it out."""
    shape = r"^([0-9]{1,2})[/-]([0-9]{1,2})[/-][0-9]{2,4}"
    s = trim_space(F.col("value"))
    first = F.nullif(F.regexp_extract(s, shape, 1), F.lit("")).try_cast("int")
    second = F.nullif(F.regexp_extract(s, shape, 2), F.lit("")).try_cast("int")
    proved, ruled_out = F.bool_or(F.col("first") > 12), F.bool_or(F.col("second") > 12)
    fields = cells(df, columns).select("column", first.alias("first"), second.alias("second"))
    return fields.groupBy("column").agg(
        (F.coalesce(proved, F.lit(False)) & ~F.coalesce(ruled_out, F.lit(False))).alias("day_first"))
