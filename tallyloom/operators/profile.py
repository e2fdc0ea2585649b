"""Column profiles, quality issues and the quality score.

Most of a profile is a state of one row per column: counts, extremes, moments and sketches, taken
where the cells lie and merged, so nothing but those rows moves and the state of an appended part
is merged with a stored one. Only what needs the values themselves (their exact number, spellings,
smallest ones) groups by (column, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.functions import dates as D, numbers as N
from tallyloom.functions.strings import trim_space
from tallyloom.operators.formats import cells, quoted
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.session import materialise

# The shapes of a currency amount and of a number.
CURRENCY_SHAPE = r"^\s*[-(]?\s*[$€£₹]\s?[0-9,]+(\.[0-9]+)?\s*\)?\s*$"
NUMERIC_SHAPE = r"^\s*-?[0-9,]*\.?[0-9]+\s*$"
MIN_OUTLIER_VALUES = 8


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value) with the number of rows; blank cells are null."""
    text = trim_space(F.col("value"))
    return cells(df, columns).select("column", F.when(text != "", text).alias("value")).groupBy("column", "value").agg(F.count("*").alias("n"))


def judged_cells(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each cell with what it could be."""
    raw = F.col("value")
    text = trim_space(raw)
    trimmed = cells(df, columns).select("column", F.when(text != "", text).alias("value"), (raw != text).alias("spaced"))
    v = F.col("value")
    number = N.plain_number(v)
    return trimmed.select(
        "column", "value", "spaced", number.alias("number"),
        F.when(number.isNull(), F.regexp_replace(v, "[A-Za-z%]", "").rlike(NUMERIC_SHAPE)).alias("with_text"),
        v.rlike(CURRENCY_SHAPE).alias("currency"), F.lower(v).isin("true", "false", "yes", "no").alias("flag"),
        D.looks_like_date(v).alias("date"), F.year(D.to_iso_date(v).try_cast("date")).alias("year"))


# How each field of a state comes from cells and from states: the plain fields, then the sketches.
_FIELDS = {
    "n_rows": (lambda: F.count("*"), F.sum), "missing": (lambda: F.count_if(F.col("value").isNull()), F.sum),
    "spaced": (lambda: F.count_if(F.col("value").isNotNull() & F.col("spaced")), F.sum), "n_number": (lambda: F.count("number"), F.sum),
    "with_text": (lambda: F.count_if("with_text"), F.sum), "n_currency": (lambda: F.count_if("currency"), F.sum),
    "n_flag": (lambda: F.count_if("flag"), F.sum), "n_date": (lambda: F.count_if("date"), F.sum),
    "n_plausible": (lambda: F.count_if(F.col("year").between(1900, 2100)), F.sum), "lo": (lambda: F.min("number"), F.min), "hi": (lambda: F.max("number"), F.max),
    "total": (lambda: N.exact_sum("number"), N.exact_sum), "total_squares": (lambda: F.sum(F.col("number") * F.col("number")), F.sum),
    "whole": (lambda: F.bool_and(F.col("number") == F.floor("number")), F.bool_and), "all_digits": (lambda: F.bool_and(F.col("value").rlike("^[0-9]{3,}$")), F.bool_and),
    "shortest": (lambda: F.min(F.length("value")), F.min), "longest": (lambda: F.max(F.length("value")), F.max),
}
_SKETCHES = {"values_seen": (lambda: F.hll_sketch_agg("value"), F.hll_union_agg), "numbers_seen": (lambda: F.kll_sketch_agg_double("number"), F.kll_merge_agg_double)}


def column_states(df: DataFrame, columns: list[str], sketches: bool = False) -> DataFrame:
    """One mergeable row per column; with `sketches` also of the distinct values and the numbers' ranks."""
    fields = _FIELDS | (_SKETCHES if sketches else {})
    return judged_cells(df, columns).groupBy("column").agg(*[make().alias(k) for k, (make, _) in fields.items()])


def merge_states(states: DataFrame) -> DataFrame:
    """The states of several parts of a table as that of the whole."""
    fields = {k: v for k, v in (_FIELDS | _SKETCHES).items() if k in states.columns}
    return states.groupBy("column").agg(*[merge(k).alias(k) for k, (_, merge) in fields.items()])


def estimates(states: DataFrame) -> DataFrame:
    """What the sketches of a state tell: about how many values differ, and about where the quartiles lie."""
    quartiles = F.when(F.col("n_number") > 0, F.kll_sketch_get_quantile_double("numbers_seen", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    return states.select("column", F.hll_sketch_estimate("values_seen").alias("about_distinct"), quartiles.alias("about_quartiles"))


def value_facts(counts: DataFrame) -> DataFrame:
    """Per column the exact number of values and their mean length."""
    return counts.groupBy("column").agg(F.count("value").alias("distinct"), F.avg(F.length("value")).alias("avg_length"))


def column_statistics(states: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per column with everything the profile and the shape are read from.

    The values are grouped only where a result needs `distinct` or `avg_length`; otherwise Spark
    drops the join.
    """
    cleaned = states.withColumns({"whole": F.coalesce("whole", F.lit(False)), "all_digits": F.coalesce("all_digits", F.lit(False))})
    return cleaned.join(value_facts(counts), "column", "left")


def statistics_of(df: DataFrame, columns: list[str]) -> DataFrame:
    return column_statistics(column_states(df, columns), value_counts(df, columns))


def cell_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column with the counts that need no distinct values: rows, missing cells,
    stray spaces, numbers with text. Counted where the cells lie; one row per column moves."""
    v = F.col("value")
    text = trim_space(v)
    filled = F.coalesce(text != "", F.lit(False))
    with_text = N.plain_number(text).isNull() & F.regexp_replace(text, "[A-Za-z%]", "").rlike(NUMERIC_SHAPE)
    return cells(df, columns).select("column", filled.alias("filled"), (v != text).alias("spaced"), with_text.alias("with_text")).groupBy("column").agg(
        F.count("*").alias("n_rows"), F.count_if(~F.col("filled")).alias("missing"),
        F.count_if(F.col("filled") & F.col("spaced")).alias("whitespace"),
        F.count_if(F.col("filled") & F.col("with_text")).alias("numeric_with_text"))


def _filled() -> Column:
    return F.col("n_rows") - F.col("missing")


def _counted_type() -> Column:
    """The first rule, in this order, that enough values satisfy; null where only the number of different values tells."""
    n = F.greatest(_filled(), F.lit(1))
    return (
        F.when(_filled() == 0, "empty")
        .when(F.col("n_date") / n > 0.7, "date")
        .when(F.col("n_currency") / n > 0.5, "currency")
        .when((F.col("n_number") + F.col("with_text")) / n > 0.8, "number")
        .when(F.col("n_flag") / n > 0.8, "boolean")
    )


def with_types(statistics: DataFrame) -> DataFrame:
    """The inferred type of every column."""
    few = F.col("distinct") <= F.greatest(F.lit(20.0), F.greatest(_filled(), F.lit(1)) * 0.1)
    kind = F.coalesce(_counted_type(), F.when(few, "category").otherwise("text"))
    return statistics.select("*", kind.alias("type"), _filled().alias("filled"))


def column_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type) of every column.

    The cells are counted where they lie. Values are grouped only of the columns whose type these
    counts leave open, so numbers and dates, of which nearly every one differs, are not moved.
    """
    states = column_states(df, columns).select("column", "n_rows", "missing", "n_date", "n_currency", "n_number", "with_text", "n_flag")
    states = materialise(states, "states")
    left = {r["column"] for r in states.where(_counted_type().isNull()).select("column").collect()}  # one row per column
    if left:
        facts = value_facts(value_counts(df, [c for c in columns if c in left])).select("column", "distinct")
        statistics = states.join(facts, "column", "left")
    else:
        statistics = states.withColumn("distinct", F.lit(None).cast("bigint"))
    return with_types(statistics).select("column", "type")


def outlier_counts(numbers: DataFrame, k: float = 1.5) -> DataFrame:
    """Per column how many of its numbers, (column, number) rows, lie outside the quartile fences."""
    fences = exact_quantiles(numbers, ["column"], "number", [0.25, 0.75], few_keys=True)
    reach = (F.col("q1") - F.col("q0")) * k
    outside = (F.col("number") < F.col("q0") - reach) | (F.col("number") > F.col("q1") + reach)
    # One row per column of the table on the right.
    return numbers.join(F.broadcast(fences), "column").groupBy("column").agg(F.count_if(outside & (F.col("total") >= MIN_OUTLIER_VALUES)).alias("outliers"))


def samples(counts: DataFrame, k: int = 5) -> DataFrame:
    """The k smallest distinct values of every column.

    A rank filter this small is applied inside each map task before anything is moved.
    """
    first = Window.partitionBy("column").orderBy("value")
    top = counts.where("value is not null").select("column", "value", F.row_number().over(first).alias("r"))
    return top.where(F.col("r") <= k).groupBy("column").agg(
        F.array_join(F.sort_array(F.collect_list("value")), "|").alias("samples"))


def inconsistent_case(counts: DataFrame) -> DataFrame:
    """Columns where two values differ only in case."""
    return counts.where("value is not null").groupBy("column", F.lower("value").alias("folded")).agg(
        F.count("*").alias("spellings")).where("spellings > 1").groupBy("column").agg(
        F.count("*").alias("folded_values"))


def profile(df: DataFrame, columns: list[str], statistics: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """One row per column; `statistics` and `counts` are those of the table where they are already at hand."""
    if counts is None:
        counts = materialise(value_counts(df, columns), "values")  # grouped once, read three times
    typed = with_types(statistics if statistics is not None else column_statistics(column_states(df, columns), counts))
    # the quartiles look at the numbers several times; read from the text once, they are a narrow table
    numbers = materialise(judged_cells(df, columns).where("number is not null").select("column", "number"), "numbers")
    numeric = F.col("type").isin("number", "currency")
    # Every frame joined here has at most one row per column.
    joined = typed.join(outlier_counts(numbers), "column", "left").join(samples(counts), "column", "left").join(
        inconsistent_case(counts), "column", "left")
    return joined.select(
        "column", "type", "n_rows", "missing",
        F.floor(F.col("missing") / F.col("n_rows") * 100 + 0.5).cast("bigint").alias("missing_pct"),
        F.col("distinct").alias("unique_values"),
        F.when(numeric, F.col("lo")).alias("min"),
        F.when(numeric, F.col("hi")).alias("max"),
        F.when(numeric, N.round_half_up(F.col("total") / F.col("n_number"), 4)).alias("mean"),
        F.coalesce("samples", F.lit("")).alias("samples"),
        F.col("spaced").alias("whitespace"),
        F.col("with_text").alias("numeric_with_text"),
        F.when(numeric, F.coalesce("outliers", F.lit(0))).otherwise(0).alias("outliers"),
        ((F.col("type") == "category") & (F.coalesce("folded_values", F.lit(0)) > 0)).alias("inconsistent_case"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact repeats beyond the first of each row."""
    groups = df.groupBy(*[F.col(quoted(c)) for c in df.columns]).agg(F.count("*").alias("_times"))
    return groups.agg(
        F.coalesce(F.sum("_times"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("_times") - 1), F.lit(0)).alias("duplicates"))


def quality_issues(df: DataFrame, columns: list[str], by_profile: DataFrame | None = None) -> DataFrame:
    """One row per detected problem, with how many rows it affects and how bad it is.

    `by_profile` is the table's profile where it is already at hand.
    """
    def issue(kind, affected, severity, fixable):
        return F.struct(F.lit(kind).alias("type"), affected.cast("bigint").alias("affected_rows"),
                        severity.alias("severity"), F.lit(fixable).alias("auto_fixable"))

    low, medium, high = F.lit("LOW"), F.lit("MEDIUM"), F.lit("HIGH")
    empty, numeric = F.col("type") == "empty", F.col("type").isin("number", "currency")
    share = F.col("missing_pct")
    missing_severity = F.when(share > 40, high).when(share > 10, medium).otherwise(low)
    odd_name = F.col("column").rlike("[^A-Za-z0-9 _]") | (F.col("column") != trim_space(F.col("column")))
    found = F.array_compact(F.array(
        F.when(empty, issue("empty_column", F.col("n_rows"), medium, True)),
        F.when(~empty & (F.col("missing") > 0), issue("missing_values", F.col("missing"), missing_severity, True)),
        F.when(numeric & (F.col("numeric_with_text") > 0),
               issue("numeric_with_text", F.col("numeric_with_text"), medium, True)),
        F.when(F.col("whitespace") > 0, issue("whitespace", F.col("whitespace"), low, True)),
        F.when(F.col("inconsistent_case"), issue("inconsistent_case", F.lit(0), low, True)),
        F.when(F.col("outliers") > 0, issue("outliers", F.col("outliers"), low, False)),
        F.when(odd_name, issue("suspicious_column_name", F.lit(0), low, False)),
    ))
    by_column = (by_profile if by_profile is not None else profile(df, columns)).select("column", "n_rows", F.explode(found).alias("i")).select(
        "i.type", "column", "i.affected_rows", "i.severity", "i.auto_fixable", "n_rows")
    times = duplicate_rows(df.select(*[F.col(quoted(c)) for c in columns]))
    repeated = times.where("duplicates > 0").select(
        F.lit("duplicate_rows").alias("type"), F.lit(None).cast("string").alias("column"),
        F.col("duplicates").cast("bigint").alias("affected_rows"),
        F.when(F.col("duplicates") > F.col("n_rows") * 0.05, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.lit(True).alias("auto_fixable"), "n_rows")
    return by_column.unionByName(repeated)


def quality_score(issues: DataFrame) -> DataFrame:
    """100 minus a penalty per issue, weighted by severity and share of rows."""
    weight = F.when(F.col("severity") == "HIGH", 8.0).when(F.col("severity") == "MEDIUM", 4.0).otherwise(1.5)
    affected = F.when(F.col("affected_rows") == 0, 0.2).otherwise(F.col("affected_rows") / F.col("n_rows"))
    penalty = F.sum(weight * (0.4 + 0.6 * F.least(F.lit(1.0), affected)))
    score = F.floor(100 - F.coalesce(penalty, F.lit(0.0)) + 0.5)
    return issues.agg(F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("bigint").alias("score"),
                      F.count("*").alias("issues"))


# --- single columns -----------------------------------------------------------------------


def zscore_outliers(df: DataFrame, column: str, threshold: float = 3.0) -> DataFrame:
    """Rows at least `threshold` population standard deviations from the mean, with `z`."""
    x = F.col(quoted(column))
    stats = df.agg(F.struct(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"))).scalar()
    z = F.when(F.col("_s.sd") > 0, (x - F.col("_s.mean")) / F.col("_s.sd"))
    return df.select("*", stats.alias("_s")).withColumn("z", z).drop("_s").where(F.abs("z") >= threshold)


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences."""
    x = F.col(quoted(column))
    fences = exact_quantiles(df.select(x.cast("double").alias("x")), [], "x", [0.25, 0.75]).select(F.struct("q0", "q1")).scalar()
    reach = (F.col("_f.q1") - F.col("_f.q0")) * k
    held = df.select("*", fences.alias("_f"))
    return held.where((x < F.col("_f.q0") - reach) | (x > F.col("_f.q1") + reach)).drop("_f")


