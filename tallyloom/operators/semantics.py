"""Business meanings of columns, for the columns of many tables at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Meaning and the name patterns that carry it, in the order they are tried.
BASE_RULES = [
    ("order_id", ["^order[_ ]?id$", "^order[_ ]?no", "^invoice", "^transaction[_ ]?id"]),
    ("customer_id", ["^customer[_ ]?id$", "^cust[_ ]?id", "^client[_ ]?id"]),
    ("customer_name", ["customer[_ ]?name", "client[_ ]?name", "^customer$", "^client$"]),
    ("product_id", ["^product[_ ]?id$", "^sku$", "^item[_ ]?id"]),
    ("product_name", ["product[_ ]?name", "^product$", "^item[_ ]?name", "^item$"]),
    ("unit_price", ["unit[_ ]?price", "^price$", "price[_ ]?each"]),
    ("revenue", ["revenue", "^sales[_ ]?amount", "^total[_ ]?sales", "^amount$", "gross[_ ]?sales"]),
    ("sales", ["^sales$", "net[_ ]?sales"]),
    ("cost", ["^cost$", "cogs", "cost[_ ]?of[_ ]?goods", "unit[_ ]?cost"]),
    ("profit", ["profit", "margin", "net[_ ]?income"]),
    ("quantity", ["quantity", "^qty$", "units[_ ]?sold", "^units$"]),
    ("date", ["date", "^day$", "timestamp", "period", "^month$"]),
    ("region", ["region", "territory", "zone"]),
    ("state", ["^state$", "province"]),
    ("city", ["^city$", "town"]),
    ("category", ["category", "^segment$", "product[_ ]?type", "^type$"]),
    ("department", ["department", "^dept", "division"]),
    ("inventory", ["inventory", "stock", "on[_ ]?hand"]),
]

# The patterns an industry tries before the base ones.
INDUSTRY_RULES = {
    "retail": [],
    "pharmacy": [
        ("prescription_id", ["prescription", "rx[_ ]?(no|id)", "^rx$"]),
        ("medicine_name", ["medicine", "drug", "^med(icine)?[_ ]?name$", "^med$"]),
        ("patient_id", ["patient", "^mrn$"]),
        ("revenue", ["bill[_ ]?amount", "total[_ ]?price", "net[_ ]?amount", "amount"]),
    ],
    "saas": [
        ("subscription_id", ["subscription", "^sub[_ ]?id"]),
        ("plan", ["plan", "tier", "^package$"]),
        ("revenue", ["mrr", "arr", "monthly[_ ]?recurring", "recurring[_ ]?revenue", "amount"]),
        ("customer_name", ["account[_ ]?name", "^account$", "company", "^org(anization)?$"]),
        ("customer_id", ["account[_ ]?id", "^user[_ ]?id$"]),
    ],
    "services": [
        ("customer_name", ["client", "customer"]),
        ("department", ["service[_ ]?line", "practice"]),
        ("date", ["work[_ ]?date", "service[_ ]?date"]),
        ("revenue", ["revenue", "billing", "billings"]),
        ("quantity", ["billable[_ ]?hours", "hours"]),
    ],
    "manufacturing": [
        ("product_name", ["product", "sku"]),
        ("quantity", ["units", "quantity", "produced"]),
        ("date", ["production[_ ]?date", "manufacture[_ ]?date", "date"]),
        ("category", ["line", "machine", "plant"]),
        ("revenue", ["revenue", "sales"]),
    ],
}

# The meanings that speak for an industry, in the order industries are tried.
INDUSTRY_SIGNALS = {
    "retail": ["order_id", "product_name", "region", "category"],
    "saas": ["subscription_id", "plan"],
    "pharmacy": ["prescription_id", "medicine_name", "patient_id"],
    "services": ["billable_hours", "total_hours"],
    "manufacturing": ["defect", "production", "machine"],
}
MIN_SIGNALS = 2

# Words that name an industry when its signals do not, in the order they are tried.
INDUSTRY_WORDS = [
    ("saas", "monthly recurring|subscription|churn|plan|license seat|seat"),
    ("pharmacy", "prescription|pharmacy|drug|medication|expiry"),
    ("services", "billable|timesheet|utilization|consulting|service level"),
    ("manufacturing", "defect|rework|scrap|production|batch|machine|shift"),
    ("retail", "customer|order|product|category|region|retail|store"),
]


def rule_table(spark, industry: str | None = None) -> DataFrame:
    """The rules in the order they are tried, as a table of fixed size."""
    rules = INDUSTRY_RULES.get(industry, []) + BASE_RULES
    rows = [(r, p, meaning, pattern) for r, (meaning, patterns) in enumerate(rules) for p, pattern in enumerate(patterns)]
    return spark.createDataFrame(rows, "rule int, place int, semantic string, pattern string")


def detect_semantics(columns: DataFrame, industry: str | None = None) -> DataFrame:
    """The meaning of every column.

    `columns` has one row per column: `table_name`, `position`, `column`, `type`. The first
    matching rule gives the meaning; a date must hold dates; the first column of a table
    with a meaning is the one mapped to it.
    """
    rules = rule_table(columns.sparkSession, industry)
    # The rule table has a fixed size of well under a hundred rows.
    matched = columns.join(F.broadcast(rules), F.expr("lower(trim(`column`)) rlike pattern"), "left")
    first = matched.groupBy("table_name", "position", "column", "type").agg(
        F.min_by(F.struct("semantic", "pattern"), F.when(F.col("rule").isNotNull(), F.struct("rule", "place"))).alias("m"))
    usable = ~((F.col("m.semantic") == "date") & (F.col("type") != "date"))
    named = first.select(
        "table_name", "position", "column", "type",
        F.when(usable, F.col("m.semantic")).alias("semantic"), F.when(usable, F.col("m.pattern")).alias("pattern"))
    place = Window.partitionBy("table_name", "semantic").orderBy("position")
    mapped = F.col("semantic").isNotNull() & (F.row_number().over(place) == 1)
    return named.select(
        "table_name", "column", F.coalesce("semantic", F.lit("none")).alias("semantic"),
        mapped.alias("mapped"), F.when(mapped, F.col("pattern")).alias("matched_by"))


def suggest_industry(columns: DataFrame) -> DataFrame:
    """Per table the industry with the most of its signals found, if it has at least two;
    failing that, the first one whose words appear among the column names."""
    scored = None
    for order, (industry, signals) in enumerate(INDUSTRY_SIGNALS.items()):
        found = detect_semantics(columns, industry).where(F.col("mapped") & F.col("semantic").isin(signals))
        one = found.groupBy("table_name").agg(F.count("*").alias("score")).select(
            "table_name", F.lit(industry).alias("industry"), F.lit(order).alias("order"), "score")
        scored = one if scored is None else scored.unionByName(one)
    best = scored.where(F.col("score") >= MIN_SIGNALS).groupBy("table_name").agg(
        F.max_by(F.struct("industry", "score"), F.struct("score", -F.col("order"))).alias("b"))
    # Column names only: a few words per table.
    names = columns.groupBy("table_name").agg(F.lower(F.concat_ws(" ", F.collect_list("column"))).alias("words"))
    word = F.when(F.lit(False), F.lit(""))
    for industry, pattern in INDUSTRY_WORDS:
        word = word.when(F.col("words").rlike(pattern), industry)
    return names.join(best, "table_name", "left").select(
        "table_name", F.coalesce("b.industry", F.lit("generic")).alias("industry"),
        F.coalesce("b.score", F.lit(0)).alias("signals"), word.otherwise("generic").alias("by_words"))
