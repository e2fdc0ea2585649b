"""Value tiers, recency-frequency-money tables, clusters and churn risk."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType

from tallyloom.functions.dates import day_of
from tallyloom.functions.numbers import exact_sum, round2, round_half_up
from tallyloom.functions.strings import row_identity, tidy_key
from tallyloom.operators.quantiles import exact_quantiles
from tallyloom.operators.shapley import explain
from tallyloom.session import materialise

# --- value tiers ------------------------------------------------------------------------------------


def value_tiers(totals: DataFrame, member: str, members_shown: int = 12) -> DataFrame:
    """Members with positive totals (`value`) split at the median and the upper quartile.

    The quartiles are exact and found without gathering the members anywhere; the names
    shown are the largest few of each tier, picked inside each task first.
    """
    v = F.col("value")
    positive = materialise(totals.where(v > 0).select(F.col(member).alias("member"), v.alias("value")), "totals")
    cuts = exact_quantiles(positive, [], "value", [0.5, 0.75]).select(F.struct("q0", "q1")).scalar()
    tiered = positive.select("*", cuts.alias("_c")).select(
        "member", "value", F.col("_c.q0").alias("median"), F.col("_c.q1").alias("q3"),
        F.when(v >= F.col("_c.q1"), "high").when(v >= F.col("_c.q0"), "mid").otherwise("low").alias("tier"))
    whole = positive.agg(exact_sum("value")).scalar()
    sums = tiered.groupBy("tier").agg(F.count("*").alias("members"), exact_sum("value").alias("_t"), F.max("median").alias("median"), F.max("q3").alias("q3"))
    first = Window.partitionBy("tier").orderBy(F.desc("value"), "member")
    names = tiered.select("tier", "member", F.row_number().over(first).alias("r")).where(F.col("r") <= members_shown).groupBy("tier").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "member"))), lambda x: x["member"]), ", ").alias("top_members"))
    total = round2(F.col("_t"))
    return sums.join(names, "tier").select(
        "tier", "members", total.alias("total"), round2(total / F.col("members")).alias("average"),
        round2(F.col("_t") / whole * 100).alias("share_pct"), round2(F.col("median")).alias("median"), round2(F.col("q3")).alias("q3"), "top_members")


# --- orders and RFM ---------------------------------------------------------------------------------


def with_order_keys(df: DataFrame, customer: str, date: str, order: str | None, row_id: str) -> DataFrame:
    """Rows with a usable order key in `order_key`.

    No order column, or one that is blank in every row: one order per customer and date. A
    blank id here and there: an order of its own, so its revenue is not lost.
    """
    fallback = row_identity(F.col(customer), F.col(date))
    if order is None:
        return df.withColumn("order_key", fallback)
    key = tidy_key(F.col(order))
    any_key = df.agg(F.max(key.isNotNull())).scalar()
    return df.select("*", key.alias("_k"), any_key.alias("_any")).withColumn(
        "order_key", F.when(F.col("_any"), F.coalesce("_k", F.concat(F.lit("row-"), F.col(row_id).cast("string")))).otherwise(fallback)
    ).drop("_k", "_any")


def order_key_report(df: DataFrame, order: str) -> DataFrame:
    """How many rows carry no order id, and what is done about it."""
    one = df.agg(F.count("*").alias("n_rows"), F.count_if(tidy_key(F.col(order)).isNull()).alias("blank"))
    return one.select("*", F.when(F.col("blank") == F.col("n_rows"), "dates stand in for orders")
                      .when(F.col("blank") > 0, "blank ids count as orders of their own").otherwise("").alias("warning"))


def usable(df: DataFrame, customer: str, date: str, revenue: str) -> DataFrame:
    """Rows with a customer, a day and an amount; written customer keys are tidied."""
    key = F.col(customer)
    if isinstance(df.schema[customer].dataType, StringType):
        key = tidy_key(key)
    day = day_of(F.col(date))
    return df.withColumn(customer, key).withColumn(date, day).where(
        F.col(customer).isNotNull() & F.col(date).isNotNull() & F.col(revenue).isNotNull() & ~F.isnan(F.col(revenue).cast("double")))


def rfm(df: DataFrame, customer: str, date: str, order: str | None, revenue: str) -> DataFrame:
    """Per customer: days since the last purchase, number of orders, total spend.

    Rows without a customer, a day or an amount take no part.
    """
    df = usable(df, customer, date, revenue)
    counted = F.count_distinct(order) if order else F.count_distinct(date)
    # one row per customer, grouped once: the last purchase of all is the latest of theirs
    each = materialise(df.groupBy(customer).agg(F.max(date).alias("_last"), counted.alias("frequency"), exact_sum(revenue).alias("_m")), "customers")
    as_of = each.agg(F.max("_last")).scalar()
    return each.select(customer, F.datediff(as_of, "_last").alias("recency_days"), "frequency", round2(F.col("_m")).alias("monetary"))


MIN_CUSTOMERS_TO_CLUSTER = 50
MIN_SILHOUETTE = 0.15
CLUSTER_RANGE = range(2, 7)
MAX_SILHOUETTE_SAMPLE, STARTS = 10_000, 3


def silhouettes(rows: DataFrame, labels: list[str], features: str) -> dict[str, float]:
    """The mean silhouette of each labelling, by plain distances between all pairs of a sample.

    The sample is at most MAX_SILHOUETTE_SAMPLE rows, by a hash of the row's `member`; up to that
    many rows it is all of them. It is sent to every task, which compares its share of it.
    """
    sample = materialise(rows.orderBy(F.xxhash64("member"), "member").limit(MAX_SILHOUETTE_SAMPLE).select(features, *labels), "sample")
    whole = sample.toArrow()  # bounded: MAX_SILHOUETTE_SAMPLE rows
    points = np.array(whole.column(features).to_pylist(), np.float64)
    given = {c: whole.column(c).to_numpy() for c in labels}
    held = rows.sparkSession.sparkContext.broadcast((points, given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, given = held.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                mine = np.array(part.column(0).to_pylist(), np.float64)
                far = np.sqrt(((mine[:, None, :] - points[None]) ** 2).sum(axis=2))
                out = []
                for c in labels:
                    own = part.column(c).to_numpy()
                    kinds, place = np.unique(given[c], return_inverse=True)
                    sums = far @ (place[:, None] == np.arange(len(kinds)))
                    sizes = np.bincount(place, minlength=len(kinds))
                    at = np.searchsorted(kinds, own)
                    within = sums[np.arange(len(own)), at] / np.maximum(sizes[at] - 1, 1)
                    means = sums / sizes
                    means[np.arange(len(own)), at] = np.inf
                    outside = means.min(axis=1)
                    score = (outside - within) / np.maximum(np.maximum(within, outside), 1e-300)
                    out.append(np.where((sizes[at] == 1) | ~np.isfinite(outside), 0.0, score))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=labels)

    dealt = sample.repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    one = dealt.mapInArrow(run, ", ".join(f"{c} double" for c in labels)).agg(*[F.avg(c).alias(c) for c in labels]).first()
    return {c: one[c] or 0.0 for c in labels}


def cluster(table: DataFrame, seed: int = 42) -> tuple[DataFrame, list[tuple[int, float]]]:
    """Customers of an RFM table with a `cluster`, and the separation each count of clusters reached.

    Of several seeded starts of each count the tightest is kept; the separation is a silhouette
    by plain distances, which its floor is made for.
    """
    logged = table.select("*", *[F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))).alias(f"_{c}")
                                 for c in ("recency_days", "frequency", "monetary")])
    raw = VectorAssembler(inputCols=["_recency_days", "_frequency", "_monetary"], outputCol="_raw").transform(logged)
    scaled = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(raw).transform(raw)
    scaled = materialise(scaled, "scaled")  # read by every fit
    customers = scaled.count()
    counts = [k for k in CLUSTER_RANGE if k < customers] if customers >= MIN_CUSTOMERS_TO_CLUSTER else []
    labelled = scaled.withColumn("member", F.col(table.columns[0])).withColumn("point", vector_to_array("features"))
    for k in counts:
        fits = [KMeans(k=k, seed=seed + start, featuresCol="features", predictionCol=f"cluster_{k}").fit(scaled) for start in range(STARTS)]
        labelled = min(fits, key=lambda fit: fit.summary.trainingCost).transform(labelled)
    found = silhouettes(labelled, [f"cluster_{k}" for k in counts], "point") if counts else {}
    scores = [(k, found[f"cluster_{k}"]) for k in counts]
    best = max(scores, key=lambda s: (s[1], -s[0]), default=None)
    if best is None or best[1] < MIN_SILHOUETTE:
        return table.withColumn("cluster", F.lit(None).cast("int")), scores
    return labelled.select(*table.columns, F.col(f"cluster_{best[0]}").alias("cluster")), scores


def describe_clusters(clustered: DataFrame) -> DataFrame:
    """Size, share and centre of each cluster, named from how recent and how valuable it is."""
    whole = Window.partitionBy(F.lit(1))  # at most six clusters
    centres = clustered.groupBy("cluster").agg(
        F.count("*").alias("size"), F.avg("recency_days").alias("recency_days"), F.avg("frequency").alias("frequency"),
        F.avg("monetary").alias("monetary"), F.sum("monetary").alias("revenue"))

    def average_rank(column):
        order = Window.partitionBy(F.lit(1)).orderBy(column)
        return F.rank().over(order) + (F.count("*").over(Window.partitionBy(column)) - 1) / 2.0

    def unit(column):
        low, high = F.min(column).over(whole), F.max(column).over(whole)
        return F.when(high > low, (F.col(column) - low) / F.nullif(high - low, F.lit(0.0))).otherwise(0.5)

    ranked = centres.select("*", average_rank(-F.col("recency_days")).alias("_r"),
                            (average_rank(F.col("frequency")) + average_rank(F.col("monetary"))).alias("_fm")).select(
        "*", average_rank(F.col("_fm")).alias("_v")).select("*", unit("_r").alias("_recent"), unit("_v").alias("_value"))
    recent, value = F.col("_recent"), F.col("_value")
    name = (F.when((recent >= 0.6) & (value >= 0.6), "Champions").when((recent >= 0.6) & (value <= 0.4), "New")
            .when((recent <= 0.4) & (value >= 0.6), "At risk").when((recent <= 0.4) & (value <= 0.4), "Hibernating").otherwise("Loyal"))
    same = Window.partitionBy("_name")
    number = F.row_number().over(same.orderBy(F.desc("monetary"), "cluster")).cast("string")
    return ranked.select("*", name.alias("_name")).select(
        "cluster", F.when(F.count("*").over(same) > 1, F.concat_ws(" ", "_name", number)).otherwise(F.col("_name")).alias("name"),
        "size", round2(F.col("revenue")).alias("revenue"), round_half_up(F.col("revenue") / F.sum("revenue").over(whole), 4).alias("revenue_share"),
        round_half_up(F.col("recency_days"), 1).alias("recency_days"), round2(F.col("frequency")).alias("frequency"), round2(F.col("monetary")).alias("monetary"))


def highest(df: DataFrame, by: str, tie: str, limit: int | None = None) -> DataFrame:
    """The rows listed in a result, all without a limit; totals are computed elsewhere and cover everyone."""
    ordered = df.orderBy(F.desc(by), tie)
    return ordered if limit is None else ordered.limit(limit)


# --- churn --------------------------------------------------------------------------------------------

FALLBACK_GAP_DAYS = 30.0
GAP_MULTIPLE = 2.0
MIN_SPAN_DAYS, MIN_CUSTOMERS, MIN_EXAMPLES, MIN_AUC = 365, 100, 20, 0.6
FEATURES = ["recency_days", "frequency", "tenure_days", "avg_order_value", "spend_trend", "gap_sd"]


def churn_features(rows: DataFrame, cut: datetime.date) -> DataFrame:
    """What is known of each customer at the end of `cut`.

    `rows` has `customer`, `order_key`, `date`, `revenue`. Orders are summed to one row per
    customer and day before any window runs, so the longest window is as long as the
    calendar, even for a customer who places a third of all orders.
    """
    history = rows.where(F.col("date") <= F.lit(cut))
    orders = history.groupBy("customer", "order_key").agg(F.min("date").alias("day"), exact_sum("revenue").alias("revenue"))
    days = orders.groupBy("customer", "day").agg(F.count("*").alias("c"), exact_sum("revenue").alias("r"))
    by_day = Window.partitionBy("customer").orderBy("day")
    whole = Window.partitionBy("customer")
    upto = F.sum("c").over(by_day)
    walked = days.select(
        "*", F.datediff("day", F.lag("day").over(by_day)).alias("gap"), (upto - F.col("c")).alias("before"), upto.alias("upto"),
        F.floor(F.sum("c").over(whole) / 2).alias("half"))
    # Several orders on one day are gaps of 0.
    gaps = walked.select("customer", F.inline(F.array(
        F.struct(F.col("gap").cast("double").alias("g"), F.when(F.col("gap").isNotNull(), 1).otherwise(0).cast("bigint").alias("k")),
        F.struct(F.lit(0.0).alias("g"), (F.col("c") - 1).alias("k"))))).where("k > 0")
    # Gaps are whole days, so a customer has at most as many distinct ones as the data has days.
    rhythm = gaps.groupBy("customer").agg(
        F.expr("percentile(g, 0.5, k)").alias("own_gap"), F.sum("k").alias("n"),
        F.sum(F.col("g") * F.col("k")).alias("s"), F.sum(F.col("g") * F.col("g") * F.col("k")).alias("ss"))
    population = F.coalesce(rhythm.agg(F.expr("percentile(own_gap, 0.5)")).scalar(), F.lit(FALLBACK_GAP_DAYS))
    variance = F.greatest(F.col("ss") - F.col("s") * F.col("s") / F.col("n"), F.lit(0.0)) / F.nullif(F.col("n") - 1, F.lit(0))

    # The first half of a customer's orders: whole days, and on the day it ends the first few by key.
    split = walked.where("before < half and upto > half").select("customer", "day", (F.col("half") - F.col("before")).alias("take"))
    on_split = orders.join(split, ["customer", "day"]).select("customer", "revenue", "take", F.row_number().over(
        Window.partitionBy("customer", "day").orderBy("order_key")).alias("i"))
    part = on_split.where("i <= take").groupBy("customer").agg(exact_sum("revenue").alias("part"))

    base = walked.groupBy("customer").agg(
        F.max("day").alias("last"), F.min("day").alias("first"), F.sum("c").alias("orders"), exact_sum("r").alias("revenue"),
        F.coalesce(exact_sum(F.when(F.col("upto") <= F.col("half"), F.col("r"))), F.lit(0.0)).alias("full_days"))
    joined = base.join(rhythm, "customer", "left").join(part, "customer", "left").select("*", population.alias("_population"))
    earlier = F.col("full_days") + F.coalesce("part", F.lit(0.0))
    own = F.nullif(F.col("own_gap"), F.lit(0.0))
    end = F.lit(cut)
    return joined.select(
        "customer", F.datediff(end, "last").cast("double").alias("recency_days"), F.col("orders").cast("double").alias("frequency"),
        F.datediff(end, "first").cast("double").alias("tenure_days"), (F.col("revenue") / F.col("orders")).alias("avg_order_value"),
        F.when(F.col("orders") < 2, 0.0).otherwise((F.col("revenue") - earlier - earlier) / (earlier + 1.0)).alias("spend_trend"),
        F.coalesce(F.sqrt(variance), F.lit(0.0)).alias("gap_sd"), "revenue", F.coalesce(own, "_population").alias("typical_gap"))


def churn_labels(rows: DataFrame, features: DataFrame, label_at: datetime.date, multiple: float = GAP_MULTIPLE) -> DataFrame:
    """Features with `churned`: silent at `label_at` for longer than the customer's own rhythm allows."""
    latest = rows.where(F.col("date") <= F.lit(label_at)).groupBy("customer").agg(F.max("date").alias("_latest"))
    silence = F.datediff(F.lit(label_at), "_latest")
    return features.join(latest, "customer").withColumn("churned", (silence > F.col("typical_gap") * multiple).cast("int")).drop("_latest")


def time_cuts(rows: DataFrame) -> dict:
    """The days the training and the test window end on, from one row of span."""
    one = rows.agg(F.min("date").alias("a"), F.max("date").alias("z")).first()
    if one["a"] is None:  # no purchase at all: any day will do, the span refuses the model
        return {"span": 0} | {k: datetime.date(1970, 1, 1) for k in ("end", "train", "test")}
    span = (one["z"] - one["a"]).days
    return {"span": span, "end": one["z"], "train": one["a"] + datetime.timedelta(days=int(span * 0.5)),
            "test": one["a"] + datetime.timedelta(days=int(span * 0.75))}


def training_windows(rows: DataFrame, cuts: dict, multiple: float = GAP_MULTIPLE) -> tuple[DataFrame, DataFrame]:
    """Training and test examples; the test window lies strictly after the training one."""
    train = churn_labels(rows, churn_features(rows, cuts["train"]), cuts["test"], multiple)
    return train, churn_labels(rows, churn_features(rows, cuts["test"]), cuts["end"], multiple)


def window_report(train: DataFrame, test: DataFrame, cuts: dict, customers: int) -> DataFrame:
    """One row: how many examples each side holds and, where training is refused, why."""
    def side(df, name):
        return df.agg(F.lit(name).alias("side"), F.count("*").alias("n"), F.sum("churned").alias("churned"))

    rows = side(train, "train").unionByName(side(test, "test"))
    one = rows.agg(*[F.max(F.when(F.col("side") == s, F.col(c))).alias(f"{s}_{c}") for s in ("train", "test") for c in ("n", "churned")])

    def few(s):
        return (F.col(f"{s}_churned") < MIN_EXAMPLES) | (F.col(f"{s}_n") - F.col(f"{s}_churned") < MIN_EXAMPLES) | F.col(f"{s}_churned").isNull()

    return one.select("*", F.lit(cuts["span"]).alias("span_days"), F.lit(customers).alias("customers"),
                      F.when(F.lit(cuts["span"] < MIN_SPAN_DAYS), "the data covers too few days")
                      .when(F.lit(customers < MIN_CUSTOMERS), "too few customers have usable history")
                      .when(few("train"), "the training period holds too few of one kind")
                      .when(few("test"), "the test period holds too few of one kind").alias("reason"))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def _risk(model, df: DataFrame) -> DataFrame:
    scored = model.transform(_assembled(df))
    return scored.withColumn("risk", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def churn_scores(rows: DataFrame, threshold: float = 0.5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Every customer's risk today, and the model's report: its accuracy on the later window,
    or the reason it is not used."""
    # Every cut below starts from one row per customer, order and day, joined and summed once.
    bought = usable(rows, "customer", "date", "revenue").groupBy("customer", "order_key", "date")
    rows = materialise(bought.agg(exact_sum("revenue").alias("revenue")), "purchases")
    cuts = time_cuts(rows)
    customers = rows.select("customer").distinct().count()
    # Fitting passes over its examples many times; a fixed order makes it repeatable.
    train, test = (materialise(d.repartition("customer").sortWithinPartitions("customer"), "examples") for d in training_windows(rows, cuts))
    report = window_report(train, test, cuts, customers)
    none = churn_features(rows, cuts["end"]).withColumn("risk", F.lit(None).cast("double"))
    if report.first()["reason"] is not None:
        return none, _empty_summary(report.select("reason"))
    model = GBTClassifier(labelCol="churned", featuresCol="features", seed=seed).fit(_assembled(train))
    judged = model.transform(_assembled(test))
    auc = BinaryClassificationEvaluator(labelCol="churned").evaluate(judged)
    if auc < MIN_AUC:
        return none, _empty_summary(report.select(F.lit("the model is no better than guessing").alias("reason"), F.lit(auc).alias("auc")))
    at_risk = vector_to_array("probability")[1] >= threshold
    hit = F.count_if(at_risk & (F.col("churned") == 1))
    summary = judged.agg(
        F.lit(None).cast("string").alias("reason"), F.lit(auc).alias("auc"),
        (hit / F.nullif(F.count_if(at_risk), F.lit(0))).alias("precision"),
        (hit / F.nullif(F.count_if(F.col("churned") == 1), F.lit(0))).alias("recall"), F.count("*").alias("test_customers"),
        F.avg("churned").alias("test_churn_rate"))
    scored = with_factors(_risk(model, churn_features(rows, cuts["end"])), model)
    high = F.col("risk") >= threshold
    today = scored.agg(
        F.count("*").alias("customers"), F.count_if(high).alias("high_risk_customers"),
        round2(F.coalesce(exact_sum(F.when(high, F.col("revenue"))), F.lit(0.0))).alias("revenue_at_risk"))
    return scored, summary.select("*", today.select(F.struct("*")).scalar().alias("_t"), *[
        F.lit(cuts[k]).alias(f"{k}_day") for k in ("train", "test", "end")]).select("*", "_t.*").drop("_t")


def _empty_summary(reason: DataFrame) -> DataFrame:
    """The report of a refused model: its reason, and no figures."""
    return reason if "auc" in reason.columns else reason.withColumn("auc", F.lit(None).cast("double"))


def with_factors(scored: DataFrame, model, top: int = 3) -> DataFrame:
    """The features that move each customer's risk most, by their Shapley values.

    A feature's value is its fair share of how far the customer's margin is from the mean, over
    all orders in which the features could become known; the values of a row add up to just that.
    """
    out = explain(scored, FEATURES, model)
    impacts = F.sort_array(F.array(*[F.struct(
        F.abs(F.get("shapley", F.lit(i))).alias("size"), F.lit(f).alias("feature"), F.get("shapley", F.lit(i)).alias("impact")) for i, f in enumerate(FEATURES)]), asc=False)
    named = F.transform(F.slice(impacts, 1, top), lambda x: F.concat(
        x["feature"], F.when(x["impact"] > 0, " raises").otherwise(" lowers")))
    return out.withColumn("factors", F.array_join(named, ", ")).drop("shapley")


def status_row(frame: DataFrame, checks: list[tuple[Column, str]]) -> DataFrame:
    """Each row with `status` and `reason`: the first failed check, or ok."""
    reason = F.lit(None).cast("string")
    for fails, text in reversed(checks):
        reason = F.when(fails, F.lit(text)).otherwise(reason)
    return frame.select("*", F.when(reason.isNull(), "ok").otherwise("insufficient_data").alias("status"), reason.alias("reason"))
