"""What is bought together."""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from tallyloom.functions.numbers import round2, round_half_up
from tallyloom.functions.strings import tidy_key
from tallyloom.operators.customers import status_row
from tallyloom.session import materialise

MIN_ORDERS, MIN_MULTI_SHARE, MIN_MEAN_BASKET = 200, 0.15, 1.2
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.01, 0.10, 1.0


def basket_rows(df: DataFrame, order: str, product: str) -> DataFrame:
    """Each product of each order once; rows without either key are left out."""
    rows = df.select(tidy_key(F.col(order)).alias("order"), tidy_key(F.col(product)).alias("product"))
    return rows.where("order is not null and product is not null").distinct()


def basket_gates(rows: DataFrame) -> DataFrame:
    """Whether there are enough orders with more than one product to look for pairs."""
    sizes = rows.groupBy("order").agg(F.count("*").alias("size"))
    one = sizes.agg(F.count("*").alias("orders"), F.avg(F.when(F.col("size") >= 2, 1.0).otherwise(0.0)).alias("_multi"),
                    F.avg("size").alias("_mean"))
    checked = status_row(one, [
        (F.col("orders") < MIN_ORDERS, "too few orders"),
        ((F.col("_multi") < MIN_MULTI_SHARE) | (F.col("_mean") <= MIN_MEAN_BASKET), "too few orders hold more than one product")])
    return checked.select("orders", round_half_up(F.col("_multi"), 4).alias("multi_share"),
                          round2(F.col("_mean")).alias("mean_basket"), "status", "reason")


def best_sellers(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of the `limit` products found in most orders, or all rows without one."""
    if limit is None:
        return rows
    counts = rows.groupBy("product").agg(F.count("*").alias("orders"))
    top = counts.orderBy(F.desc("orders"), "product").limit(limit).select("product")
    return rows.join(top, "product", "left_semi")


def frequent_itemsets(rows: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Product sets found in at least that share of orders.

    A product below that share is in no such set, so baskets hold frequent products alone.
    There are at most (mean basket / min_support) of those, which bounds a basket even for an
    order with a third of all rows.
    """
    rows = materialise(rows, "purchased")  # read three times
    orders = rows.select("order").distinct().count()
    least = max(1, math.ceil(min_support * orders - 1e-9))
    counts = rows.groupBy("product").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    listed = rows.join(counts.select("product"), "product", "left_semi").groupBy("order").agg(F.collect_set("product").alias("items"))
    baskets = materialise(listed, "baskets")  # mined in several passes
    # Support is a share of every order, also of those without a frequent product. The miner
    # rounds its share of the baskets up to a count: half a basket below hits `least` exactly.
    kept = baskets.count()
    share = min(1.0, (least - 0.5) / kept) if kept else 1.0
    found = FPGrowth(itemsCol="items", minSupport=share).fit(baskets).freqItemsets
    # mined once, whatever is read of the sets
    found = materialise(found, "itemsets")
    return found.select(F.sort_array("items").alias("items"), F.col("freq").alias("n"), (F.col("freq") / F.lit(orders)).alias("support"))


def frequent_pairs(rows: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """The frequent sets of one and of two products, in the form of `frequent_itemsets`, without mining larger ones.

    Baskets hold frequent products alone, at most (mean basket / min_support) of them; their pairs
    are made inside the basket's row and counted in one grouped pass.
    """
    rows = materialise(rows, "purchased")  # read three times
    orders = rows.select("order").distinct().count()
    least = max(1, math.ceil(min_support * orders - 1e-9))
    counts = rows.groupBy("product").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    baskets = rows.join(counts.select("product"), "product", "left_semi").groupBy("order").agg(F.sort_array(F.collect_set("product")).alias("items"))
    both = F.expr("flatten(transform(items, (x, i) -> transform(slice(items, i + 2, size(items)), y -> array(x, y))))")
    pairs = baskets.select(F.explode(both).alias("items")).groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    sets = counts.select(F.array("product").alias("items"), "n").unionByName(pairs)
    return sets.select("items", "n", (F.col("n") / F.lit(orders)).alias("support"))


def association_rules(itemsets: DataFrame, min_confidence: float = MIN_CONFIDENCE, limit: int | None = None) -> DataFrame:
    """Rules between every two parts of each frequent set, strongest lift first.

    All subsets of a frequent set are frequent, so both sides' supports are in the table. For the
    same reason no set has more items than the table has bits of rows, far below the 62 of a mask.
    """
    sets = itemsets.withColumn("key", F.concat_ws("\0", "items")).select("key", "items", "n", "support")
    # Every number with one bit per item stands for one way to part the set in two.
    masks = F.expr("sequence(1L, shiftleft(1L, size(items)) - 2)")
    splits = sets.where(F.size("items") >= 2).select("n", "support", "items", F.explode(masks).alias("mask"))

    bit = "filter(items, (x, i) -> (shiftright(mask, i) & 1) = {})"
    parts = splits.select("n", "support", F.expr(bit.format(1)).alias("buys"), F.expr(bit.format(0)).alias("also_buys"))
    left = sets.select(F.col("key").alias("_l"), F.col("support").alias("_ls"))
    right = sets.select(F.col("key").alias("_r"), F.col("support").alias("_rs"))
    rules = parts.join(left, F.concat_ws("\0", "buys") == F.col("_l")).join(right, F.concat_ws("\0", "also_buys") == F.col("_r")).select(
        F.concat_ws(", ", "buys").alias("buys"), F.concat_ws(", ", "also_buys").alias("also_buys"), F.col("n").alias("orders"),
        F.col("support").alias("_s"), (F.col("support") / F.col("_ls")).alias("_c"),
        (F.col("support") / F.col("_ls") / F.col("_rs")).alias("_lift"))
    kept = rules.where((F.col("_c") >= min_confidence) & (F.col("_lift") > MIN_LIFT))
    if limit is not None:
        kept = kept.orderBy(F.desc("_lift"), F.desc("_s"), F.desc("_c"), "buys", "also_buys").limit(limit)
    return kept.select("buys", "also_buys", "orders", round_half_up(F.col("_s"), 4).alias("support"),
                       round_half_up(F.col("_c"), 4).alias("confidence"), round_half_up(F.col("_lift"), 3).alias("lift"))
