"""What moved a total: members, price and volume, and the sentence that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyloom.context import Filters, SchemaMap
from tallyloom.functions.money import short_number, usd
from tallyloom.functions.numbers import exact_sum, pct_change, round2, round_half_up
from tallyloom.functions.strings import group_label, window_phrase
from tallyloom.operators.compare import tag_periods
from tallyloom.operators.formats import quoted
from tallyloom.operators.metrics import row_quantity, row_revenue
from tallyloom.session import materialise


def contributions(df: DataFrame, schema: SchemaMap, dimensions: list[str], value: Column, bounds: DataFrame,
                  filters: Filters = Filters()) -> DataFrame:
    """Per dimension and member: before, now, the change and its share of the whole change.

    All dimensions go through one grouped pass over (dimension, member) rows; a member that
    is missing on one side counts 0 there.
    """
    columns = [schema.get(d, d) for d in dimensions]
    tagged = tag_periods(df, schema, filters, bounds).where("is_current or is_previous")
    wide = tagged.select(
        F.when(F.col("is_current"), value).otherwise(0.0).alias("_c"), F.when(F.col("is_previous"), value).otherwise(0.0).alias("_p"),
        *[group_label(F.col(quoted(c))).alias(d) for c, d in zip(columns, dimensions)])
    long = wide.unpivot(["_c", "_p"], [F.col(quoted(d)) for d in dimensions], "dimension", "member")
    # Written once: the wholes, the top and the rest below all read it instead of the rows.
    members = materialise(long.groupBy("dimension", "member").agg(exact_sum("_c").alias("_c"), exact_sum("_p").alias("_p")), "members")
    # One row per dimension named by the caller.
    wholes = members.groupBy("dimension").agg(exact_sum(F.col("_c") - F.col("_p")).alias("_whole"))
    whole = F.col("_whole")
    return members.join(F.broadcast(wholes), "dimension").select(
        "dimension", "member", round2(F.col("_c")).alias("current"), round2(F.col("_p")).alias("previous"),
        round2(F.col("_c") - F.col("_p")).alias("delta"),
        F.when(F.col("_p") != 0, round_half_up((F.col("_c") - F.col("_p")) / F.abs("_p") * 100, 2)).alias("change_pct"),
        F.when(whole != 0, round_half_up((F.col("_c") - F.col("_p")) / whole * 100, 2)).alias("share_pct"),
        round2(whole).alias("total_delta")).where("delta <> 0")


def top_contributions(members: DataFrame, n: int = 10) -> DataFrame:
    """The n largest changes of each dimension and one line for the rest, which add up to the whole.

    The rank filter is applied inside each task first; the rest is the whole minus the top.
    """
    order = Window.partitionBy("dimension").orderBy(F.desc(F.abs("delta")), "member")
    top = members.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)
    wholes = members.groupBy("dimension").agg(F.sum("delta").alias("_sum"), F.count("*").alias("_n"), F.max("total_delta").alias("total_delta"))
    shown = top.groupBy("dimension").agg(F.sum("delta").alias("_top"), F.count("*").alias("_k"))
    rest = wholes.join(shown, "dimension").where("_n > _k").select(
        "dimension", F.lit("(other)").alias("member"), F.lit(n + 1).alias("rank"),
        round2(F.col("_sum") - F.col("_top")).alias("delta"), "total_delta")
    return top.select("dimension", "member", "rank", "delta", "total_delta").unionByName(rest)


def reconciled(members: DataFrame) -> DataFrame:
    """Whether the members' changes add up to the whole change of each dimension."""
    return members.groupBy("dimension").agg(
        F.max("total_delta").alias("total_delta"), F.count("*").alias("members"),
        (F.abs(F.sum("delta") - F.max("total_delta")) < 0.01).alias("reconciled"))


def price_volume_mix(df: DataFrame, schema: SchemaMap, bounds: DataFrame) -> DataFrame:
    """The change in revenue split into volume, price and the rest.

    No row unless the table has a quantity and a price.
    """
    priced_table = bool(schema.get("quantity") and schema.get("unit_price"))
    tagged = tag_periods(df, schema, Filters(), bounds)
    q, r = row_quantity(df, schema), row_revenue(df, schema)

    def side(value, flag):
        return exact_sum(F.when(F.col(flag), value))

    one = tagged.agg(side(q, "is_current").alias("q2"), side(q, "is_previous").alias("q1"),
                     side(r, "is_current").alias("r2"), side(r, "is_previous").alias("r1")).where(F.lit(priced_table) & (F.col("q1") != 0) & (F.col("q2") != 0))
    priced = one.select("*", (F.col("r1") / F.col("q1")).alias("p1"), (F.col("r2") / F.col("q2")).alias("p2"))
    volume, price = (F.col("q2") - F.col("q1")) * F.col("p1"), F.col("q2") * (F.col("p2") - F.col("p1"))
    total = F.col("r2") - F.col("r1")
    return priced.select(
        round2(volume).alias("volume_delta"), round2(price).alias("price_delta"), round2(total - volume - price).alias("mix_delta"),
        round2(total).alias("total_delta"), round2(F.col("q2")).alias("current_units"), round2(F.col("q1")).alias("previous_units"),
        round2(F.col("p2")).alias("current_price"), round2(F.col("p1")).alias("previous_price"))


# --- sentences ----------------------------------------------------------------------------------

MIN_DRIVER_SHARE = 25.0
FLAT_BELOW = 0.05


def headline(members: DataFrame, totals: DataFrame, bounds: DataFrame, label: str, by: list[str] = ()) -> DataFrame:
    """One sentence per row of `totals` (`current`, `previous`, optional `by` keys).

    A driver is named only when it explains at least a quarter of the move in its direction.
    Without a value before, the sentence says so and nothing is compared.
    """
    window = bounds.select(F.struct("*")).scalar()
    days = F.datediff("_w.current_to", "_w.current_from") + 1
    delta = F.col("current") - F.col("previous")
    keys = list(by)
    order = (F.desc(F.abs("delta")), "member")
    if keys:
        first = Window.partitionBy(*keys).orderBy(*order)
        top = members.select("*", F.row_number().over(first).alias("_r")).where("_r = 1")
        top = top.select(*keys, F.col("member").alias("_m"), F.col("delta").alias("_d"), F.col("share_pct").alias("_s"))
        joined = totals.join(top, keys, "left")
    else:
        best = members.orderBy(*order).limit(1).select(F.struct("member", "delta", "share_pct")).scalar()
        joined = totals.select("*", best.alias("_t")).select(
            *totals.columns, F.col("_t.member").alias("_m"), F.col("_t.delta").alias("_d"), F.col("_t.share_pct").alias("_s"))
    change = pct_change(F.col("current"), F.col("previous"))
    told = joined.select("*", window.alias("_w"), change.alias("change_pct"), round2(delta).alias("delta")).select(
        "*", window_phrase(days, F.col("_w.basis")).alias("window"),
        F.when(F.col("previous").isNull(), "none").when((F.col("delta") == 0) | (F.abs("change_pct") < FLAT_BELOW), "flat").when(F.col("delta") > 0, "up").otherwise("down").alias("direction"))
    named = (F.signum("_d") == F.signum("delta")) & (F.abs("_s") >= MIN_DRIVER_SHARE)
    driver = F.when(named & F.col("direction").isin("up", "down"), F.col("_m"))
    now, then = usd(F.col("current")), usd(F.col("previous"))
    moved = F.coalesce(F.concat(short_number(F.abs("change_pct")), F.lit("%")), usd(F.abs("delta")))
    alone = F.concat(F.lit(label + ": "), now, F.lit("; no earlier period to compare with"))
    level = F.concat(F.lit(label + ": level at "), now, F.lit(", compared with "), F.col("window"))
    shift = F.concat(F.lit(label + ": "), F.col("direction"), F.lit(" "), moved, F.lit(" compared with "), F.col("window"), F.lit(" ("), then,
                     F.lit(" then, "), now, F.lit(" now)"), F.coalesce(F.concat(F.lit("; moved most by "), driver), F.lit("")))
    text = F.when(F.col("direction") == "none", alone).when(F.col("direction") == "flat", level).otherwise(shift)
    return told.select(*keys, "direction", "change_pct", "window", driver.alias("driver"), text.alias("text"))


def decomposition_tree(df: DataFrame, fields: list[str], value: Column, levels: int = 2) -> DataFrame:
    """Split by the field whose largest group takes the biggest share, then split that group again.

    Each level is one grouped pass over (field, group) rows. Which field and group a level
    picks is known only from the data, so the next level reads it as a scalar.
    """
    rows = df.select(value.alias("_v"), F.create_map(*[e for f in fields for e in (
        F.lit(f), F.coalesce(F.col(quoted(f)).cast("string"), F.lit("—")))]).alias("_f"))
    out, used = None, F.array().cast("array<string>")
    for level in range(1, levels + 1):
        long = rows.select("_v", F.explode("_f").alias("field", "member")).where(~F.array_contains(used, F.col("field")))
        groups = materialise(long.groupBy("field", "member").agg(exact_sum("_v").alias("value")), "groups")
        sums = groups.groupBy("field").agg(exact_sum("value").alias("whole"), F.max_by(F.struct("member", "value"), F.struct(
            "value", F.col("member"))).alias("top"), F.count("*").alias("k"))
        best = sums.where("k >= 2").select("field", "top", (F.abs("top.value") / F.abs("whole")).alias("share"), "whole").orderBy(
            F.desc("share"), "field").limit(1)
        pick = best.select(F.struct("field", "top.member", "whole")).scalar()
        shown = groups.select("*", pick.alias("_p")).where(F.col("field") == F.col("_p.field")).select(
            F.lit(level).alias("level"), "field", "member", round2(F.col("value")).alias("value"),
            round_half_up(F.col("value") / F.col("_p.whole") * 100, 2).alias("share_pct"),
            (F.col("member") == F.col("_p.member")).alias("picked"))
        out = shown if out is None else out.unionByName(shown)
        rows = rows.select("*", pick.alias("_p")).where(F.try_element_at("_f", F.col("_p.field")) == F.col("_p.member")).drop("_p")
        used = F.array_append(used, best.select("field").scalar())
    return out


def headlines_by_group(df: DataFrame, schema: SchemaMap, group: str, dimension: str, value: Column,
                       bounds: DataFrame, label: str) -> DataFrame:
    """A headline for every group, each with the member of `dimension` that moved it most.

    One grouped pass over (group, member) feeds both the totals and the members.
    """
    tagged = tag_periods(df, schema, Filters(), bounds).where("is_current or is_previous")
    cells = materialise(tagged.groupBy(
        F.col(quoted(schema.get(group, group))).alias(group),
        group_label(F.col(quoted(schema.get(dimension, dimension)))).alias("member")).agg(
        exact_sum(F.when(F.col("is_current"), value).otherwise(0.0)).alias("_c"),
        exact_sum(F.when(F.col("is_previous"), value).otherwise(0.0)).alias("_p")), "cells")
    wholes = cells.groupBy(group).agg(exact_sum("_c").alias("_cc"), exact_sum("_p").alias("_pp"))
    members = cells.join(wholes, group).select(
        group, "member", round2(F.col("_c") - F.col("_p")).alias("delta"),
        F.when(F.col("_cc") != F.col("_pp"), round_half_up((F.col("_c") - F.col("_p")) / (F.col("_cc") - F.col("_pp")) * 100, 2)).alias("share_pct"))
    totals = wholes.select(group, round2(F.col("_cc")).alias("current"), round2(F.col("_pp")).alias("previous"))
    return headline(members, totals, bounds, label, by=[group])
