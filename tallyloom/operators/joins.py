"""Joins that cannot inflate a total, and finding where tables connect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from tallyloom.functions.numbers import exact_sum, round2, round_half_up
from tallyloom.functions.strings import join_key, normalise_region
from tallyloom.operators.formats import quoted


@dataclass(frozen=True)
class Relation:
    """`left_column` of what has been joined so far = `right_column` of a named table."""

    left_column: str
    right_name: str
    right_column: str


def output_names(taken: list[str], right: list[str], relation: Relation) -> dict[str, str]:
    """The right columns under the names they get; the right key itself is dropped."""
    used, names = set(taken), {}
    for column in right:
        if column == relation.right_column:
            continue
        prefixed = f"{relation.right_name}.{column}"
        name, n = (prefixed if column in used else column), 2
        while name in used:
            name, n = f"{prefixed}_{n}", n + 1
        used.add(name)
        names[column] = name
    return names


def key_counts(left: DataFrame, right: DataFrame, left_column: str, right_column: str) -> DataFrame:
    """Rows per key on each side, both sides summed in one shuffle."""
    sides = left.select(join_key(F.col(quoted(left_column))).alias("key"), F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(join_key(F.col(quoted(right_column))).alias("key"), F.lit(0).alias("l"), F.lit(1).alias("r")))
    return sides.groupBy("key").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))


def join_report(counts: DataFrame) -> DataFrame:
    """What a left join on these keys would do, in one row."""
    keyed, l, r = F.col("key").isNotNull(), F.col("l"), F.col("r")

    def rows(value, condition):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    one = counts.agg(
        rows(l, F.lit(True)).alias("left_rows"),
        rows(r, F.lit(True)).alias("right_rows"),
        rows(l, keyed & (r > 0)).alias("matched_left"),
        rows(l, keyed & (r == 0)).alias("unmatched_left"),
        rows(l, ~keyed).alias("blank_left"),
        rows(r, keyed & (l == 0)).alias("unmatched_right"),
        rows(l * F.greatest(r, F.lit(1)), keyed).alias("_produced"),
        F.count_if(keyed & (l > 1)).alias("_left_repeats"),
        F.count_if(keyed & (r > 1)).alias("duplicate_keys"),
    )
    kind = F.concat(
        F.when(F.col("_left_repeats") > 0, "many").otherwise("one"), F.lit("_to_"),
        F.when(F.col("duplicate_keys") > 0, "many").otherwise("one"))
    produced = F.col("_produced") + F.col("blank_left")
    return one.select(
        kind.alias("kind"), (F.col("duplicate_keys") == 0).alias("safe"), "left_rows", "right_rows", "matched_left",
        "unmatched_left", "blank_left", "unmatched_right", "duplicate_keys",
        F.when(F.col("left_rows") > 0, round_half_up(produced / F.col("left_rows"), 4)).otherwise(1.0).alias("fan_out"))


def duplicate_examples(counts: DataFrame, k: int = 5) -> DataFrame:
    """A few right keys that repeat, to name in a refusal."""
    return counts.where("key is not null and r > 1").select("key", F.col("r").alias("times")).orderBy("key").limit(k)


def right_key_repeats(right: DataFrame, column: str) -> bool:
    key = join_key(F.col(quoted(column))).alias("key")
    repeated = right.select(key).where("key is not null").groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return not repeated.isEmpty()


def guarded_join(left: DataFrame, right: DataFrame, relation: Relation) -> tuple[DataFrame, bool]:
    """Left join that keeps every left row once; refused when the right key repeats.

    Returns the frame and whether the join was made. How the sides are brought together is
    left to Spark, which broadcasts the right side only when its measured size allows it
    and splits hot left keys at run time.
    """
    if right_key_repeats(right, relation.right_column):
        return left, False
    names = output_names(left.columns, right.columns, relation)
    right_key = join_key(F.col(quoted(relation.right_column)))
    kept = right.where(right_key.isNotNull()).select(
        right_key.alias("_key"), F.lit(True).alias("_hit"), *[F.col(quoted(c)).alias(n) for c, n in names.items()])
    # Blank keys match nothing; dealt out by the row they spread over all tasks instead of one.
    left_key = join_key(F.col(quoted(relation.left_column)))
    alone = F.concat(F.lit("\0"), F.xxhash64(*[F.col(quoted(c)) for c in left.columns]).cast("string"))
    joined = left.withColumn("_left_key", F.coalesce(left_key, alone)).withColumn("_keyed", left_key.isNotNull()).join(
        kept, (F.col("_left_key") == F.col("_key")) & F.col("_keyed"), "left")
    out = [F.col(quoted(c)) for c in left.columns]
    for source, name in names.items():
        cell = F.col(quoted(name))
        if isinstance(right.schema[source].dataType, StringType):
            cell = F.when(F.col("_hit"), cell).otherwise("").alias(name)  # a lookup miss is a blank cell
        out.append(cell)
    return joined.select(*out), True


def join_chain(left: DataFrame, tables: dict[str, DataFrame], relations: list[Relation]) -> tuple[DataFrame, list[bool]]:
    """Relations in stored order; each sees the columns added before it, a refused one is skipped."""
    applied = []
    for relation in relations:
        made = relation.left_column in left.columns
        if made:
            left, made = guarded_join(left, tables[relation.right_name], relation)
        applied.append(made)
    return left, applied


def deferred_join(left: DataFrame, right: DataFrame, relation: Relation) -> tuple[DataFrame, Column]:
    """The guarded join decided while the query runs: planning it starts no job.

    The right columns are always there. Where the right key repeats the join is refused: they are
    null in every row, as if there were no match. Also returned: whether it is refused, a scalar.
    The right side is grouped by the very key it is joined by, so it is dealt out once.
    """
    names = output_names(left.columns, right.columns, relation)
    keyed = right.select(join_key(F.col(quoted(relation.right_column))).alias("_key"),
                         F.struct(*[F.col(quoted(c)).alias(n) for c, n in names.items()] or [F.lit(True).alias("_")]).alias("_row")).where("_key is not null")
    once = keyed.groupBy("_key").agg(F.count("*").alias("_times"), F.any_value("_row").alias("_row"))
    refused = F.coalesce(once.agg(F.max("_times") > 1).scalar(), F.lit(False))
    left_key = join_key(F.col(quoted(relation.left_column)))
    # Blank keys match nothing; dealt out by the row they spread over all tasks instead of one.
    alone = F.concat(F.lit("\0"), F.xxhash64(*[F.col(quoted(c)) for c in left.columns]).cast("string"))
    keyed_left = left.withColumn("_left_key", F.coalesce(left_key, alone)).withColumn("_keyed", left_key.isNotNull())
    joined = keyed_left.join(once, (F.col("_left_key") == F.col("_key")) & F.col("_keyed"), "left").withColumn("_refused", refused)
    out = [F.col(quoted(c)) for c in left.columns]
    for source, name in names.items():
        cell = F.col(f"_row.{quoted(name)}")
        if isinstance(right.schema[source].dataType, StringType):
            cell = F.when(F.col("_key").isNotNull(), cell).otherwise("")  # a lookup miss is a blank cell
        out.append(F.when(~F.col("_refused"), cell).alias(name))
    return joined.select(*out), refused


def deferred_chain(left: DataFrame, tables: dict[str, DataFrame], relations: list[Relation]) -> tuple[DataFrame, DataFrame]:
    """Relations in stored order, none of them looked at before the query runs.

    Returns the joined rows and one row per relation: `position`, `right_name`, `applied`. A
    relation on a column that nothing offers is not applied.
    """
    spark, hops = left.sparkSession, []
    for relation in relations:
        refused = F.lit(True)
        if relation.left_column in left.columns:
            left, refused = deferred_join(left, tables[relation.right_name], relation)
        hops.append(F.struct(F.lit(len(hops)).alias("position"), F.lit(relation.right_name).alias("right_name"), (~refused).alias("applied")))
    return left, spark.range(1).select(F.inline(F.array(*hops)))


# --- suggestions ------------------------------------------------------------------------------


def name_affinity(left: str, right: str) -> float:
    """1 for the same name, 0.8 for `customer` and `customer_id`, 0.6 for the same name before `id`."""
    l, r = (re.sub(r"[\s_-]+", "", n.lower().strip()) for n in (left, right))
    if l == r:
        return 1.0
    if l == r + "id" or r == l + "id":
        return 0.8
    return 0.6 if l.removesuffix("id") and l.removesuffix("id") == r.removesuffix("id") else 0.0


#: A theta sketch of 2 ** 14 entries errs by 0.8 %; six times that is taken as certain.
SKETCH_SIZE, SURELY = 14, 1.05


def without_repeating(tables: dict[str, DataFrame], pairs: list[tuple]) -> list[tuple]:
    """The pairs whose right column may be unique: about as many different keys as keys."""
    by_table: dict[str, set[str]] = {}
    for _, _, rn, rc, _ in pairs:
        by_table.setdefault(rn, set()).add(rc)
    unique = set()
    for name, columns in by_table.items():  # one pass over each table, one row back
        key = {c: join_key(F.col(quoted(c))) for c in sorted(columns)}
        one = tables[name].agg(*[a for i, k in enumerate(key.values()) for a in (
            F.count(k).alias(f"n{i}"), F.theta_sketch_estimate(F.theta_sketch_agg(k, SKETCH_SIZE)).alias(f"d{i}"))]).first()
        unique |= {(name, c) for i, c in enumerate(key) if one[f"n{i}"] <= (one[f"d{i}"] or 0) * SURELY}
    return [p for p in pairs if (p[2], p[3]) in unique]


def suggest_relations(tables: dict[str, DataFrame]) -> DataFrame:
    """Column pairs of different tables with like names and shared values, strongest first.

    Only names are compared on the driver. A sketch of each column's values, merged from one
    small state per task, tells which right columns surely repeat: those pairs are out before any
    key moves. Each column left is reduced to its keys and counts once, and all pairs are judged
    in one grouped pass.
    """
    pairs = [(ln, lc, rn, rc, name_affinity(lc, rc)) for ln, lt in tables.items() for rn, rt in tables.items()
             if ln != rn for lc in lt.columns for rc in rt.columns if name_affinity(lc, rc) > 0]
    spark = next(iter(tables.values())).sparkSession
    names = "left_table string, left_column string, right_table string, right_column string"
    if not pairs:
        return spark.createDataFrame([], names + ", kind string, overlap double, confidence double")
    pairs = without_repeating(tables, pairs)
    if not pairs:
        return spark.createDataFrame([], names + ", kind string, overlap double, confidence double")
    used = sorted({(n, c) for ln, lc, rn, rc, _ in pairs for n, c in ((ln, lc), (rn, rc))})
    keys = None
    for name, column in used:
        one = tables[name].select(F.lit(f"{name}\0{column}").alias("side"), join_key(F.col(quoted(column))).alias("key"))
        keys = one if keys is None else keys.unionByName(one)
    counts = keys.where("key is not null").groupBy("side", "key").agg(F.count("*").alias("n"))
    # A fixed table of names: one row per pair and side.
    roles = spark.createDataFrame(
        [(i, f"{n}\0{c}", role) for i, (ln, lc, rn, rc, _) in enumerate(pairs)
         for n, c, role in ((ln, lc, "l"), (rn, rc, "r"))], "pair int, side string, role string")
    both = counts.join(F.broadcast(roles), "side").groupBy("pair", "key").agg(
        F.sum(F.when(F.col("role") == "l", F.col("n")).otherwise(0)).alias("l"),
        F.sum(F.when(F.col("role") == "r", F.col("n")).otherwise(0)).alias("r"))
    judged = both.groupBy("pair").agg(
        F.sum("l").alias("keyed"), F.sum(F.when(F.col("r") > 0, F.col("l")).otherwise(0)).alias("matched"),
        F.max("l").alias("most_left"), F.max("r").alias("most_right"))
    listed = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "pair int, " + names + ", affinity double")
    overlap = F.col("matched") / F.nullif(F.col("keyed"), F.lit(0))
    scored = judged.join(F.broadcast(listed), "pair").where(F.col("most_right") <= 1).select(
        "left_table", "left_column", "right_table", "right_column",
        F.when(F.col("most_left") > 1, "many_to_one").otherwise("one_to_one").alias("kind"),
        overlap.alias("_o"), round2(F.col("affinity") * 0.4 + overlap * 0.6).alias("confidence"))
    return scored.where("_o >= 0.5 and confidence >= 0.5").select(
        "left_table", "left_column", "right_table", "right_column", "kind", round2(F.col("_o")).alias("overlap"), "confidence"
    ).orderBy(F.desc("confidence"), "left_table", "left_column", "right_table", "right_column")


def creates_cycle(edges: list[tuple[str, str]], left: str, right: str) -> bool:
    """Whether joining `right` onto `left` would lead back to `left`."""
    reachable, todo = set(), [right]
    while todo:
        node = todo.pop()
        if node == left:
            return True
        if node not in reachable:
            reachable.add(node)
            todo += [b for a, b in edges if a == node]
    return False


def match_regions(rows: DataFrame, label: str, value: Column, map_names: DataFrame, map_name: str) -> DataFrame:
    """Totals per map name; labels that match nothing keep a row of their own.

    Labels are summed before they are matched, so the matching handles one row per label.
    """
    from tallyloom.functions.strings import region_aliases

    totals = rows.groupBy(F.col(label).alias("label")).agg(exact_sum(value).alias("v")).select(
        "*", normalise_region(F.col("label")).alias("norm"))
    names = map_names.select(F.col(map_name).alias("name"), normalise_region(F.col(map_name)).alias("name_norm")).distinct()
    aliases = region_aliases(rows.sparkSession).select(
        "alias", normalise_region(F.col("map_name")).alias("alias_norm"))
    direct = totals.join(names, F.col("norm") == F.col("name_norm"), "left")
    aliased = direct.join(F.broadcast(aliases), F.col("norm") == F.col("alias"), "left")
    second = names.select(F.col("name").alias("by_alias"), F.col("name_norm").alias("by_alias_norm"))
    found = aliased.join(second, F.col("alias_norm") == F.col("by_alias_norm"), "left").select(
        "label", "v", F.coalesce("name", "by_alias").alias("region"))
    return found.groupBy(F.coalesce("region", "label").alias("region"), F.col("region").isNotNull().alias("matched")).agg(
        round2(exact_sum("v")).alias("value"))
