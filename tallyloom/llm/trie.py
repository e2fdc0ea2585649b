"""The prefix trie of conversations and sums over its subtrees by centroid decomposition.

Every prefix of turns gets a 128-bit key: the exclusive or of hashes of (position, role, text). A
key is a running fold without order, so long conversations are numbered and folded in pieces and
the texts are moved once. Equal keys are one node, named by (its smallest member, its depth).

Sums over subtrees follow the parent edges. A node's weight is its number of members, and the
weight of its subtree is known from the start: each member gives the number of its turns from the
node on. A component's centroid is its deepest node whose subtree holds more than half of the
component's weight; the nodes that hold more than half are exactly the path from the component's
top to the centroid. Each round, for all components at once:

1. the component's total below the centroid is aggregated,
2. it is added to every node on the path,
3. the component splits into the centroid's child subtrees and what is left above it.

All parts have at most half the weight, so the rounds are as many as the bits of the number of
turns, whatever the depth. A component with few nodes finishes inside one task by the same steps
on arrays; only larger ones are split with joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.vectors import cores
from tallyloom.session import materialise

#: Nodes of a component that one task finishes; turns of a conversation folded in one window; ids in a piece of a list.
SMALL, PIECE, LISTED = 1 << 15, 1 << 12, 1 << 10
_KEY = ["depth", "x1", "x2"]


def numbered(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, d1, d2, chars): turns numbered from 1 by (turn, role, text), nulls first, as digests.

    A null role or text is empty. The order comes from one sort over ranges of all rows, so a
    conversation that holds a third of them is many tasks' work. Rows with a null id are left out.
    """
    turns = rows.select(rows[id_col].cast("long").alias("conv"), rows[order_col].alias("turn"), F.coalesce(rows[role_col].cast("string"), F.lit("")).alias("role"),
                        F.coalesce(rows[text_col].cast("string"), F.lit("")).alias("text")).where("conv is not null")
    by = ["conv", "turn", "role", "text"]
    parts = max(cores(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_turns = turns.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    digest = lambda k: F.xxhash64(F.lit(k), "role", "text")
    place = F.monotonically_increasing_id()
    told = materialise(sorted_turns.select("conv", place.alias("place"), digest(1).alias("d1"), digest(2).alias("d2"), F.char_length("text").alias("chars")), "turns")
    part = F.shiftright("place", 33).alias("part")
    runs = told.groupBy("conv", part).agg(F.min("place").alias("start"), F.count("*").alias("n"))
    # a conversation has one run in each partition it reaches, so this window has no more rows than partitions
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv", "part", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    pos = F.col("place") - F.col("start") + F.col("before") + 1
    return told.withColumn("part", part).join(runs, ["conv", "part"]).select("conv", pos.alias("pos"), "d1", "d2", "chars")


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv, pos, d1, d2, chars) and one row with pos 0 for each conversation.

    The first h turns of conversation c come from conversation c - c % group, the others are its
    own after its first h, where h = crc32(decimal c) % most.
    """
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("long")
    convs = turns.groupBy("conv").agg(F.max("pos").alias("len")).withColumn("h", heads).withColumn("base", F.col("conv") - F.col("conv") % group)
    bases = convs.select(F.col("conv").alias("base"), F.col("len").alias("base_len"))
    convs = materialise(convs.join(bases, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_len", F.lit(0)))), "conversations")
    lent = turns.where(F.col("pos") < most).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "lent"), "base").where(F.col("pos") <= F.col("lent"))
    own = turns.join(convs.select("conv", "h", "lent"), "conv").where(F.col("pos") > F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("lent"))
    none = convs.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), F.lit(0).alias("chars"))
    columns = ["conv", "pos", "d1", "d2", "chars"]
    return lent.select(columns).unionByName(own.select(columns)).unionByName(none)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv, depth, x1, x2, p1, p2, chars, rest): the key of each prefix and of the one before it.

    rest is the number of the conversation's rows from here on. Keys fold pieces of `PIECE` turns
    and then the pieces, so no window holds a long conversation.
    """
    here = lambda k: F.when(F.col("pos") > 0, F.xxhash64(F.lit(k), "pos", "d1", "d2")).otherwise(F.lit(0).cast("long"))
    marked = turns.select("conv", "pos", "chars", here(1).alias("w1"), here(2).alias("w2"), F.floor(F.col("pos") / PIECE).cast("long").alias("piece"))
    inside = Window.partitionBy("conv", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fold = lambda c, w: F.bit_xor(c).over(w)
    pieces = marked.groupBy("conv", "piece").agg(F.bit_xor("w1").alias("s1"), F.bit_xor("w2").alias("s2"), F.max("pos").alias("last"))
    before = Window.partitionBy("conv").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("conv")
    zero = F.lit(0).cast("long")
    pieces = pieces.select("conv", "piece", F.coalesce(fold("s1", before), zero).alias("b1"), F.coalesce(fold("s2", before), zero).alias("b2"), F.max("last").over(all_of).alias("len"))
    folded = marked.select("conv", "piece", "pos", "chars", "w1", "w2", fold("w1", inside).alias("f1"), fold("w2", inside).alias("f2")).join(pieces, ["conv", "piece"])
    x1, x2 = F.col("f1").bitwiseXOR(F.col("b1")), F.col("f2").bitwiseXOR(F.col("b2"))
    return folded.select("conv", F.col("pos").alias("depth"), x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("w1")).alias("p1"), x2.bitwiseXOR(F.col("w2")).alias("p2"),
                         "chars", (F.col("len") - F.col("pos") + 1).alias("rest"))


def trie(steps: DataFrame) -> DataFrame:
    """One row for each distinct prefix: conv_id, depth, parent_conv_id, n_convs, n_children, weight, chars and its key."""
    nodes = steps.groupBy(*_KEY).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.sum("rest").alias("weight"),
                                     F.first("chars").alias("chars"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = materialise(nodes, "trie-nodes")
    above = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"), F.col("conv_id").alias("child"), F.col("depth").alias("child_depth"))
    kids = above.groupBy(*_KEY).agg(F.count("*").alias("n_children"))
    parents = above.join(nodes.select(*_KEY, F.col("conv_id").alias("parent_conv_id")), _KEY).select(F.col("child").alias("conv_id"), F.col("child_depth").alias("depth"), "parent_conv_id")
    # a node is told by its smallest member and its depth
    full = nodes.join(kids, _KEY, "left").join(parents, ["conv_id", "depth"], "left")
    return materialise(full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "weight", "chars", "x1", "x2"), "trie")


def tops(up: np.ndarray) -> np.ndarray:
    """The last node that each node's pointers lead to, by doubling; a top points to itself."""
    while True:
        further = up[up]
        if (further == up).all():
            return up
        up = further


def decompose(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of `values` (n, m) over the subtrees of a forest, by centroid decomposition on arrays.

    `parent` is -1 for tops; `weight` is the weight of each node's subtree within its component.
    """
    n = len(parent)
    out = np.zeros_like(values)
    weight = weight.copy()
    up = np.where(parent < 0, np.arange(n), parent)
    done = np.zeros(n, bool)
    while not done.all():
        top = tops(up)
        path = ~done & (2 * weight > weight[top])
        inner = np.zeros(n, bool)  # has a child on the path
        below = path & (up != np.arange(n))
        inner[up[below]] = True
        centroid_of = np.full(n, -1)
        middle = np.flatnonzero(path & ~inner)
        centroid_of[top[middle]] = middle
        mine = centroid_of[top]  # every node's centroid; -1 only for those done
        # cut below and above the centroids, and look again at what leads where
        cut = up.copy()
        child = ~done & (mine >= 0) & (up == mine) & (np.arange(n) != mine)
        cut[child] = np.flatnonzero(child)
        cut[middle] = middle
        top = tops(cut)
        under = ~done & ((np.arange(n) == mine) | (child[top]))
        total = np.zeros_like(values)
        np.add.at(total, mine[under], values[under])
        on_path = np.flatnonzero(path)
        out[on_path] += total[mine[on_path]]
        above = on_path[mine[on_path] != on_path]
        weight[above] -= weight[mine[above]]
        done[middle] = True
        up = cut
    return out


def rollup(nodes: DataFrame, lookup: DataFrame, values: dict[str, Column], small: int = SMALL) -> DataFrame:
    """(conv_id, depth, *values): each value summed over each node's subtree.

    `nodes` as from `trie`; `lookup` (conv, depth, node) names the node of every prefix of every
    conversation that names a node. Each round costs a few joins over the nodes of components
    larger than `small`; smaller ones are dealt into bins and finished there.
    """
    names = list(values)
    spark = nodes.sparkSession
    # (c, d): the component is named by its top node
    state = nodes.select("conv_id", "depth", "parent_conv_id", "weight", *(v.cast("long").alias(k) for k, v in values.items()),
                         *(F.lit(0).cast("long").alias(f"sum_{k}") for k in names), F.lit(0).cast("long").alias("top_conv"), F.lit(0).cast("long").alias("top_depth"))
    root = nodes.where("depth = 0").agg(F.min("conv_id")).first()[0]
    if root is None:
        return state.select("conv_id", "depth", *names)
    state = materialise(state.withColumn("top_conv", F.lit(root)), "rollup")
    comp = ["top_conv", "top_depth"]
    finished, local = [], []
    while True:
        sizes = state.groupBy(*comp).agg(F.count("*").alias("nodes"), F.max("weight").alias("total"))
        state = state.join(sizes, comp)
        local.append(state.where(F.col("nodes") <= small).drop("nodes", "total"))
        large = materialise(state.where(F.col("nodes") > small).drop("nodes"), "large")
        if large.isEmpty():
            break
        path = F.col("weight") * 2 > F.col("total")
        middle = large.where(path).groupBy(*comp).agg(F.max_by(F.struct("conv_id", "depth", "weight"), "depth").alias("m"))
        middle = middle.select(*comp, F.col("m.conv_id").alias("c_conv"), F.col("m.depth").alias("c_depth"), F.col("m.weight").alias("c_weight"))
        # the prefixes of deeper nodes at the centroid's depth and one below it tell who is under it, and under which child
        known = large.join(middle, comp)
        at = lambda k, name: lookup.select(F.col("conv").alias("conv_id"), (F.col("depth") - k).alias("c_depth"), F.col("node").alias(name))
        known = known.join(at(0, "same"), ["conv_id", "c_depth"], "left").join(at(1, "child"), ["conv_id", "c_depth"], "left")
        known = known.withColumn("under", (F.col("depth") >= F.col("c_depth")) & F.coalesce(F.col("same") == F.col("c_conv"), F.lit(False)))
        known = materialise(known.drop("same"), "known")
        totals = known.where("under").groupBy(*comp).agg(*(F.sum(k).alias(f"t_{k}") for k in names))
        known = known.join(totals, comp)
        is_centroid = (F.col("depth") == F.col("c_depth")) & (F.col("conv_id") == F.col("c_conv"))
        added = known.withColumns({f"sum_{k}": F.when(path, F.col(f"sum_{k}") + F.col(f"t_{k}")).otherwise(F.col(f"sum_{k}")) for k in names})
        finished.append(added.where(is_centroid).select("conv_id", "depth", *(F.col(f"sum_{k}").alias(k) for k in names)))
        down = F.col("under") & ~is_centroid
        state = added.where(~is_centroid).select(
            "conv_id", "depth", "parent_conv_id", F.when(path, F.col("weight") - F.col("c_weight")).otherwise(F.col("weight")).alias("weight"), *names, *(f"sum_{k}" for k in names),
            F.when(down, F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"), F.when(down, F.col("c_depth") + 1).otherwise(F.col("top_depth")).alias("top_depth"))
        state = materialise(state, "rollup")
    rest = local[0]
    for part in local[1:]:
        rest = rest.unionByName(part)

    def finish(table: pa.Table) -> pa.Table:
        conv, depth, above = (table.column(c).combine_chunks().fill_null(-1).to_numpy() for c in ("conv_id", "depth", "parent_conv_id"))
        is_top = (conv == table.column("top_conv").to_numpy()) & (depth == table.column("top_depth").to_numpy())
        order = np.lexsort((depth, conv))
        keys = np.stack([conv, depth], 1)[order].view([("c", np.int64), ("d", np.int64)]).ravel()
        wanted = np.stack([above, depth - 1], 1).astype(np.int64).view([("c", np.int64), ("d", np.int64)]).ravel()
        at = np.searchsorted(keys, wanted[~is_top])
        parent = np.full(len(conv), -1)
        parent[~is_top] = order[at]
        own = np.stack([table.column(k).to_numpy() for k in names], 1)
        sums = decompose(parent, table.column("weight").to_numpy().copy(), own) + np.stack([table.column(f"sum_{k}").to_numpy() for k in names], 1)
        return pa.table({"conv_id": conv, "depth": depth} | {k: sums[:, i] for i, k in enumerate(names)})

    schema = "conv_id long, depth long, " + ", ".join(f"{k} long" for k in names)
    count = rest.count()
    bins = max(1, -(-count // small), min(4 * cores(nodes), -(-count // 1024)))
    out = rest.withColumn("bin", F.pmod(F.xxhash64(*comp), F.lit(bins))).groupBy("bin").applyInArrow(finish, schema)
    for part in finished:
        out = out.unionByName(part)
    return out


def ends(steps: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the nodes where conversations end: the hash of their ids in order.

    Ids are joined in pieces of at most `LISTED` neighbouring numbers; a node's pieces then stream
    in order through one running hash, so a node's list is never held, however long.
    """
    last = steps.where("rest = 1").select("conv", *_KEY, F.floor(F.col("conv") / LISTED).alias("piece"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = last.groupBy(*_KEY, "piece").agg(joined.alias("ids"))
    parts = int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*_KEY, "ends_sha256"])

        for batch in batches:
            for depth, x1, x2, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
                if (depth, x1, x2) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (depth, x1, x2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield told()
                done = []
        if now:
            done.append((*now, state.hexdigest()))
            yield told()

    streams = pieces.repartition(parts, *_KEY).sortWithinPartitions(*_KEY, "piece").select(*_KEY, "ids")
    return streams.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see `rebuilt`).

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Rows
    with a null conv_id are left out; an empty table has no conversation and so no node. Repeated
    rows are turns of their own; turns that tie go by role and text.
    """
    steps = materialise(prefixes(rebuilt(numbered(rows))), "prefixes")
    nodes = trie(steps)
    lookup = materialise(steps.join(nodes.select("conv_id").distinct(), steps["conv"] == F.col("conv_id"), "left_semi")
                         .join(nodes.select(*_KEY, F.col("conv_id").alias("node")), _KEY).select("conv", "depth", "node"), "lookup")
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    sums = rollup(nodes, lookup, {"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("chars")}, small)
    empty = hashlib.sha256(b"").hexdigest()
    told = nodes.join(sums, ["conv_id", "depth"]).join(ends(steps), _KEY, "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
