"""Shards of near-equal size by a minimax contiguous partition, in DataFrame operations only.

Atoms are groups of equal texts, ordered by a hash of the text. The smallest capacity is
searched for which a greedy walk over the ordered atoms needs no more than the given number of
shards; the shards end where that walk cuts.

The walk never sees single atoms: sums over cells of the hash range bound where a cut can lie,
from below (up to the cell's start) and above (up to its end). These bounds settle the binary
search but for a few cells, and only those are split and summed again, until none matters. Each
round is one grouped aggregate of at most `CELLS` rows, whatever the table's size.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import materialise

CELLS = 1 << 15
#: Rows are numbered in this many parts of each shard.
PARTS = 1024


class Cells:
    """Sums over consecutive ranges of the order key; `whole` marks ranges that hold one atom."""

    def __init__(self, starts: list[int], sums: list[int], whole: list[bool]):
        self.starts, self.whole = starts, whole
        self.before = [0]
        for s in sums:
            self.before.append(self.before[-1] + s)

    def walk(self, capacity: int, shards: int, high: bool) -> list[int]:
        """Cell index after each greedy cut; high: as far as a cut could lie, else as far as one surely may."""
        cuts, at, base = [], 0, 0
        for _ in range(shards):
            at = bisect_right(self.before, base + capacity) - 1
            if high and at < len(self.whole) and not self.whole[at]:
                at += 1
            base = self.before[at]
            cuts.append(at)
        return cuts

    def least(self, low: int, high: int, shards: int, upper: bool) -> int:
        """Smallest capacity in [low, high] whose walk reaches the end; high surely does."""
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, upper)[-1] == len(self.whole):
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(rows: DataFrame, shards: int, largest: int, total: int) -> list[int]:
    """Order keys `h` at which shards 1, 2, ... begin, for rows (h, size) with atoms of equal h."""
    depth, cells = 0, Cells([-(2**63)], [total], [False])
    while True:
        floor_ = max(largest, -(-total // shards))
        sure = cells.least(floor_, max(total, floor_), shards, False)
        maybe = cells.least(floor_, sure, shards, True)
        cuts = cells.walk(sure, shards, False)
        open_ = set()
        if maybe < sure:
            for a, b in zip(cells.walk(maybe, shards, False), cells.walk(sure, shards, True)):
                open_.update(k for k in range(a, b) if not cells.whole[k])
        if not open_ or depth == 64:
            return [cells.starts[k] if k < len(cells.starts) else 2**63 for k in cuts[:-1]]
        step = max(1, min(64 - depth, (CELLS // len(open_)).bit_length() - 1))
        deeper = depth + step
        key = F.shiftright("h", 64 - deeper)
        if depth:
            wanted = rows.sparkSession.createDataFrame([(cells.starts[k] >> (64 - depth),) for k in sorted(open_)], "cell long")
            rows_now = rows.withColumn("cell", F.shiftright("h", 64 - depth)).join(F.broadcast(wanted), "cell", "left_semi")  # bounded: CELLS rows
        else:
            rows_now = rows
        found = rows_now.groupBy(key.alias("cell")).agg(F.sum("size").alias("size"), F.min("h").alias("low"), F.max("h").alias("high")).collect()  # bounded: CELLS rows
        parts = [(r["cell"] << (64 - deeper), r["size"], r["low"] == r["high"]) for r in found]
        parts += [(cells.starts[k], cells.before[k + 1] - cells.before[k], cells.whole[k]) for k in range(len(cells.whole)) if k not in open_]
        starts, sums, whole = zip(*sorted(parts))
        # cells keep the depth at which they were made; only open ones are split, all at `depth`
        cells, depth = Cells(list(starts), list(sums), list(whole)), deeper


def assign(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    A row's size is the UTF-8 bytes of its text plus `overhead`; a null text counts as empty.
    Equal texts share a shard. An atom larger than a fair share of what is left gets a shard of
    its own, the largest first, and the others are cut at the smallest feasible capacity. Rows
    with equal ids and texts are interchangeable. `slot` counts from 0 without gaps in each
    shard. An empty table gives an empty one; with fewer atoms than shards some stay empty.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    facts = materialise(docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h")), "sizes")
    atoms = facts.groupBy("h").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "h").limit(shards).collect()  # bounded: shards
    total, left, alone = facts.agg(F.sum("size")).first()[0] or 0, shards, []
    for atom in atoms:
        if left == 1 or atom["size"] * left <= total:
            break
        alone.append(atom["h"])
        total, left = total - atom["size"], left - 1
    rest = facts.where(~F.col("h").isin(alone)) if alone else facts
    largest = atoms[len(alone)]["size"] if len(alone) < len(atoms) else 0
    cuts = minimax_cuts(rest.select("h", "size"), left, largest, total) if total else []
    shard = F.lit(len(alone)) + sum((F.col("h") >= F.lit(c).cast("long")).cast("int") for c in cuts if c < 2**63)
    for k, h in enumerate(alone):
        shard = F.when(F.col("h") == F.lit(h), k).otherwise(shard)
    placed = facts.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # bounded: shards * PARTS
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("inside", inside).join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("before") + F.col("inside") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
