"""Approximate nearest neighbours by cross-polytope hashing with many probes.

A vector's direction goes through a pseudo-rotation (random signs and a Hadamard transform, three
times) and is assigned to the nearest of the 2 * d signed axes. A cell of a table is a tuple of
such assignments, the last one over fewer axes, so that the cells are about as many as asked for
and grow with the rows. A query visits, in each table, the cells whose axes it is nearest to, and
what it finds there is ranked by the exact distance between the original vectors.

How many cells a query visits is measured, not guessed: a bounded sample of queries is compared
with every row, and the least number of probes (and number of cells) is taken that finds the
wanted share of their true neighbours. So the wanted recall holds for vectors of any
distribution, at the price of more probes where directions say little; in the limit every cell
is visited and the search is exact.

Rows are stored once with their cells. For the search a row goes to the shard of each of its
cells and a query once to every shard that holds a probe of it; shards are bounded in bytes, and
a cell with very many rows (copies) is sliced over several shards by a hash of the id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.vectors import cores, matrix, usable
from tallyloom.session import materialise

#: Queries compared with every row to set the number of probes; at most this many probes a table.
SAMPLE, MOST_PROBES = 128, 4096
#: Bytes of vectors in a shard, and rows of one cell in a shard.
SHARD_BYTES, SLICE_ROWS = 8 << 20, 8192


@dataclass(frozen=True)
class Hash:
    """`tables` hash tables with 2 ** bits cells each, for vectors of any one length."""

    tables: int
    bits: int
    seed: int = 1

    def _functions(self, width: int) -> list[int]:
        """Coordinates each function of a table looks at; their cells multiply to 2 ** bits."""
        whole, left, out = max(1, (width - 1).bit_length()) + (1 if width > 1 else 0), self.bits, []
        while left > 0:
            out.append(1 << (min(whole, left) - 1))
            left -= min(whole, left)
        return out

    def axes(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """For each table and function the closeness of each direction to every signed axis."""
        width = x.shape[1]
        d = 1 << max(0, (width - 1).bit_length())
        big = np.abs(x).max(axis=1, keepdims=True, initial=0)
        unit = x / np.where(big > 0, big, 1)
        unit = unit / np.maximum(np.sqrt((unit * unit).sum(1, keepdims=True)), 1e-300)
        wide = np.zeros((len(x), d), np.float32)
        wide[:, :width] = unit
        out = []
        for table in range(self.tables):
            signs = np.random.Generator(np.random.PCG64([self.seed, table, d]))
            out.append([])
            for used in self._functions(width):
                y = wide
                for _ in range(3):
                    y = hadamard(y * signs.choice(np.array([-1, 1], np.float32), d))
                out[-1].append(np.hstack([y[:, :used], -y[:, :used]]))
        return out

    def cells(self, x: np.ndarray) -> np.ndarray:
        """One cell for each row and table, numbered through all tables."""
        out = np.zeros((len(x), self.tables), np.int64)
        for table, functions in enumerate(self.axes(x)):
            for near in functions:
                out[:, table] = out[:, table] * near.shape[1] + near.argmax(1)
            out[:, table] += table << self.bits
        return out

    def probes(self, x: np.ndarray, count: int) -> np.ndarray:
        """For each row and table the `count` nearest cells, nearest first (all, if there are fewer).

        A cell's distance is the sum over its functions of (best closeness - closeness) ** 2. Of
        functions with many axes only the nearest are combined, enough for about 8 * count cells.
        """
        out = []
        for table, functions in enumerate(self.axes(x)):
            code, far = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1), np.float32)
            for near in functions:
                size = near.shape[1]
                gap = (near.max(1, keepdims=True) - near) ** 2
                axis = np.argsort(gap, axis=1, kind="stable")[:, : max(2, min(size, count))]
                far = (far[:, :, None] + np.take_along_axis(gap, axis, 1)[:, None, :]).reshape(len(x), -1)
                code = (code[:, :, None] * size + axis[:, None, :]).reshape(len(x), -1)
                most = min(far.shape[1], 8 * count)
                if most < far.shape[1]:
                    keep = np.argpartition(far, most - 1, axis=1)[:, :most]
                    far, code = np.take_along_axis(far, keep, 1), np.take_along_axis(code, keep, 1)
            order = np.lexsort((code, far))[:, :count]
            out.append(np.take_along_axis(code, order, 1) + (table << self.bits))
        return np.stack(out, axis=1)


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of each row; the length is a power of two."""
    rows, d = x.shape
    step = 1
    while step < d:
        x = x.reshape(rows, d // (2 * step), 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        step *= 2
    return x.reshape(rows, d) / np.float32(np.sqrt(d))


def distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt(((rows - query) ** 2).sum(1))


def nearest(far: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, ties by smaller id."""
    near = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
    return near[np.lexsort((ids[near], far[near]))[:k]]


def _by_width(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Batches of columns (id, v, width) whose vectors have one length, of at most `rows` rows."""
    for batch in batches:
        widths = batch.column("width").to_numpy()
        for width in np.unique(widths).tolist():
            same = batch.filter(pa.array(widths == width))
            step = max(1, min(rows, (1 << 22) // max(1, width)))
            for k in range(0, same.num_rows, step):
                yield width, same.slice(k, step)


def truth(rows: DataFrame, sample: pa.Table, k: int) -> DataFrame:
    """(query_id, id, width, v, far): the k true neighbours of each sampled query, by one pass over all rows."""
    kept = rows.sparkSession.sparkContext.broadcast(sample)  # at most SAMPLE rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = kept.value
        widths = asked.column("width").to_numpy()
        groups = {w: asked.filter(pa.array(widths == w)) for w in np.unique(widths).tolist()}
        best: dict[int, list] = {q: [] for q in asked.column("id").to_pylist()}  # heaps of (-far, -id, vector)
        for width, batch in _by_width(batches, 4096):
            if width in groups:
                ids, x = batch.column("id").to_numpy(), matrix(batch.column("v"), width)
                for q, v in zip(groups[width].column("id").to_pylist(), matrix(groups[width].column("v"), width)):
                    far = distances(x, v)
                    far[ids == q] = np.inf
                    for at in nearest(far, ids, k).tolist():
                        if ids[at] != q:
                            entry = (-float(far[at]), -int(ids[at]), x[at])
                            if len(best[q]) < k:
                                heapq.heappush(best[q], entry)
                            elif entry[:2] > best[q][0][:2]:
                                heapq.heapreplace(best[q], entry)
        found = [(q, -i, len(v), v.tolist(), -f) for q, heap in best.items() for f, i, v in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.float64()))],
                                             names=["query_id", "id", "width", "v", "far"])

    part = rows.select("id", "v", "width").mapInArrow(run, "query_id long, id long, width int, v array<double>, far double")
    order = Window.partitionBy("query_id").orderBy("far", "id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank")


def tune(rows: DataFrame, queries: DataFrame, n: int, k: int, tables: int, recall: float) -> tuple[Hash, int]:
    """The hash and the probes a table that find `recall` of a sample's true neighbours at least cost.

    The cost is the share of all cells visited. With one cell everything is visited, so some
    choice always does.
    """
    sample = queries.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("id", "v", "width").toArrow()  # bounded: SAMPLE rows
    top = max(0, int(n / 4).bit_length() - 1)
    if not sample.num_rows or not top:
        return Hash(1, 0), 1
    pairs = truth(rows, sample, k).toArrow()  # bounded: SAMPLE * k rows
    asked = dict(zip(sample.column("id").to_pylist(), sample.column("v").to_pylist()))
    found: dict[int, list] = {}
    for q, v in zip(pairs.column("query_id").to_pylist(), pairs.column("v").to_pylist()):
        found.setdefault(q, []).append(v)
    best = (1.0, Hash(1, 0), 1)
    for bits in range(top, 0, -2):
        with_bits, most = Hash(tables, bits), min(1 << bits, MOST_PROBES)
        ranks: list[int] = []  # of the probe that finds each neighbour
        for q, near in found.items():
            cells = with_bits.cells(np.array(near))
            probes = with_bits.probes(np.array([asked[q]]), most)[0]
            hit = probes[None] == cells[:, :, None]
            ranks += np.where(hit.any(2), hit.argmax(2), most).min(1).tolist()
        ranks.sort()
        if ranks and ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] < most:
            need = ranks[int(np.ceil(recall * len(ranks))) - 1] + 1
            if (cost := tables * need / (1 << bits)) < best[0]:
                best = (cost, with_bits, need)
    return best[1], best[2]


def search(vectors: DataFrame, is_query: Column, k: int = 10, tables: int = 6, recall: float = 0.96, id_col: str = "vec_id",
           vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES, slice_rows: int = SLICE_ROWS, hashing: tuple[Hash, int] | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query by Euclidean distance.

    Ties go to the smaller id; a query is not its own neighbour; fewer candidates give fewer rows.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do null
    ids; of rows with one id the least vector counts. Only vectors of one length meet. Every row is
    indexed. `recall` is the share of true neighbours that the measured sample (`SAMPLE` queries)
    must find; `hashing` fixes the hash and the probes instead. An empty table gives none.
    """
    rows = materialise(usable(vectors, id_col, vector_col, nonzero=True, asks=F.coalesce(is_query, F.lit(False))), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.sum("width").alias("cells")).first()
    queries = rows.where("asks")
    hashed, probes = hashing or tune(rows, queries, sizes["n"], k, tables, recall)

    def to_cells(asking: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for width, batch in _by_width(batches, 256 if asking else 4096):
                x = matrix(batch.column("v"), width)
                cells = hashed.probes(x, probes).reshape(len(x), -1) if asking else hashed.cells(x)
                offsets = pa.array(np.arange(len(x) + 1) * cells.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))], names=["id", "cells"])

        return run

    columns = rows.select("id", "v", "width"), queries.select("id", "v", "width")
    placed = materialise(columns[0].mapInArrow(to_cells(False), "id long, cells array<long>"), "vector-cells")
    placed = placed.select("id", F.explode("cells").alias("cell"))
    hot = placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows)
    hot = materialise(hot.select("cell", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")), "hot-cells")
    probed = columns[1].mapInArrow(to_cells(True), "id long, cells array<long>").select("id", F.explode("cells").alias("cell"))
    average = 8 * sizes["cells"] / sizes["n"] if sizes["n"] else 1
    moved = (sizes["n"] + sizes["q"] * probes) * hashed.tables * average
    shards = int(max(3 * cores(vectors), -(-moved // shard_bytes)))
    slices = F.coalesce("slices", F.lit(1))
    shard = F.pmod(F.xxhash64("cell", "slice"), F.lit(shards)).alias("shard")
    held = placed.join(hot, "cell", "left").withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).select("id", "cell", shard)
    sought = probed.join(hot, "cell", "left").withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).select("id", "cell", shard)
    # a query, and a row that several tables put into one shard, go there once
    offered = held.groupBy("id", "shard").agg(F.collect_list("cell").alias("cells")).join(columns[0], "id").withColumn("asks", F.lit(False))
    asked = sought.groupBy("id", "shard").agg(F.collect_set("cell").alias("cells")).join(columns[1], "id").withColumn("asks", F.lit(True))

    def meet(table: pa.Table) -> pa.Table:
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        table = table.combine_chunks()
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        width = table.column("width")[0].as_py()
        mine, theirs = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        if mine.num_rows and theirs.num_rows:
            lists = theirs.column("cells").combine_chunks()
            cells = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(theirs.num_rows), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(cells, kind="stable")
            cells, owner = cells[order], owner[order]
            ids, x = theirs.column("id").to_numpy(), matrix(theirs.column("v"), width)
            for q, v, wanted in zip(mine.column("id").to_pylist(), matrix(mine.column("v"), width), mine.column("cells")):
                wanted = wanted.values.to_numpy()
                start, stop = np.searchsorted(cells, wanted), np.searchsorted(cells, wanted, "right")
                count = stop - start
                at = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
                at = np.unique(owner[at])
                at = at[ids[at] != q]
                far = distances(x[at], v)
                keep = nearest(far, ids[at], k)
                out.append((np.full(len(keep), q), ids[at[keep]], far[keep]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(c) for c in zip(*out)))))

    met = asked.unionByName(offered).groupBy("shard", "width").applyInArrow(meet, "query_id long, vec_id long, score double")
    once = met.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
