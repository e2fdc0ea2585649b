"""Exact largest inner products, found through segment statistics from coarse to fine.

For a segment of L components write the values as mean + deviation. Then

    distance(q, c)^2 >= sum over segments of L * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2)

and, as distance^2 = |q|^2 + |c|^2 - 2 * score, the same statistics bound the score from above by
sum of L * (mean_q * mean_c + dev_q * dev_c). A few long segments give a cheap bound, more
segments a closer one. Only pairs that still may enter a query's best k are multiplied out, in
whole numbers.

Queries and candidates are dealt into blocks by a hash of their id, and every pair of blocks is
one task, so a task holds two blocks whatever the table's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (4, 16)


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row: sum / sqrt(L) and sqrt(squared deviations) of every segment; their products bound scores."""
    edges = np.unique(np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int))[:-1]
    lengths = np.diff(np.append(edges, x.shape[1]))
    wide = x.astype(np.float64)
    sums, squares = np.add.reduceat(wide, edges, axis=1), np.add.reduceat(wide * wide, edges, axis=1)
    return np.hstack([sums / np.sqrt(lengths), np.sqrt(np.maximum(squares - sums * sums / lengths, 0))])


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, candidate id, score) of each query's k best other rows of this block."""
    out: list[tuple] = [(q_ids[:0], c_ids[:0], np.zeros(0, np.int64))]
    if not len(q) or not len(c):
        return out[0]
    if not c.shape[1]:  # empty vectors: all scores are 0
        levels, bound = [], np.zeros((len(q), len(c)))
    else:
        levels = [(statistics(q, s), statistics(c, s)) for s in LEVELS]
        bound = levels[0][0] @ levels[0][1].T
    bound[q_ids[:, None] == c_ids[None, :]] = -np.inf
    # doubles hold the products exactly unless values are huge
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, c.shape[1])
    fq, fc = (q.astype(np.float64), c.astype(np.float64)) if largest < 2**52 else (q, c)
    # rounding of the bounds stays far below this
    length = lambda x: np.sqrt((x.astype(np.float64) ** 2).sum(1))
    slack = 1e-9 * length(q) * length(c).max() + 1e-6
    tries = min(4 * k, len(c))
    near = np.argpartition(-bound, tries - 1, axis=1)[:, :tries]
    for row in range(len(q)):
        score = (fc[near[row]] @ fq[row]).astype(np.float64)
        score[~np.isfinite(bound[row, near[row]])] = -np.inf
        least = np.partition(score, -k)[-k] if tries >= k else -np.inf  # the k-th best so far
        left = np.flatnonzero((bound[row] >= least - slack[row]) & np.isfinite(bound[row]))
        for mine, theirs in levels[1:]:
            left = left[theirs[left] @ mine[row] >= least - slack[row]]
        exact = (fc[left] @ fq[row]).astype(np.int64)
        keep = np.lexsort((c_ids[left], -exact))[:k]
        out.append((np.full(len(keep), q_ids[row]), c_ids[left[keep]], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding",
           query_rows: int = 2048, candidate_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(scale * x) for each query.

    Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are null or hold
    null or non-finite components take no part, nor do null ids. Only vectors of one length meet;
    of rows with one id the least vector counts. Scores are 64-bit whole numbers.
    """
    x = F.col("v")
    usable = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"), is_query.alias("asks")).where(
        F.col("id").isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    whole = usable.select("id", F.coalesce("asks", F.lit(False)).alias("asks"), F.transform("v", lambda e: F.floor(e * scale).cast("long")).alias("v"))
    whole = whole.groupBy("id").agg(F.min("v").alias("v"), F.max("asks").alias("asks")).withColumn("width", F.size("v"))
    sizes = usable.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    blocks, askers = max(1, -(-sizes["n"] // candidate_rows)), max(1, -(-sizes["q"] // query_rows))
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = whole.where("asks").select("id", "v", "width", F.lit(True).alias("asks"), spread(askers, 1).alias("row"), to_all(blocks).alias("col"))
    offered = whole.select("id", "v", "width", F.lit(False).alias("asks"), to_all(askers).alias("row"), spread(blocks, 2).alias("col"))

    def meet(table: pa.Table) -> pa.Table:
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        width = table.column("width")[0].as_py()
        values = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        rows = values.astype(np.int64).reshape(len(ids), width)
        got = best(ids[asks], rows[asks], ids[~asks], rows[~asks], k)
        return pa.table({"query_id": got[0], "vec_id": got[1], "score": got[2]})

    parts = asked.unionByName(offered).groupBy("row", "col", "width").applyInArrow(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
