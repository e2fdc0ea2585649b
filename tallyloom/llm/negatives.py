"""Hard negatives for every anchor and positive, from exact scores in a residue number system.

Scores are inner products of whole numbers. A float32 product of matrices is exact while its sums
stay below 2 ** 24, so the components are taken modulo a few primes below 2 ** 10, 64 components at
a time, and the products are reduced modulo each prime. The Chinese remainder theorem (mixed radix,
balanced digits) gives the signed score back; as many primes are used as the lengths of the vectors
ask for.

Anchors and candidates are dealt into blocks of bounded bytes by a hash of their id, and every pair
of blocks is one task. A block of A anchors and C candidates moves A + C vectors for A * C scores,
so products, not the shuffle, are the cost at any size; labels are no key of any shuffle, so a
frequent label loads nobody. One pass finds each anchor's positives, another one, which knows their
scores, the negatives in each positive's window. Only the best few rows of a block leave it, and a
window over them ranks the whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.vectors import cores, matrix, usable
from tallyloom.session import materialise

#: The largest primes below 1024: 64 products of balanced residues stay below 2 ** 24.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983, 977, 971, 967, 953, 947, 941, 937, 929, 919)
CHUNK = 64
#: Bytes of anchors and of candidates (8 for each component) in a block, and scores of a block pair.
BLOCK_BYTES, BLOCK_SCORES = 4 << 20, 1 << 23
_LOW, _HIGH = 1 - 2**63, 2**63 - 1


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues of whole numbers modulo p, as float32."""
    r = x % p
    return np.where(r > p // 2, r - p, r).astype(np.float32)


def reduced(x: np.ndarray, p: int) -> np.ndarray:
    """The same for float32 values that are whole and below 2 ** 24; off the balance by rounding at most."""
    return x - np.float32(p) * np.rint(x * np.float32(1 / p))


def product(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """a @ b.T modulo p in float32; the components go in chunks whose sums are exact."""
    total = None
    for k in range(0, a.shape[1], CHUNK):
        part = reduced(residues(a[:, k : k + CHUNK], p) @ residues(b[:, k : k + CHUNK], p).T, p)
        total = part if total is None else reduced(total + part, p)
    return np.zeros((len(a), len(b)), np.float32) if total is None else total


def primes_for(a: np.ndarray, b: np.ndarray) -> tuple[int, ...]:
    """Enough primes for every score of two matrices, by Cauchy and Schwarz, with room to spare."""
    longest = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0))
    bound, count, held = 8 * (longest(a) * longest(b) + 1), 1, PRIMES[0]
    while held < bound and count < len(PRIMES):
        held *= PRIMES[count]
        count += 1
    return PRIMES[:count]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two int64 matrices, exact, as float64 or (if large) int64.

    Scores beyond 64 bits, which components above 2 ** 31 could have, are held to the 64-bit range.
    """
    primes = primes_for(a, b)
    parts = [product(a, b, p) for p in primes]
    digits: list[np.ndarray] = []
    for k, (p, r) in enumerate(zip(primes, parts)):
        # the digit of p: (r - value of the digits so far) / (product of the primes so far), modulo p
        seen, place = np.zeros_like(r), 1
        for q, digit in zip(primes, digits):
            weight = np.float32(((place % p) + p // 2) % p - p // 2)
            seen = reduced(seen + weight * digit, p)
            place *= q
        inverse = np.float32((pow(place % p, -1, p) + p // 2) % p - p // 2) if k else np.float32(1)
        digits.append(reduced(reduced(r - seen, p) * inverse, p))
    small = len(primes) <= 5  # below 2 ** 50, so doubles are exact
    out = np.zeros(digits[0].shape, np.float64 if small else object)
    for p, digit in zip(primes[::-1], digits[::-1]):
        out = out * p + (digit.astype(np.float64) if small else digit.astype(np.int64).astype(object))
    return out if small else np.clip(out, _LOW, _HIGH).astype(np.int64)


def first(values: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values, ties by smaller id."""
    if len(values) > 4 * k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        near = np.flatnonzero(values >= least)
    else:
        near = np.arange(len(values))
    return near[np.lexsort((ids[near], -values[near]))[:k]]


def positives(a_ids, a_labels, a, c_ids, c_labels, c, k: int):
    """(anchor, other row, score): the k best rows of the anchor's label in this block."""
    out: list[tuple] = [(a_ids[:0], c_ids[:0], np.zeros(0, np.int64))]
    table = scores(a, c)
    for row in range(len(a)):
        mine = np.flatnonzero((c_labels == a_labels[row]) & (c_ids != a_ids[row]))
        keep = mine[first(table[row, mine], c_ids[mine], k)]
        out.append((np.full(len(keep), a_ids[row]), c_ids[keep], table[row, keep].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def negatives(a_ids, a_labels, a, found: list, c_ids, c_labels, c, k: int, low: int, high: int):
    """(anchor, positive, negative, positive's score, score): the k best of each window in this block.

    The window holds rows of other labels with low * positive <= 100 * score <= high * positive.
    """
    out: list[tuple] = [(a_ids[:0], a_ids[:0], c_ids[:0], np.zeros(0, np.int64), np.zeros(0, np.int64))]
    table = scores(a, c)
    for row in range(len(a)):
        other = np.flatnonzero(c_labels != a_labels[row])
        value = table[row, other]
        for pair in found[row]:
            at, theirs = pair["id"], pair["score"]
            least, most = -(-low * theirs // 100), high * theirs // 100
            inside = np.flatnonzero((value >= least) & (value <= most)) if least <= most else other[:0]
            keep = inside[first(value[inside], c_ids[other[inside]], k)]
            n = len(keep)
            out.append((np.full(n, a_ids[row]), np.full(n, at), c_ids[other[keep]], np.full(n, theirs), value[keep].astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out))


def mine(vectors: DataFrame, is_anchor: Column, label: Column, k_positive: int = 5, k_negative: int = 5, low: int = 80, high: int = 100,
         scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components count as floor(scale * x). An anchor's positives are its `k_positive` best other rows
    of the same label; for each, the `k_negative` best rows of other labels whose score is between
    `low` and `high` per cent of the positive's. Ties go to the smaller id; fewer rows are all
    returned; a positive below zero has no window. Rows with a null id, label or vector, or a null
    or non-finite component take no part. Of rows with one id the one with the least vector, then
    label, counts. Only vectors of one length meet. An empty table gives none.
    """
    rows = usable(vectors.where(label.isNotNull()), id_col, vector_col, label=label.cast("string"), asks=F.coalesce(is_anchor, F.lit(False)))
    whole = rows.withColumn("v", F.transform("v", lambda e: F.floor(e.cast("double") * scale).cast("long")))
    whole = materialise(whole, "negatives-rows")  # read by both passes
    sizes = whole.agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"), F.coalesce(F.max("width"), F.lit(0)).alias("width")).first()
    most = max(1, block_bytes // (8 * max(1, sizes["width"])))
    askers = max(1, -(-sizes["asked"] // min(most, 2048)))
    alike = max(64, -(-sizes["n"] * askers // (3 * cores(vectors))))  # so that no core is idle while the table is small
    blocks = max(1, -(-sizes["n"] // min(most, alike, max(64, BLOCK_SCORES // max(1, -(-sizes["asked"] // askers))))))
    spread = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    to_all = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["id", "v", "width", "label"]
    none = F.lit(None).cast("array<struct<id:bigint,score:bigint>>").alias("found")
    offered = whole.select(*columns, F.lit(False).alias("asks"), none, to_all(askers).alias("row"), spread(blocks, 2).alias("col"))

    def asked(anchors: DataFrame) -> DataFrame:
        return anchors.select(*columns, F.lit(True).alias("asks"), "found", spread(askers, 1).alias("row"), to_all(blocks).alias("col"))

    def sides(table: pa.Table):
        ids, asks = table.column("id").to_numpy(), table.column("asks").to_numpy(zero_copy_only=False)
        names = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        v = matrix(table.column("v"), table.column("width")[0].as_py(), np.int64)
        return (ids[asks], names[asks], v[asks]), (ids[~asks], names[~asks], v[~asks]), pa.array(asks)

    def pass_one(table: pa.Table) -> pa.Table:
        anchor, other, _ = sides(table)
        got = positives(*anchor, *other, k_positive)
        return pa.table(dict(zip(("anchor_id", "id", "score"), got)))

    def pass_two(table: pa.Table) -> pa.Table:
        anchor, other, asks = sides(table)
        found = table.column("found").filter(asks).to_pylist()
        got = negatives(*anchor, found, *other, k_negative, low, high)
        return pa.table(dict(zip(("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"), got)))

    def met(anchors: DataFrame):
        return asked(anchors).unionByName(offered).groupBy("row", "col", "width")

    near = met(whole.where("asks").withColumn("found", none)).applyInArrow(pass_one, "anchor_id long, id long, score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_positive)
    found = near.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("id", "score")).alias("found"))  # k_positive at most
    anchors = materialise(whole.where("asks").join(found, "id"), "negatives-anchors")
    far = met(anchors).applyInArrow(pass_two, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k_negative)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
