"""Benchmark passages in documents by latent semantic retrieval.

The passages of the benchmark are TF-IDF vectors, with document frequencies counted over the whole
corpus. A randomised SVD, whose products with the passage matrix are Spark aggregates, gives their
latent space. Windows of the documents are folded into it, words outside the benchmark being no
part of them, and a window whose cosine with a passage reaches `Options.cosine` is a candidate. A
block has no more passages than the space has dimensions (unless one item alone has), so the space
is complete for them and the cosine is that of the TF-IDF vectors.

A candidate is decided on the words around it, as bits of the passage's places: whether enough of
its words are there at all, then by the longest common subsequence with the passage and whether the
item's last words (its answer) are there, which lets a looser paraphrase count. Items of more than
64 words are several passages, each decided by itself. Items of fewer than eight words are looked
for word for word, by hashes of word sequences.

The benchmark is the query set. Frequencies take one pass over the corpus; the search holds
`Options.blocks_at_once` blocks in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import PUNCTUATED, chunks, hash_windows, hash_words, slices
from tallyloom.session import materialise

TERM_BITS = 20
PASSAGE, STRIDE = 64, 48
#: Steps folded at once.
FOLDED = 1 << 11
#: Tasks that multiply the passages, and rows of their products added up together.
PARTS, SUMMED = 8, 256
#: Words in the finest step; a window is four steps of its own, seen with two more on each side.
STEP = 4
WINDOWS = (16, 32, 64)
#: Items of fewer words are looked for word for word.
LEAST_WORDS = 8
ANSWER = 8


@dataclass
class Options:
    """Thresholds: cosine of a candidate; common subsequence alone, the same with the answer found."""

    rank: int = 320
    cosine: float = 0.2
    lcs: float = 0.75
    lcs_with_answer: float = 0.55
    answer: float = 0.5
    block_items: int = 256
    blocks_at_once: int = 8


@dataclass
class Passages:
    """The passages of one window length; bit k of a mask is the passage's word k."""

    vectors: np.ndarray  # unit vectors in the latent space
    items: np.ndarray
    masks: np.ndarray  # row of `latent` x passage -> places of that word
    sizes: np.ndarray
    tails: np.ndarray  # one place of each of the item's last words; 0 where the passage does not end the item


@dataclass
class Index:
    """One block of the benchmark: words of its items and the latent space of its passages."""

    slots: np.ndarray  # term bucket -> row of `latent`, 0 for words outside the block
    weight: np.ndarray  # idf of each row, 0 for row 0
    latent: np.ndarray  # idf * right singular vectors
    passages: dict[int, Passages]  # by window
    short: dict[int, dict[int, list[int]]]  # number of words -> hash of their sequence -> items
    rank: int


def _words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return hash_words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], PUNCTUATED)


def lcs(match: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence; match: word -> bits of its places in the item."""
    free = full = (1 << size) - 1
    for w in words:
        if m := match.get(w):
            hit = free & m
            free = ((free + hit) | (free - hit)) & full
    return size - free.bit_count()


def _places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def _terms(items: DataFrame) -> np.ndarray:
    """The buckets of all words of the benchmark, in order; at most 2 ** TERM_BITS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.unique(_words(batch.column(0).to_pylist())[0] >> np.uint64(64 - TERM_BITS))
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32))], names=["term"])

    return np.sort(items.select("text").mapInArrow(run, "term int").distinct().toArrow().column("term").to_numpy()).astype(np.int64)


def _frequencies(texts: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many documents a word of each bucket of the benchmark occurs; one pass for all blocks."""
    slots = np.zeros(1 << TERM_BITS, np.int32)
    slots[terms] = np.arange(1, len(terms) + 1)
    n = len(terms) + 1
    shared = texts.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(n, np.int64)
        for batch in slices(batches):
            docs = batch.column(1).to_pylist()
            for a, b in chunks(docs):
                words, offsets = _words(docs[a:b])
                rows = shared.value[(words >> np.uint64(64 - TERM_BITS)).astype(np.int64)].astype(np.int64)
                owner = np.repeat(np.arange(b - a), np.diff(offsets))
                pairs = np.unique(owner[rows > 0] * n + rows[rows > 0])
                seen += np.bincount(pairs % n, minlength=n)
        found = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(seen[found])], names=["term", "n"])

    counted = texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most 2 ** TERM_BITS rows
    out = np.zeros(1 << TERM_BITS)
    out[terms[counted.column("term").to_numpy() - 1]] = counted.column("n").to_numpy()
    return out


def _index(spark, block: list[tuple[int, str]], frequencies: np.ndarray, total: int, options: Options) -> Index:
    hashes, at = _words([t for _, t in block])
    every = [(i, hashes[a:b]) for (i, _), a, b in zip(block, at[:-1], at[1:])]
    short: dict[int, dict[int, list[int]]] = {}
    for i, ws in every:
        if 0 < len(ws) < LEAST_WORDS:
            short.setdefault(len(ws), {}).setdefault(int(hash_windows(ws, len(ws))[0]), []).append(i)
    items = [(i, ws) for i, ws in every if len(ws) >= LEAST_WORDS]
    bucket = lambda ws: (ws >> np.uint64(64 - TERM_BITS)).astype(np.int64)
    terms = np.unique(np.concatenate([np.zeros(0, np.int64), *(bucket(ws) for _, ws in items)]))
    slots = np.zeros(1 << TERM_BITS, np.int32)
    slots[terms] = np.arange(1, len(terms) + 1)
    n = len(terms) + 1
    weight = np.append(0.0, np.log((total + 1) / (frequencies[terms] + 1)) + 0.01)

    units = [(i, ws[a : a + PASSAGE], a + PASSAGE >= len(ws)) for i, ws in items for a in range(0, max(1, len(ws) - PASSAGE + STRIDE), STRIDE)]
    rows = [slots[bucket(ws)] for _, ws, _ in units]
    vectors = _singular_vectors(spark, rows, weight, max(1, min(max(options.rank, 1), len(units))))
    latent = (vectors * weight[:, None]).astype(np.float32)
    folded = np.array([latent[r].sum(0) for r in rows], np.float32).reshape(len(rows), latent.shape[1])
    folded /= np.array([np.sqrt((weight[r] ** 2).sum()) for r in rows], np.float32)[:, None]
    scale = np.array([next((w for w in WINDOWS if len(r) <= w), WINDOWS[-1]) for r in rows], int)
    passages = {}
    for window in WINDOWS:
        chosen = np.flatnonzero(scale == window)
        if not len(chosen):
            continue
        masks, tails = np.zeros((n, len(chosen)), np.uint64), np.zeros(len(chosen), np.uint64)
        for j, u in enumerate(chosen):
            for place, r in enumerate(rows[u]):
                masks[r, j] |= np.uint64(1 << place)
            _, ws, ends = units[u]
            if ends:
                tails[j] = sum(1 << place for place in {w: place for place, w in enumerate(ws[-ANSWER:].tolist(), len(ws[:-ANSWER]))}.values())
        passages[window] = Passages(folded[chosen], np.array([units[u][0] for u in chosen], np.int64), masks, np.array([len(rows[u]) for u in chosen]), tails)
    return Index(slots, weight.astype(np.float32), latent, passages, short, latent.shape[1])


def _singular_vectors(spark, rows: list[np.ndarray], weight: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages by randomised subspace iteration.

    The passages are a distributed table; each round multiplies by A and then by its transpose
    inside the tasks, adds the tasks' products up on executors, slice by slice of their rows and in
    the tasks' order, and orthonormalises their one sum on the driver (terms of a block x rank numbers).
    """
    n = len(weight)
    if not rows:
        return np.zeros((n, 1))
    # as an Arrow table: a list would start a second set of Python workers, which stay
    table = spark.createDataFrame(pa.table({"terms": pa.array(rows, pa.list_(pa.int32()))})).repartition(PARTS)
    basis = np.linalg.qr(np.random.Generator(np.random.PCG64(5)).standard_normal((n, rank)))[0]
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(basis)

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, x = np.zeros((n, rank)), shared.value
            for batch in batches:
                for terms in batch.column(0):
                    t = terms.values.to_numpy()
                    row = (x[t] * weight[t, None]).sum(0)
                    np.add.at(total, t, weight[t, None] * row)
            task = TaskContext.get().partitionId()
            for k in range(0, n, SUMMED):
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([task]), pa.array([total[k : k + SUMMED].tobytes()], pa.binary())], names=["first", "task", "part"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, part in zip(batch.column(0).to_pylist(), batch.column(2)):
                    sums[k] = sums.get(k, 0.0) + np.frombuffer(part.as_buffer(), np.float64)
            for k, total in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()], pa.binary())], names=["first", "part"])

        parts = table.mapInArrow(multiply, "first long, task long, part binary")
        added = parts.repartition(PARTS, "first").sortWithinPartitions("first", "task").mapInArrow(add, "first long, part binary").toArrow()
        product = np.empty((n, rank))
        for k, part in zip(added.column("first").to_pylist(), added.column("part")):
            product[k : k + SUMMED] = np.frombuffer(part.as_buffer(), np.float64).reshape(-1, rank)
        basis = np.linalg.qr(product)[0]
    return basis


def _enough(found: np.ndarray, around: np.ndarray, sizes: np.ndarray, tails: np.ndarray, options: Options) -> np.ndarray:
    """Whether so many words of passages decide for them; around: the places whose words are near."""
    here, last = np.bitwise_count(around & tails), np.bitwise_count(tails)
    loose = (found >= options.lcs_with_answer * sizes - 1e-9) & (last > 0) & (here >= options.answer * last - 1e-9)
    return loose | (found >= options.lcs * sizes - 1e-9)


def _folded(index: Index, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums in the latent space, and squared lengths, of each STEP of the rows (a multiple of STEP)."""
    steps = rows.reshape(-1, STEP)
    sums = np.empty((len(steps), index.latent.shape[1]), np.float32)
    held = np.empty((min(FOLDED, len(steps)), index.latent.shape[1]), np.float32)
    for start in range(0, len(steps), FOLDED):
        part, out = steps[start : start + FOLDED], sums[start : start + FOLDED]
        np.take(index.latent, part[:, 0], axis=0, out=out, mode="clip")
        for k in range(1, STEP):
            out += np.take(index.latent, part[:, k], axis=0, out=held[: len(part)], mode="clip")
    return sums, (index.weight[rows] ** 2).reshape(-1, STEP).sum(axis=1)


def candidates(index: Index, words: np.ndarray, at: np.ndarray, options: Options) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays (window, passage, first place, place behind, text, cosine) of the windows near passages.

    Windows are four steps long and begin at every step; texts are set apart by empty steps. For
    each window length also the words' rows in their places and the number of each place's word
    in its text are given.
    """
    rows = index.slots[(words >> np.uint64(64 - TERM_BITS)).astype(np.int64)]
    # each text begins at a whole number of the coarsest windows, so that steps add up to coarser ones
    coarse = WINDOWS[-1]
    counts = np.diff(at)
    # behind a text at least a window and a half less one word are empty, so what is around a window is of its text
    wide = -(-(counts + coarse // 2 - 1) // coarse) * coarse + coarse
    start = np.cumsum(wide) - wide + coarse
    place = np.repeat(start - at[:-1], counts) + np.arange(len(words))
    laid = np.zeros(int(wide.sum()) + 2 * coarse, np.int64)
    laid[place] = rows
    text = np.repeat(np.arange(-1, len(wide) + 1), np.concatenate([[coarse], wide, [coarse]]) // STEP)
    ends = np.concatenate([start + counts, [0, 0]])  # of no text at either end
    sums, squares = _folded(index, laid)
    step = STEP
    for window in WINDOWS:
        if step < window // 4:
            sums, squares, text = sums[0::2] + sums[1::2], squares[0::2] + squares[1::2], text[0::2]
            step *= 2
        these = index.passages.get(window)
        if these is None or not len(sums):
            continue
        part = max(1, (1 << 22) // max(1, len(these.items)))
        for low in range(0, len(sums), part):
            high = min(len(sums), low + part)
            near, norm = sums[low : high + 3] @ these.vectors.T, squares[low : high + 3]
            n = high - low
            cosine, square = near[:n].copy(), norm[:n].copy()
            for k in range(1, min(4, len(near))):  # a window's steps
                cosine[: len(near) - k] += near[k : k + n]
                square[: len(near) - k] += norm[k : k + n]
            cosine /= np.sqrt(np.maximum(square, 1e-12))[:, None]
            begins = np.arange(low, high) * step
            inside = np.flatnonzero(begins < ends[text[low:high]])  # windows begin in their text
            w, j = np.nonzero(cosine[inside] >= options.cosine)
            w = inside[w]
            if len(w):
                yield window, these, laid, start, begins[w], j, text[w + low], cosine[w, j]


def _decided(these: Passages, laid: np.ndarray, begin: np.ndarray, j: np.ndarray, reach: int, options: Options):
    """Of windows and passages: which hold them, the places in order and the places found, by `reach` words.

    They are the words from `begin` on; what is no word of the window's text there is an empty place.
    """
    masks, wide = these.masks.ravel(), these.masks.shape[1]

    def seen(keep):
        first, passage = begin[keep], j[keep]
        return (masks.take(laid.take(first + k) * wide + passage) for k in range(reach))

    sizes, tails = these.sizes[j], these.tails[j]
    around = np.zeros(len(begin), np.uint64)
    for places in seen(slice(None)):
        around |= places
    keep = np.flatnonzero(_enough(np.bitwise_count(around), around, sizes, tails, options))
    free = np.full(len(keep), 2**64 - 1, np.uint64)
    for places in seen(keep):
        hit = free & places
        free = (free + hit) | (free - hit)
    full = np.uint64(2**64 - 1) >> (np.uint64(64) - sizes[keep].astype(np.uint64))
    found = np.bitwise_count(~free & full)
    sure = _enough(found, around[keep], sizes[keep], tails[keep], options)
    keep, found = keep[sure], found[sure]
    last = np.maximum(np.bitwise_count(tails[keep]), 1)
    return keep, found / sizes[keep], np.bitwise_count(around[keep] & tails[keep]) / last


def leaks_in(index: Index, words: np.ndarray, at: np.ndarray, options: Options) -> dict[tuple[int, int], tuple]:
    """(text, item) -> (lcs, answer, cosine, -first word) of the best window."""
    out: dict[tuple[int, int], tuple] = {}

    def keep(text: int, item: int, row: tuple) -> None:
        if row > out.get((text, item), ()):
            out[text, item] = row

    for window, these, laid, start, begin, j, text, cosine in candidates(index, words, at, options):
        chosen, share, answer = _decided(these, laid, begin - window // 2, j, 2 * window, options)
        for k, s, t in zip(chosen.tolist(), share.tolist(), answer.tolist()):
            keep(int(text[k]), int(these.items[j[k]]), (round(s, 6), round(t, 6), round(float(cosine[k]), 6), -int(begin[k] - start[text[k]])))
    for n, wanted in index.short.items():
        sequences = hash_windows(words, n)
        inside = np.searchsorted(at, np.arange(len(sequences)), "right") == np.searchsorted(at, np.arange(len(sequences)) + n - 1, "right")
        for k in np.flatnonzero(inside & np.isin(sequences, np.array(list(wanted), np.uint64))).tolist():
            text = int(np.searchsorted(at, k, "right")) - 1
            for item in wanted[int(sequences[k])]:
                keep(text, item, (1.0, 1.0, 1.0, -int(k - at[text])))
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, options: Options | None = None, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, cosine, lcs, answer): every document that holds an item, with its best window.

    `lcs` is the share of the words of the item (of more than 64 words: of one of its passages)
    found in order, `answer` the share of its last words found. Ties go to the earlier window.
    Items of fewer than LEAST_WORDS words have to be there word for word. Null and empty texts hold
    nothing; null and wordless items are in nothing; repeated rows count once; an empty table on
    either side gives an empty result.
    """
    options = options or Options()
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    total = texts.count()
    wanted = benchmark.select(benchmark[item_col].cast("long").alias("item"), benchmark[item_text_col].cast("string").alias("text")).where("item is not null and text is not null").distinct()
    # a passage for each STRIDE words; a block has about block_items of them, whatever the items' lengths
    passages = F.greatest(F.lit(1), F.ceil(F.size(F.split("text", " ")) / STRIDE))
    blocks = max(1, -(-(wanted.agg(F.sum(passages)).first()[0] or 0) // options.block_items))
    numbered = materialise(wanted.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))), "benchmark")
    hits = None
    frequencies = _frequencies(texts, _terms(numbered))
    for first in range(0, blocks, options.blocks_at_once):
        some = [[(r["item"], r["text"]) for r in numbered.where(F.col("block") == b).orderBy("item", "text").collect()]  # about block_items passages each
                for b in range(first, min(blocks, first + options.blocks_at_once))]
        found = _search(spark, texts, [_index(spark, part, frequencies, total, options) for part in some], options, kind)
        hits = found if hits is None else hits.unionByName(found)
    best = hits.groupBy("id", "item_id").agg(F.max(F.struct("lcs", "answer", "cosine", (-F.col("first_word")).alias("back"))).alias("best"))
    return best.select(F.col("id").alias(id_col), "item_id", (-F.col("best.back")).alias("first_word"), "best.cosine", "best.lcs", "best.answer")


def _search(spark, texts: DataFrame, indexes: list[Index], options: Options, kind: str) -> DataFrame:
    shared = spark.sparkContext.broadcast(indexes)  # blocks_at_once blocks, each its terms x rank numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, out = batch.column(1).to_pylist(), []
            for a, b in chunks(texts, 500_000):
                words, offsets = _words(texts[a:b])
                for index in shared.value:
                    out += [(a + k, item, row) for (k, item), row in leaks_in(index, words, offsets, options).items()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([k for k, *_ in out], pa.int64())), pa.array([i for _, i, _ in out], pa.int64()), pa.array([-r[3] for *_, r in out], pa.int32()),
                 *(pa.array([r[c] for *_, r in out], pa.float64()) for c in (2, 0, 1))],
                names=["id", "item_id", "first_word", "cosine", "lcs", "answer"])

    return texts.mapInArrow(run, f"id {kind}, item_id long, first_word int, cosine double, lcs double, answer double")
