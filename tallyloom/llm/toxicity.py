"""Severity of abuse by cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w . x - threshold_k): one weight vector for all ordered thresholds. The
features are the words of a text and their beginnings, as log(1 + count) of those features that
tell toxic texts apart best. Labels say only toxic or not, so the grades 1 to 3 of toxic texts
are the thirds of how much abuse they hold: the sum of their telling features. Grade 0 is a
clean text.

Counts come from Spark aggregates over a hash sample of labelled rows (all of them up to
`sample_rows`, else that many on average); the regression runs on the sample's chosen features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import PUNCTUATED, chunks, hash_words, slices

GRADES = 4
BITS = 20
FEATURES = 256
SAMPLE_ROWS = 20_000
PREFIXES = (4, 5)


@dataclass
class Model:
    """slots: feature bucket -> place in `weights`, or -1; thresholds for grades above 0, 1, 2."""

    slots: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def buckets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word and its beginnings [word, kind], and word offsets of the texts."""
    words, at, starts = hash_words([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts], PUNCTUATED, PREFIXES)
    return np.stack([(h >> np.uint64(64 - BITS)).astype(np.int64) for h in (words, *starts)], axis=1), at


def _counts(slots: np.ndarray, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the chosen features, in order."""
    found, at = buckets(texts)
    places, owner = slots[found], np.repeat(np.arange(len(texts)), np.diff(at))
    word, kind = np.nonzero(places >= 0)
    n = max(1, int(slots.max()) + 1)
    keys, count = np.unique(owner[word] * n + places[word, kind], return_counts=True)
    return keys // n, keys % n, count


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the labelled documents. Without toxic or without clean ones nothing is called toxic."""
    known = labels.select(labels[id_col].alias("id"), labels[toxic_col].cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about sample_rows (id, label) pairs: the bound makes the broadcast safe, so texts are not shuffled
    sample = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where("text is not null").join(F.broadcast(known), "id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), np.int32)
        for batch in slices(batches):
            texts, toxic = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for a, b in chunks(texts):
                found, at = buckets(texts[a:b])
                for k in range(b - a):
                    seen[toxic[a + k], np.unique(found[at[k] : at[k + 1]])] += 1
        used = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[0, used]), pa.array(seen[1, used])], names=["bucket", "clean", "bad"])

    sizes = sample.groupBy("toxic").count().collect()
    n_of = {r["toxic"]: r["count"] for r in sizes}
    slots = np.full(1 << BITS, -1, np.int32)
    if len(n_of) < 2:
        return Model(slots, np.zeros(1), np.full(GRADES - 1, 50.0))
    clean, bad = (F.col(c) / float(n_of[t]) for c, t in (("clean", 0), ("bad", 1)))
    split = (bad - clean) ** 2 / (bad + clean)
    chosen = (sample.mapInArrow(count, "bucket int, clean int, bad int").groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
              .where("clean + bad >= 3").select("bucket", (bad > clean).alias("telling"), split.alias("split")).orderBy(F.desc("split"), "bucket").limit(FEATURES).collect())
    slots[[r["bucket"] for r in chosen]] = np.arange(len(chosen))
    telling = np.array([r["telling"] and r["split"] > 0.01 for r in chosen], bool)
    shared = docs.sparkSession.sparkContext.broadcast(slots)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts):
                doc, feature, number = _counts(shared.value, texts[a:b])
                cut = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int32))) for x in (feature, number)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *lists], names=["toxic", "features", "counts"])

    got = sample.mapInArrow(rows, "toxic int, features array<int>, counts array<int>").toArrow()  # about sample_rows rows of chosen features
    x = np.zeros((got.num_rows, len(chosen)), np.float32)
    hits = np.zeros(got.num_rows)
    for k, (f, c) in enumerate(zip(got.column("features").to_pylist(), got.column("counts").to_pylist())):
        x[k, f] = np.log1p(c)
        hits[k] = x[k, telling].sum()
    toxic = got.column("toxic").to_numpy().astype(int)
    edges = np.quantile(hits[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(edges, hits, "right"), 0)
    order = np.lexsort((*x.T[:8], hits, grade))  # sums do not depend on the order of arrival
    weights, thresholds = fit_ordinal(x[order], grade[order])
    return Model(slots, weights, thresholds)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds of the cumulative-link model by Newton steps.

    For the score s = w . x of a row of grade g, with a = s - t[g-1] and b = s - t[g],

        log P(g) = log sigmoid(a) + log(1 - sigmoid(b)) + log(1 - exp(-(t[g] - t[g-1])))

    (the first term is missing for grade 0, the second for the last grade, the third for both),
    which is concave in weights and thresholds, so halved steps always get to the optimum.
    """
    n, d = x.shape
    k = GRADES - 1
    x = x.astype(np.float64)
    up, down = grade > 0, grade < k
    t_low, t_high = np.maximum(grade - 1, 0), np.minimum(grade, k - 1)
    inner = np.bincount(grade, minlength=GRADES)[1:k]  # rows between two thresholds

    def terms(point: np.ndarray) -> tuple:
        w, t = point[:d], point[d:]
        s, gap = x @ w, np.diff(t)
        if (gap <= 0).any():
            return -np.inf, None, None, gap
        a, b = s - t[t_low], s - t[t_high]
        fit_ = -(np.logaddexp(0, -a) * up).sum() - (np.logaddexp(0, b) * down).sum() + (inner * np.log1p(-np.exp(-gap))).sum() - ridge / 2 * w @ w
        return fit_, _sigmoid(a), _sigmoid(b), gap

    point = np.concatenate([np.zeros(d), np.linspace(1, 3, k)])
    value, pa_, pb, gap = terms(point)
    for _ in range(rounds):
        ga, gb = (1 - pa_) * up, -pb * down
        ha, hb = pa_ * (1 - pa_) * up, pb * (1 - pb) * down
        slope = np.concatenate([x.T @ (ga + gb) - ridge * point[:d], -np.bincount(t_low, ga, k) - np.bincount(t_high, gb, k)])
        bend = np.zeros((d + k, d + k))
        bend[:d, :d] = x.T @ (x * (ha + hb)[:, None]) + ridge * np.eye(d)
        for j in range(k):
            bend[:d, d + j] = bend[d + j, :d] = -x.T @ (ha * (t_low == j) + hb * (t_high == j))
        bend[range(d, d + k), range(d, d + k)] = np.bincount(t_low, ha, k) + np.bincount(t_high, hb, k) + 1e-9
        pull, curve = inner / np.expm1(gap), inner * np.exp(-gap) / np.expm1(-gap) ** 2
        for j in range(k - 1):
            slope[d + j] -= pull[j]
            slope[d + j + 1] += pull[j]
            bend[d + j : d + j + 2, d + j : d + j + 2] += curve[j] * np.array([[1, -1], [-1, 1]])
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while (new := terms(point + size * step))[0] < value and size > 1e-6:
            size /= 2
        gain = new[0] - value
        if gain <= 0:
            break
        point, (value, pa_, pb, gap) = point + size * step, new
        if gain < 1e-6 * abs(value):
            break
    return point[:d], point[d:]


def grade_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) for every row: expected and likeliest grade, and whether any abuse is likelier than none.

    Null and empty texts are judged without features, as clean as the model's intercepts say.
    Repeated rows repeat; an empty table gives an empty one; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            score = np.zeros(len(texts))
            for a, b in chunks(texts):
                doc, feature, number = _counts(model.slots, texts[a:b])
                score[a:b] = np.bincount(doc, np.log1p(number) * model.weights[feature], minlength=b - a)
            above = _sigmoid(score[:, None] - model.thresholds)
            each = -np.diff(np.hstack([np.ones((len(texts), 1)), above, np.zeros((len(texts), 1))]), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.round(above.sum(1), 6)), pa.array(each.argmax(1).astype(np.int32)), pa.array(above[:, 0] >= 0.5)],
                names=["id", "severity", "grade", "toxic"])

    out = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, severity double, grade int, toxic boolean")
    return out.withColumnRenamed("id", id_col)
