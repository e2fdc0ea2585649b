"""Language of a text by error-correcting output codes.

Every language gets a codeword. For each bit a binary classifier over letter n-grams tells the
languages whose codewords have that bit set from the others: a naive Bayes model whose n-gram
counts one grouped Spark aggregate gathers. A text is decoded to the codeword with the least
weighted loss, where a bit weighs as much as its classifier tells the two sides apart; a second
codeword nearly as close marks the text as ambiguous.

Fitting reads a sample of labelled rows chosen by a hash of their id: all of them up to
`sample_rows`, else that many on average. Prediction reads whole texts and nothing but texts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.words import chunks, slices

UNKNOWN = "und"
BUCKETS = 1 << 14
SAMPLE_ROWS = 40_000
#: Neighbouring n-grams say much the same, so evidence counts for a part.
DAMPING = 0.2
#: Below this share of the decoded weight the nearest codeword is called ambiguous.
CLEAR = 0.5

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> itself for letters, else 32."""
    if not _LETTERS:
        table = np.arange(0x110000, dtype=np.uint32)
        table[[not chr(c).isalpha() for c in range(0x110000)]] = 32
        _LETTERS.append(table)
    return _LETTERS[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter 1- to 3-grams at every code point, three for each, and offsets of the texts.

    Runs of other characters count as one blank; n-grams do not cross texts.
    """
    low = [t.lower() for t in texts]
    points = _letters()[np.frombuffer(("  ".join(["", *low, ""])).encode("utf-32-le", "surrogatepass"), np.uint32)]
    first = np.cumsum([2, *(len(t) + 2 for t in low)])
    blank = points == 32
    keep = ~(blank & np.concatenate(([False], blank[:-1])))  # of a run of blanks, the first
    keep[0] = True
    place = np.cumsum(keep) - 1
    kept = points[keep].astype(np.uint32)
    a, b, c = kept[:-2], kept[1:-1], kept[2:]
    grams = np.empty((len(a), 3), np.uint32)
    for k, h in enumerate((b, a * np.uint32(0x85EBCA6B) + b, a * np.uint32(0xC2B2AE35) + b * np.uint32(0x27D4EB2F) + c)):
        h = (h + np.uint32(k + 1)) * np.uint32(0x9E3779B1)
        grams[:, k] = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(18)
    grams[b == 32] = BUCKETS  # the n-gram around a blank says nothing of its own
    return grams, np.clip(place[first - 1], 0, len(a))


def codewords(n: int) -> np.ndarray:
    """n codewords as rows of +1/-1: all splits for up to 5 languages, else well-spread random ones."""
    if n < 2:
        return np.ones((n, 0), np.int8)
    if n <= 5:
        sides = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1 if i in s else -1 for s in sides] for i in range(n)], np.int8)
    length, best, far = 10 * int(np.ceil(np.log2(n))), None, -1
    pick = random.Random(11)
    for _ in range(50):
        code = np.array([[pick.choice((-1, 1)) for _ in range(length)] for _ in range(n)], np.int8)
        code = code[:, np.abs(code.sum(0)) < n]
        near = min(int((code[i] != code[j]).sum()) for i, j in combinations(range(n), 2))
        if near > far:
            best, far = code, near
    return best


@dataclass
class Model:
    """Languages, codewords [language, bit], bit weights and n-gram weights [bucket, bit]."""

    languages: list[str]
    code: np.ndarray
    bit_weight: np.ndarray
    gram_weight: np.ndarray


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from the rows where `train` holds and text and language are not null.

    The model's size is bounded by languages and buckets, not by rows. No usable row gives a
    model without languages, which predicts `und` for everything.
    """
    usable = docs.where(train & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    n = usable.count()
    share = min(1.0, sample_rows / max(1, n))
    if share < 1:
        usable = usable.where(F.pmod(F.xxhash64(usable[id_col]), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            order = sorted(range(len(langs)), key=langs.__getitem__)
            for start, end in chunks([texts[k] for k in order], 250_000):
                part = order[start:end]
                grams, offsets = ngrams([texts[k] for k in part])
                for k, (a, b) in zip(part, zip(offsets[:-1], offsets[1:])):
                    seen = counts.setdefault(langs[k], np.zeros(BUCKETS + 1, np.int64))
                    seen += np.bincount(grams[a:b].ravel(), minlength=BUCKETS + 1)
        for lang, seen in counts.items():
            at = np.flatnonzero(seen[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["lang", "bucket", "n"])

    parts = usable.select(usable[lang_col].cast("string").alias("lang"), usable[text_col].cast("string").alias("text")).mapInArrow(
        count, "lang string, bucket int, n long")
    rows = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    return _model(rows.column("lang").to_pylist(), rows.column("bucket").to_numpy(), rows.column("n").to_numpy())


def _model(langs: list[str], buckets: np.ndarray, n: np.ndarray) -> Model:
    languages = sorted(set(langs))
    counts = np.zeros((len(languages), BUCKETS))
    counts[np.array([languages.index(x) for x in langs], int), buckets] = n
    share = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS) if languages else counts
    code = codewords(len(languages))
    bits = code.shape[1]
    weight, bit_weight = np.zeros((BUCKETS + 1, bits), np.float32), np.zeros(bits)
    for k in range(bits):
        yes, no = share[code[:, k] > 0].mean(0), share[code[:, k] < 0].mean(0)
        weight[:BUCKETS, k] = np.log(yes / no)
        bit_weight[k] = 0.5 * ((yes - no) * np.log(yes / no)).sum()  # how far apart the sides are
    if bits:
        bit_weight /= bit_weight.sum()
    return Model(languages, code, bit_weight, weight)


def decode(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score (0 to 1) and whether a second codeword is about as close, for each text."""
    langs, scores, unclear = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    known = [k for k, t in enumerate(texts) if model.languages and t and any(map(str.isalpha, t))]
    for start, end in chunks([texts[k] for k in known], 250_000):
        part = known[start:end]
        grams, offsets = ngrams([texts[k] for k in part])
        evidence = np.zeros((len(grams) + 1, model.code.shape[1]), np.float64)
        for k in range(3):
            evidence[:-1] += model.gram_weight[grams[:, k]]
        margin = np.add.reduceat(evidence, offsets[:-1], axis=0) if model.code.shape[1] else np.zeros((len(part), 0))
        margin = np.clip(margin * DAMPING, -40, 40)
        # loss of a codeword: sum over bits of weight * log(1 + exp(-bit * margin))
        loss = (np.logaddexp(0, -model.code[None] * margin[:, None]) * model.bit_weight).sum(2)
        fit_ = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
        fit_ /= fit_.sum(1, keepdims=True)
        best = loss.argmin(1)
        for row, k in enumerate(part):
            langs[k] = model.languages[best[row]]
        scores[part] = fit_[np.arange(len(part)), best]
        unclear[part] = scores[part] < CLEAR if len(model.languages) > 1 else False
    return langs, scores, unclear


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All columns of the documents with `lang_pred`, `score` and `ambiguous` in place of any of those names.

    Null texts and texts without a letter are `und` with score 0. Ties between codewords go to
    the language first in order. Repeated rows repeat; an empty table stays empty.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    source = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores, unclear = decode(shared.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores), pa.array(unclear)], names=[*names, "lang_pred", "score", "ambiguous"])

    fields = [f.simpleString().split(":", 1) for f in source.schema.fields]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [*fields, ("lang_pred", "string"), ("score", "double"), ("ambiguous", "boolean")])
    return source.mapInArrow(run, schema)
