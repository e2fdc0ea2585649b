"""Top-k search and chat formatting."""

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import chat, topk

VECTORS = "vec_id long, embedding array<float>, id string, asks string"


def brute(rows, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * float(np.float32(x))) for x in v]
            good[i] = min(good.get(i, whole), whole)
    out = set()
    for q, v in good.items():
        if q % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in good.items() if c != q and len(w) == len(v))
            out |= {(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])}
    return out


def test_search_equals_brute_force(spark):
    pick = np.random.default_rng(1)
    rows = [(int(k), [float(x) for x in pick.normal(size=13)]) for k in range(400)]
    rows += [(500, None), (501, [None] * 13), (550, [math.nan] * 13), (600, [math.inf] * 13), (650, [1.0, 2.0]), (651, [2.0, 1.0]), (700, []), (701, []), (None, [1.0] * 13)]
    rows += [(750, rows[3][1]), (751, rows[3][1]), (752, rows[3][1]), (752, rows[3][1]), (800, [0.0] * 13), (801, [1e4] * 13)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    for size in (4096, 64):
        got = topk.search(frame, F.col("vec_id") % 50 == 0, query_rows=size // 16, candidate_rows=size)
        assert {tuple(r) for r in got.collect()} == brute(rows)
    assert topk.search(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_coarse_bounds_hold():
    pick = np.random.default_rng(2)
    q, c = pick.integers(-300, 300, (40, 24)), pick.integers(-300, 300, (50, 24))
    for segments in (1, 4, 16, 24):
        bound = topk.statistics(q, segments) @ topk.statistics(c, segments).T
        assert (bound >= q @ c.T - 1e-6).all()


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.lists(st.sampled_from(["<", "|", "\\", "im_end", "|>", "<|im_start|>", "x"]), max_size=12).map("".join)))
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.parse(chat.render([("user", text), (text, "y")])[0]) == [("user", text), (text, "y")]


@pytest.fixture(scope="module")
def coder(tokenizers):
    with open(f"{tokenizers}/byte_bpe_50k.json", encoding="utf-8") as file:
        return chat.tokenizer(file.read())


def test_the_mask_covers_the_trained_texts(coder):
    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.one_of(st.text(max_size=20), st.sampled_from([" a", "\n\n b ", "<|im_end|>", "日本 😀", "<\\|", "<"]))), max_size=6))
    def check(turns):
        turns = [(r, t.encode("utf-8", "ignore").decode()) for r, t in turns]
        text, spans = chat.render(turns)
        offsets = np.array(coder.encode(text, add_special_tokens=False).offsets, np.int32).reshape(-1, 2)
        mask = chat.mask(offsets[:, 0], offsets[:, 1], spans)
        assert chat.masked_texts(text, offsets[:, 0], offsets[:, 1], mask) == [t for r, t in turns if r == "assistant" and t]
        assert chat.parse(text) == turns

    check()


def test_odd_conversations(spark, tokenizers):
    rows = [(1, 1, "assistant", None), (1, 0, None, "q"), (None, 0, "assistant", "no id"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, None, "user", "z" * 40_000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat.digest(chat.format_conversations(frame, f"{tokenizers}/byte_bpe_50k.json")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("\nq\nassistant\n\n") and got[1]["loss_chars"] == 0
    assert got[None]["loss_sha256"] == sha("no id") and got[2]["loss_sha256"] == sha("aa") and got[2]["n_turns"] == 3
    assert chat.format_conversations(frame.limit(0), f"{tokenizers}/byte_bpe_50k.json").count() == 0
