"""Prefix trie, hard negatives and approximate neighbours against brute force."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import crosspolytope, negatives, trie
from tests.llm.conftest import SF

TURNS = "conv_id long, turn long, role string, text string, depth string, weight string, top_conv string"


def brute_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(turns.get(c - c % 100, [])[:h] + ts[h:])
    nodes, kids = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    for s in nodes:
        if s:
            kids[s[:-1]] = kids.get(s[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for s, members in nodes.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(members) - 1) * len(s[-1][1]) if s else 0
    out = []
    for s, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if whole[c] == s)
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), kids.get(s, 0), leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def conversations(seed):
    pick = np.random.default_rng(seed)
    rows = []
    for c in [*range(0, 60), *range(100, 180), 1000, 1001]:
        for t in range(int(pick.integers(1, 9))):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", str(pick.choice(["a", "b", "", "ünï😀"]))))
    rows += [(200, t, "user", f"long {t}") for t in range(300)]  # a deep chain
    rows += [(c, t, "user", "same") for c in range(300, 340) for t in range(7)]  # copies
    rows += [(400, None, "user", "first"), (400, 0, None, "x"), (400, 0, None, None), (401, 1, "user", None), (401, 1, "user", None), (None, 0, "user", "no id"), (3, None, None, None)]
    rows += [(500, 5, "user", "z" * 50_000), (777, 0, "user", "base absent")]
    return rows


@pytest.mark.parametrize("small", [1 << 15, 8])
def test_trie_equals_brute_force(spark, small, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    monkeypatch.setattr(trie, "LISTED", 4)
    rows = conversations(3)
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(5)
    got = [tuple(r) for r in trie.prefix_trie(frame, small=small).collect()]
    assert sorted(got, key=lambda r: r[:2]) == brute_trie(rows)


def test_no_conversations_no_nodes(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).count() == 0
    only_null = spark.createDataFrame([(None, 0, "user", "x", "", "", "")], TURNS)
    assert trie.prefix_trie(only_null).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.randoms())
def test_centroid_sums_equal_sums_over_descendants(draws, random):
    parent = np.array([-1] + [draws[k] % k if random.random() < 0.8 else -1 for k in range(1, len(draws))])
    own = np.array([[d % 100, 1] for d in draws])
    members = np.array([1 + d % 7 for d in draws])
    want, weight = own.copy(), members.copy()
    for k in range(len(draws) - 1, 0, -1):
        if parent[k] >= 0:
            want[parent[k]] += want[k]
            weight[parent[k]] += weight[k]
    assert (trie.decompose(parent, weight, own) == want).all()


VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, cell string, rank string"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], VECTORS).repartition(4)


def odd_vectors(pick, n=500, d=13):
    rows = [(k, [float(x) for x in pick.normal(size=d) * 0.3], int(pick.integers(0, 4))) for k in range(n)]
    rows += [(900, None, 1), (901, [None] * d, 1), (1000, [math.nan] * d, 1), (1100, [math.inf] * d, 2), (1200, [1.0, 2.0], 1), (1201, [2.0, 1.0], 1), (1202, [1.0, 2.0], 2)]
    rows += [(None, [1.0] * d, 1), (1300, [0.5] * d, None), (1400, [0.0] * d, 3), (1401, [], 1), (1500, [], 1), (1600, rows[7][1], 2), (1601, rows[7][1], 3), (1602, rows[7][1], 2)]
    return rows + [rows[7], rows[7]]


def whole_rows(rows):
    good = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            label = (label + 1) % 10 if i % 7 == 0 else label
            good[i] = min(good.get(i, ([math.inf], 0)), ([math.floor(256 * float(np.float32(x))) for x in v], label))
    return good


def brute_negatives(rows):
    good, out = whole_rows(rows), set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, (v, label) in good.items():
        if a % 100 == 0:
            scored = [(-dot(v, w), i, other) for i, (w, other) in good.items() if i != a and len(w) == len(v)]
            for p, at, _ in sorted(s for s in scored if s[2] == label)[:5]:
                inside = sorted(s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p)[:5]
                out |= {(a, at, r + 1, i, -p, -s) for r, (s, i, _) in enumerate(inside)}
    return out


def changed_label():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def test_negatives_equal_brute_force(spark):
    rows = odd_vectors(np.random.default_rng(5))
    frame = vectors(spark, rows)
    for block in (1 << 22, 13 * 8 * 20):
        got = negatives.mine(frame, F.col("vec_id") % 100 == 0, changed_label(), block_bytes=block).collect()
        assert {tuple(r) for r in got} == brute_negatives(rows) and len(got) == len(brute_negatives(rows))
    assert negatives.mine(frame.limit(0), F.col("vec_id") % 100 == 0, changed_label()).count() == 0


def test_scores_in_residues_are_exact():
    pick = np.random.default_rng(8)
    for d in (0, 1, 63, 64, 65, 300):
        for high in (1, 300, 10**5, 2**30):
            a, b = pick.integers(-high, high + 1, (9, d)), pick.integers(-high, high + 1, (11, d))
            exact = a.astype(object) @ b.T.astype(object) if d else np.zeros((9, 11), object)
            assert (negatives.scores(a, b).astype(np.int64) == np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)).all(), (d, high)
    same = np.full((2, 64), 510)
    assert (negatives.scores(same, -same) == -64 * 510 * 510).all()
    huge = np.full((1, 100), 2**62)
    assert negatives.scores(huge, huge)[0, 0] == 2**63 - 1 and negatives.scores(huge, -huge)[0, 0] == 1 - 2**63


def brute_neighbours(rows, k=10):
    good = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            v = [float(np.float32(x)) for x in v]
            good[i] = min(good.get(i, v), v)
    out = {}
    for q, v in good.items():
        if q % 100 == 0:
            out[q] = sorted((math.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), c) for c, w in good.items() if c != q and len(w) == len(v))[:k]
    return out


def test_neighbours_with_every_cell_visited_are_exact(spark):
    rows = odd_vectors(np.random.default_rng(6))
    want = brute_neighbours(rows)
    frame = vectors(spark, rows)
    for hashing in ((crosspolytope.Hash(2, 3), 8), (crosspolytope.Hash(1, 0), 1)):
        got = crosspolytope.search(frame, F.col("vec_id") % 100 == 0, hashing=hashing, shard_bytes=2000, slice_rows=16).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == sorted((q, n + 1, c) for q, near in want.items() for n, (_, c) in enumerate(near))
        score = {(r["query_id"], r["vec_id"]): r["score"] for r in got}
        assert all(math.isclose(score[q, c], far, rel_tol=1e-12) for q, near in want.items() for far, c in near)
    assert crosspolytope.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("sort", ["given", "uniform", "lengths", "copies"])
def test_measured_probes_reach_the_recall(spark, sort):
    pick = np.random.default_rng(9)
    if sort == "given":
        rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    else:
        x = pick.normal(size=(4000, 24))
        if sort == "lengths":
            x *= np.exp(pick.normal(size=(4000, 1)))
        if sort == "copies":
            x[1000:3000] = x[7]
        rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    want = brute_neighbours(rows)
    got = {}
    for r in crosspolytope.search(vectors(spark, rows), F.col("vec_id") % 100 == 0, slice_rows=500).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["score"]
    # a row is right if it is as near as the last true neighbour
    hits = sum(far <= want[q][-1][0] + 1e-9 for q, found in got.items() for far in found.values())
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(got[q]) == len(near) for q, near in want.items())


def test_cells_are_the_first_probes():
    x = np.random.default_rng(4).normal(size=(50, 20))
    for bits in (1, 5, 6, 9, 13):
        hashed = crosspolytope.Hash(3, bits)
        cells, probes = hashed.cells(x), hashed.probes(x, 4)
        assert (probes[:, :, 0] == cells).all()
        assert all(len(set(p)) == len(p) for row in probes for p in row)
        assert (cells >> bits == np.arange(3)).all()
    every = crosspolytope.Hash(1, 5).probes(x, 32)
    assert (np.sort(every[:, 0], axis=1) == np.arange(32)).all()
