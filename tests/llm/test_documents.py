"""Operators on documents against brute force, and their odd cases."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm import components, decontaminate, jaccard, langid, licences, pieces, pii, shards, toxicity, words
from tallyloom.llm.queries import QUERIES, SQL
from tests.llm.conftest import SF
from tests.oracle_check import compare, duck

LONG = "word " * 30_000
ODD = [(1, None), (2, ""), (3, LONG), (4, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (6, "12 !?"), (7, "\n\n  "), (8, "x")]


def texts_of(spark, sf=SF):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# -- personal data


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and luhn % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "25", "256", ".", "@", "a", "é", "-", " ", "+", "(", "a@b.c", "+1 ", "4111 1111 1111 1111", "\n", "iban ", "://", "account 123456"]), max_size=20))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    found = pii.scan(text)
    assert [s[:3] for s in found if s[3]] == base_spans(text)
    kept = sorted((s[1], s[2]) for s in found if not s[3])
    assert all(a[1] <= b[0] for a, b in zip(kept, kept[1:]))


def test_added_kinds_and_redaction():
    text = "IBAN DE89 3704 0044 0532 0130 00, http://[::1]/, account no 12345678, jürgen@exämple.de, a@b.org"
    assert [s[0] for s in pii.scan(text)] == ["iban", "ipv6", "account", "intl_email", "email"]
    assert pii.redact(text, pii.scan(text)).endswith("account no <ACCOUNT>, <INTL_EMAIL>, <EMAIL>")
    assert pii.scan("IBAN DE00 3704 0044 0532 0130 00") == [] and pii.redact(None, []) is None


def test_added_kinds_have_no_least_distance_or_length():
    user, gap = "u" * 1000, " " * 500
    found = pii.scan(f"ftp://{user}:{user}@host/ account{gap}12345678 IBAN{gap}DE89370400440532013000 end")
    assert [s[0] for s in found] == ["login", "account", "iban"] and found[0][2] - found[0][1] == 2001
    import time

    start = time.time()
    pii.scan("://" * 100_000 + "account " * 50_000 + "x" * 500_000 + "iban" * 50_000 + " " * 200_000)
    assert time.time() - start < 5  # in proportion to the length


def test_pii_of_odd_rows(docs):
    rows = pii.digest(pii.find_pii(docs([*ODD, (9, "mail a@b.org now")]))).collect()
    assert len(rows) == len(ODD) + 1 and {r["doc_id"]: r["spans"] for r in rows}[9] == "email:5:12"
    assert pii.find_pii(docs([])).count() == 0
    clean = pii.redact_documents(docs([(1, None), (2, "x a@b.org")]))
    assert clean.columns == docs([]).columns
    assert {(r["text"], r["n_chars"]) for r in clean.collect()} == {(None, 0), ("x <EMAIL>", 9)}


# -- language


def test_language_held_out_accuracy(spark):
    rows = QUERIES["op2_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert len(rows) == len(truth) and np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(docs):
    train = docs([(10, "the cat and the dog", "en"), (11, "der hund und die katze", "de"), (12, "le chat et le chien", None)])
    model = langid.fit(train, F.lit(True))
    assert model.languages == ["de", "en"]
    got = {r["doc_id"]: r for r in langid.identify(docs([*ODD, (20, "und der hund")]), model).collect()}
    assert got[20]["lang_pred"] == "de" and [got[k]["lang_pred"] for k in (1, 2, 6, 7)] == ["und"] * 4
    assert langid.identify(docs([]), model).count() == 0
    none = langid.fit(docs([]), F.lit(True))
    assert none.languages == [] and langid.decode(none, ["abc"])[0] == ["und"]
    one = langid.fit(docs([(1, "abc", "en")]), F.lit(True))
    assert langid.decode(one, ["abc"])[0] == ["en"]


@pytest.mark.parametrize("n", [2, 4, 7])
def test_decoding_takes_the_codeword_of_least_weighted_loss(n):
    """Every n-gram, bit and codeword one by one."""
    import math

    pick = np.random.default_rng(n)
    code = langid.codewords(n)
    model = langid.Model([f"l{k}" for k in range(n)], code, pick.random(code.shape[1]), np.vstack([pick.normal(size=(langid.BUCKETS, code.shape[1])), np.zeros((1, code.shape[1]))]).astype(np.float32))
    texts = ["the cat", "a", "ünï code Ω", "many words " * 30, "x y z"]
    got = langid.decode(model, texts)
    for k, text in enumerate(texts):
        grams, at = langid.ngrams([text])
        margin = [min(40, max(-40, langid.DAMPING * sum(float(model.gram_weight[g, b]) for row in grams[at[0] : at[1]].tolist() for g in row))) for b in range(code.shape[1])]
        loss = [sum(w * math.log1p(math.exp(-int(bit) * m)) if -bit * m < 30 else w * -int(bit) * m for w, bit, m in zip(model.bit_weight, word, margin)) for word in code]
        best = min(range(n), key=loss.__getitem__)
        assert got[0][k] == f"l{best}"
        assert math.isclose(got[1][k], 1 / sum(math.exp(-2 * (x - loss[best])) for x in loss), rel_tol=1e-3, abs_tol=1e-6)
        assert got[2][k] == (got[1][k] < langid.CLEAR)


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 9, 20):
        code = langid.codewords(n)
        assert len({tuple(r) for r in code}) == n and (np.abs(code.sum(0)) < n).all()


# -- licences


def test_licences_in_lines_blocks_and_texts(docs):
    full = licences.TEMPLATES["MIT"][2]
    wrapped = "\n".join(full[k : k + 70] for k in range(0, len(full), 70))
    rows = [*ODD, (10, "intro\nReleased under the MIT License.\nend"), (11, f"Title here\n\n{full.replace('. ', '.' + chr(10))}\n\nmore of the text"), (12, full.replace(". ", ".\n")), (13, wrapped[:100])]
    got = {(r["doc_id"], r["unit"], r["licence"]) for r in licences.scan(docs(rows)).collect()}
    assert (10, "line", "MIT") in got and (11, "block", "MIT") in got and (12, "text", "MIT") in got
    assert not {d for d, *_ in got} & {1, 2, 3, 4, 5, 6, 7, 8, 13}
    assert licences.scan(docs([])).count() == 0


def test_licences_that_resemble_others_and_whole_texts(docs):
    gnu = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    heading = "{}\n   Version 3, {} 2007\n\nEveryone is permitted to copy this."
    rows = [
        (10, gnu.format("Affero")), (11, "Title\n\n" + gnu.format("Lesser").replace(", ", ",\n") + "\n\nend"), (12, gnu.replace("{} ", "")),
        (13, "Copyright (c) 2020 A. Person\n\n" + licences.MORE["BSD-2-Clause"][0].replace(". ", ".\n\n")), (14, "Copyright (c) 2020 A. Person\n\n" + licences.MORE["BSD-3-Clause"][0].replace(". ", ".\n\n")),
        (15, heading.format("GNU AFFERO GENERAL PUBLIC LICENSE", "19 November")), (16, heading.format("GNU GENERAL PUBLIC LICENSE", "29 June"))]
    got = {(r["doc_id"], r["licence"]) for r in licences.scan(docs([*ODD, *rows])).collect()}
    assert got == {(10, "AGPL-3.0"), (11, "LGPL-3.0"), (12, "GPL-3.0"), (13, "BSD-2-Clause"), (14, "BSD-3-Clause"), (15, "AGPL-3.0"), (16, "GPL-3.0")}


# -- set joins


def brute_components(rows, width=4, num=85, den=100):
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    inverted = defaultdict(set)
    for i, s in sets.items():
        for x in s:
            inverted[x].add(i)
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in inverted[x] if j < i}:
            same = len(s & sets[j])
            if same * den >= num * (len(s) + len(sets[j]) - same):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(seed=5):
    pick = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [pick.choice(vocabulary) for _ in range(60)]
    rows, n = [], 0
    for _ in range(60):
        base = [pick.choice(vocabulary) for _ in range(pick.choice((1, 2, 3, 4, 5, 8, 20, 60, 200)))]
        if pick.random() < 0.3:
            base += passage
        for _ in range(pick.choice((1, 1, 2, 6))):
            copy = list(base)
            for _ in range(pick.choice((0, 0, 1, 2, 4))):
                copy[pick.randrange(len(copy))] = pick.choice(vocabulary)
            rows.append((n, " ".join(copy)))
            n += 1
    return [*rows, (900, None), (901, ""), (902, " \t"), (903, "É x"), (904, "é x"), (905, "É X")]


@pytest.mark.parametrize("seed", [5, 6])
def test_set_join_loses_no_link(docs, seed):
    rows = near_copies(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.JaccardJoin(docs(rows)).members().collect()}
    assert got == brute_components(rows)


def test_set_join_of_odd_tables(docs):
    assert jaccard.JaccardJoin(docs([])).members().count() == 0
    assert jaccard.JaccardJoin(docs([(1, None)])).members().collect()[0][1:3] == (0, 1)
    rows = sorted(tuple(r)[:3] for r in jaccard.JaccardJoin(docs(ODD)).members().collect())
    assert rows == [(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4), (5, 2, 4), (5, 2, 4), (6, 1, 6), (7, 0, 7), (8, 1, 8)]


def test_rows_without_an_id_are_alone(docs):
    rows = [(None, "a b c d e"), (None, "a b c d e"), (7, "a b c d e"), (9, "a b c d e")]
    got = sorted((tuple(r)[:3] for r in jaccard.JaccardJoin(docs(rows)).members().collect()), key=str)
    assert got == [(7, 2, 7), (9, 2, 7), (None, 2, None), (None, 2, None)]


@pytest.mark.parametrize("num", [80, 85])
def test_partners_share_the_promised_number_of_keys(num):
    """Sets at the threshold share, in a band of both, as many tile keys as either of them says."""
    pick = np.random.default_rng(num)
    edges, unsure = jaccard.band_edges(30_000, num, 100), 0
    for n in [*range(1, 60), *pick.integers(60, 3000, 60).tolist(), 20_000]:
        a = pick.integers(0, 2**63, n).astype(np.uint64)
        for swap in (True, False):
            if swap:  # as many elements replaced as the threshold allows
                out = next(x for x in range(n, -1, -1) if 100 * (n - x) >= num * (n + x))
                b = np.concatenate((a[out:], pick.integers(0, 2**63, out).astype(np.uint64)))
            else:  # as many left out
                b = a[: -(-num * n // 100)]
            mine, theirs = ({band: (keys, common) for band, keys, common in jaccard.tile_keys(s, edges, num, 100)} for s in (a, b))
            both = mine.keys() & theirs.keys()
            assert both
            for band in both:
                shared = len(np.intersect1d(mine[band][0], theirs[band][0]))
                assert shared >= max(mine[band][1], theirs[band][1])
                unsure += min(mine[band][1], theirs[band][1]) < 1
    assert unsure < 30


@pytest.mark.parametrize("n", [100, 1000, 5000, 20_000])
def test_unrelated_sets_share_few_keys_and_differ_in_their_bits(n):
    pick = np.random.default_rng(n)
    edges = jaccard.band_edges(40_000, 80, 100)
    a, b = (pick.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
    b[: n // 4] = a[: n // 4]  # a passage that both hold
    assert 9 * jaccard.differing(jaccard.bitmap(a), jaccard.bitmap(b)) > 2 * n  # 2 * n / 9 elements may differ at 0.8
    for (_, x, promised), (_, y, _) in zip(*(jaccard.tile_keys(s, edges, 80, 100) for s in (a, b))):
        assert len(np.intersect1d(x, y)) < promised


def test_links_without_tiles_go_by_elements(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "SPARE", (0, 1))  # hardly a set is sure
    rows = near_copies(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.JaccardJoin(docs(rows)).members().collect()}
    assert got == brute_components(rows)


def test_a_large_group_of_near_copies_is_one_component(docs):
    """Copies of a text that differ among each other more than from it."""
    pick = random.Random(3)
    base = [f"w{k}" for k in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(120):
        copy = list(base)
        for k in pick.sample(range(150), 2):
            copy[k] = f"x{i}_{k}"
        rows.append((i if i % 2 else 1000 + i, " ".join(copy)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.JaccardJoin(docs(rows)).members().collect()}
    assert got == brute_components(rows) and len({c for _, c in got.values()}) < 20


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3000), st.integers(1, 3000), st.integers(0, 3000))
def test_signatures_of_any_width_bound_the_difference(seed, n, m, shared):
    pick = np.random.default_rng(seed)
    a, b = (np.unique(pick.integers(0, 2**63, k).astype(np.uint64)) for k in (n, m))
    b = np.unique(np.concatenate((b, a[:shared])))
    x, y = jaccard.signature(a), jaccard.signature(b)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    assert sum(int(v).bit_count() if v >= 0 else (int(v) + 2**64).bit_count() for v in x ^ y) <= len(np.setxor1d(a, b))


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=300), st.integers(0, 300))
def test_bitmaps_bound_the_difference(a, b, shared):
    b |= set(sorted(a)[:shared])
    x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
    assert jaccard.differing(jaccard.bitmap(x), jaccard.bitmap(y)) <= len(a ^ b)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 160)}}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_word_hashes_are_those_of_the_words(texts):
    blobs = [t.encode("utf-8", "ignore") for t in texts]
    hashes, at = words.hash_words(blobs)
    per = [b.split() for b in blobs]
    assert np.diff(at).tolist() == [len(w) for w in per]
    flat = [w for ws in per for w in ws]
    assert len(set(flat)) == len(set(hashes.tolist())) and all((a == b) == (x == y) for a, x in zip(flat[:20], hashes) for b, y in zip(flat[:20], hashes))


# -- decontamination


def test_every_planted_item_is_found(spark):
    sf = "/root/testdata/sf0.01"
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    holds = {(d, i) for d, t in texts_of(spark, sf).items() for i, x in items.items() if " ".join(x.split()) in " ".join((t or "").split())}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op4_decontaminate"](spark, sf).collect()}
    assert holds <= got and len(got - holds) <= 3


def test_paraphrases_and_odd_rows(spark, docs):
    item = "what colour is the clear sky on a bright summer day when the sun is high answer it is blue as every child knows well"
    loose = item.replace("clear", "cloudless").replace("bright", "fine").replace("every", "any")
    filler = " ".join(f"f{k}" for k in range(200))
    rows = [*ODD, (10, f"{filler} {item} {filler}"), (11, f"{filler} {loose} {filler}"), (12, filler), (13, item[:40] + filler)]
    rows += [(14, "this one is Too  short, surely"), (15, "too long to be short")]
    bench = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(rows), bench).collect()}
    assert got == {(10, 1), (11, 1), (14, 4)}  # few words only word for word
    assert decontaminate.find_leaks(docs([]), bench).count() == 0
    assert decontaminate.find_leaks(docs(rows), bench.limit(0)).count() == 0


def test_rare_words_around_hide_no_reworded_item(spark, docs):
    """The items' words stand in every document and those around in one, so further apart than at 30 GB."""
    sizes = (16, 17, 18, 19, 24, 33, 36, 38, 48, 60, 64)
    items = {k: [f"w{k}x{i}" for i in range(n)] for k, n in enumerate(sizes)}
    every = [w for ws in items.values() for w in ws]
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(1000 + d, " ".join(rng.permutation(every))) for d in range(200)]
    for k, ws in items.items():
        for shift in range(5):
            changed = [f"c{k}x{shift}x{i}" if i % 5 == 2 else w for i, w in enumerate(ws)]
            before, after = ([f"{side}{k}x{shift}x{i}" for i in range(100 + shift)] for side in "ba")
            rows.append((10 * k + shift, " ".join(before + changed + after)))
    bench = spark.createDataFrame([(k, " ".join(ws)) for k, ws in items.items()] + [(99, " ".join(f"nowhere{i}" for i in range(20)))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs(rows), bench).collect()}
    assert got == {(10 * k + shift, k) for k in items for shift in range(5)}


def common_vocabulary(seed, n_items=40):
    """Items and documents of the same few hundred words, with changed copies of items in documents."""
    pick = random.Random(seed)
    vocabulary = [f"v{int(k)}" for k in range(400)]
    draw = lambda n: pick.choices(vocabulary, weights=[1 / (k + 3) for k in range(400)], k=n)
    items = {i: draw(pick.randrange(14, 60)) for i in range(n_items)}
    items[500], items[501] = draw(150), draw(200)
    rows, planted = [], set()
    for d in range(120):
        body = draw(pick.randrange(30, 600))
        if d % 2:
            i = pick.choice(list(items))
            quoted = list(items[i][40:140] if len(items[i]) > 64 else items[i])
            if d % 4 == 1:  # one word in seven is another one
                quoted = [w if k % 7 != 3 else pick.choice(vocabulary) for k, w in enumerate(quoted)]
            at = pick.randrange(len(body))
            body = body[:at] + quoted + body[at:]
            planted.add((d, i))
        rows.append((d, " ".join(body)))
    return items, rows, planted


@pytest.mark.parametrize("seed", [1, 2])
def test_reworded_items_among_their_own_words_are_all_found(spark, docs, seed):
    items, rows, planted = common_vocabulary(seed)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    for options in (decontaminate.Options(), decontaminate.Options(block_items=8, blocks_at_once=2)):
        got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(docs(rows), bench, options).collect()}
        assert planted <= set(got)
    texts = dict(rows)
    for (d, i), r in got.items():  # what is found is there: some passage's words in order within the words around the window
        ws = texts[d].split()
        near = ws[max(0, r["first_word"] - 32) : r["first_word"] + 96]
        starts = range(0, max(1, len(items[i]) - 16), 48) if len(items[i]) > 64 else [0]
        assert max(decontaminate.lcs(decontaminate._places(p), len(p), near) / len(p) for p in (items[i][s : s + 64] for s in starts)) >= r["lcs"] - 1e-6


def test_the_latent_space_finds_the_candidates(spark, docs, monkeypatch):
    items, rows, planted = common_vocabulary(3, 10)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items.items()], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "_singular_vectors", lambda spark, rows, weight, rank: np.zeros((len(weight), rank)))
    assert decontaminate.find_leaks(docs(rows), bench).count() == 0


@given(st.lists(st.integers(0, 5), max_size=30), st.lists(st.integers(0, 5), max_size=30))
@settings(max_examples=100, deadline=None)
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert decontaminate.lcs(decontaminate._places(a), len(a), b) == table[-1][-1]


# -- toxicity


def test_toxic_documents_are_graded(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op6_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == 1000 and np.mean([got[k]["toxic"] == bool(v) for k, v in labels.items() if k in got]) > 0.98
    assert all(0 <= r["severity"] <= toxicity.GRADES - 1 for r in got.values())


def test_ordinal_fit_recovers_its_order():
    pick = np.random.default_rng(3)
    x = pick.normal(size=(4000, 3))
    score = x @ [2.0, -1.0, 0.0] + pick.logistic(size=4000)
    weights, thresholds = toxicity.fit_ordinal(x, np.searchsorted([0.0, 1.5, 3.0], score))
    assert np.allclose(weights, [2, -1, 0], atol=0.15) and np.allclose(thresholds, [0, 1.5, 3], atol=0.2)


def test_toxic_documents_are_graded_on_labels_not_learnt_from(spark):
    sf = "/root/testdata/sf0.1"
    documents, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(documents, labels.where("doc_id % 2 = 0"))
    held = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 2 = 1 and toxic is not null").collect()}
    got = {r["doc_id"]: r for r in toxicity.grade_documents(documents.where("doc_id % 2 = 1"), model).collect()}
    called = [(got[k]["toxic"], bool(v)) for k, v in held.items()]
    assert sum(v for _, v in called) > 20
    # 217 of 231 toxic ones as measured, from 218 toxic examples
    assert sum(a and b for a, b in called) > 0.9 * sum(b for _, b in called) and sum(a and not b for a, b in called) < 0.01 * len(called)
    # severity and grade from each word of a text on its own
    texts = {r["doc_id"]: r["text"] for r in documents.where("doc_id % 2 = 1 and doc_id < 400").collect()}
    for k, text in texts.items():
        seen = defaultdict(int)
        for row in toxicity.buckets([text])[0].tolist():
            for bucket in row:
                if model.slots[bucket] >= 0:
                    seen[model.slots[bucket]] += 1
        score = sum(np.log1p(c) * model.weights[f] for f, c in seen.items())
        above = [1.0, *(1 / (1 + np.exp(t - score)) for t in model.thresholds), 0.0]
        assert abs(got[k]["severity"] - sum(above[1:])) < 1e-5
        assert got[k]["grade"] == int(np.argmax([a - b for a, b in zip(above, above[1:])])) and got[k]["toxic"] == (above[1] >= 0.5)


def test_toxicity_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(1, 0), (4, 0), (4, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs(ODD), labels)
    rows = toxicity.grade_documents(docs(ODD), model).collect()
    assert len(rows) == len(ODD) and not any(r["toxic"] for r in rows)
    assert toxicity.grade_documents(docs([]), model).count() == 0


# -- SentencePiece


@pytest.fixture(scope="module")
def coder(tokenizers):
    return pieces.Coder(pieces.compile_model(f"{tokenizers}/piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library(tokenizers):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=f"{tokenizers}/piece_bpe_32k.model")


def test_paths_equal_the_library_on_any_text(coder, library):
    @settings(max_examples=500, deadline=None)
    @given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(["▁", " ", "   ", "\n", "the", "ing", "é", "日", "1999", "....", "<s>", "<0x0A>", "Ａ", "aaaa"]), max_size=16).map("".join)))
    def check(text):
        text = text.encode("utf-8", "ignore").decode().replace("\0", "")
        ids = coder.encode(text)
        assert ids.tolist() == library.encode(text)
        assert "▁" in text or coder.decode(ids) == text

    check()


def test_documents_equal_the_library(spark, library):
    texts = texts_of(spark)
    for r in QUERIES["op8_pieces"](spark, SF).collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]] or "") and r["round_trip"] and r["n_tokens"] == len(r["ids"])


def test_pieces_of_odd_rows(docs, tokenizers):
    path = f"{tokenizers}/piece_bpe_32k.model"
    rows = pieces.encode(docs([*ODD, (9, "a▁b")]), path)
    got = {r["doc_id"]: r for r in rows.collect()}
    assert got[1]["ids"] == got[2]["ids"] == [] and not got[9]["round_trip"] and got[3]["round_trip"]
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, path).collect()}
    assert back[3] == LONG and back[2] == "" and back[7] == "\n\n  "
    assert pieces.encode(docs([]), path).count() == 0


# -- shards


def brute_capacity(sizes, shards_):
    def needed(capacity):
        count, held = 1, 0
        for s in sizes:
            if s > capacity:
                return 10**9
            if held + s > capacity:
                count, held = count + 1, 0
            held += s
        return count

    low, high = max(sizes), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if needed(mid) <= shards_ else (mid + 1, high)
    return low


@pytest.mark.parametrize("cells", [8, 1 << 15])
def test_shards_have_the_smallest_capacity(spark, docs, monkeypatch, cells):
    monkeypatch.setattr(shards, "CELLS", cells)
    pick = random.Random(cells)
    rows = [(k, "t" * pick.randrange(1, 300) + str(k)) for k in range(900)]
    made = docs(rows)
    got = shards.assign(made, shards=7).collect()
    atoms = made.select(F.xxhash64("text").alias("h"), (F.octet_length("text") + 16).alias("size")).groupBy("h").agg(F.sum("size").alias("size")).orderBy("h").collect()
    load = defaultdict(int)
    for r in got:
        load[r["shard"]] += r["size"]
    assert max(load.values()) == brute_capacity([a["size"] for a in atoms], 7) and set(load) == set(range(7))


def test_shards_keep_groups_and_number_rows(docs):
    rows = [*[(k, "same text of a large group" * 20) for k in range(500)], *[(k, f"other {k}" * 9) for k in range(500, 1500)], *ODD]
    got = shards.assign(docs(rows), shards=10).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got if r["size"] == 16 + 26 * 20}) == 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    null = next(r for r in got if r["doc_id"] == 1 and r["size"] == 16)
    assert null["text_crc32"] == 0 and shards.assign(docs([])).count() == 0
    crc = {r["doc_id"]: r["text_crc32"] for r in got}
    assert crc[700] == zlib.crc32(("other 700" * 9).encode())


# -- SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), SQL[name]) in ("", "EMPTY")
