"""Shapley values, silhouettes, wide correlations, deferred joins, mergeable profiles and exact sums against plain versions."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyloom.functions.numbers import exact_sum
from tallyloom.operators import customers, joins, profile, shapley, stats

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def boosted(spark):
    pick = np.random.default_rng(1)
    x = pick.normal(size=(400, 3)).round(1)
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    rows = spark.createDataFrame(pd.DataFrame(x, columns=NAMES).assign(y=y, id=np.arange(400)))
    model = GBTClassifier(labelCol="y", featuresCol="f", maxIter=4, maxDepth=3, seed=1).fit(VectorAssembler(inputCols=NAMES, outputCol="f").transform(rows))
    return rows, model


def expected(node, x, known):
    """A tree's value where only the known features of a row may be looked at."""
    if node.numDescendants() == 0:
        return node.prediction()
    at = node.split().featureIndex()
    if at in known:
        return expected(node.leftChild() if x[at] <= node.split().threshold() else node.rightChild(), x, known)
    return sum(child.impurityStats().count() * expected(child, x, known) for child in (node.leftChild(), node.rightChild())) / node.impurityStats().count()


def test_shapley_values_equal_those_over_all_subsets(boosted):
    rows, model = boosted
    every = shapley.leaves(model)
    got = {r["id"]: r["shapley"] for r in shapley.explain(rows.select("id", *NAMES), NAMES, model).collect()}
    roots = [(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights)]
    for row in rows.limit(12).collect():
        x = [row[c] for c in NAMES]
        value = {known: sum(w * expected(root, x, known) for root, w in roots) for size in range(4) for known in combinations(range(3), size)}
        for i in range(3):
            want = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (value[tuple(sorted({*s, i}))] - value[s]) for s in value if i not in s)
            assert np.isclose(got[row["id"]][i], want)
        assert np.isclose(sum(got[row["id"]]), value[(0, 1, 2)] - shapley.base_value(every))


def test_silhouettes_equal_brute_force(spark):
    pick = np.random.default_rng(2)
    points = np.concatenate([pick.normal(m, 0.6, (40, 3)) for m in (0, 2, 5)])
    labels = {"two": (np.arange(120) >= 80).astype(int), "three": np.arange(120) // 40, "alone": np.r_[[7], np.arange(119) // 60]}
    rows = spark.createDataFrame([(i, [float(v) for v in p], *(int(labels[k][i]) for k in labels)) for i, p in enumerate(points)], "member long, point array<double>, two int, three int, alone int")
    got = customers.silhouettes(rows, list(labels), "point")
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    for name, of in labels.items():
        scores = []
        for i in range(120):
            own = (of == of[i]) & (np.arange(120) != i)
            if not own.any():
                scores.append(0.0)
                continue
            a, b = far[i, own].mean(), min(far[i, of == k].mean() for k in set(of) - {of[i]})
            scores.append((b - a) / max(a, b))
        assert np.isclose(got[name], np.mean(scores))


def test_three_hundred_columns_correlate(spark):
    pick = np.random.default_rng(3)
    base = pick.normal(size=(200, 10))
    x = base[:, np.arange(300) % 10] + 0.3 * pick.normal(size=(200, 300)) + 1e6
    x[:, 7] = 5.0
    x[pick.random((200, 300)) < 0.1] = np.nan
    names = [f"c{i}" for i in range(300)]
    rows = spark.createDataFrame(pd.DataFrame(x, columns=names)).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names]).repartition(5)
    got = {(r["a"], r["b"]): (r["coefficient"], r["sample_size"]) for r in stats.correlate_columns(rows, names).collect()}
    assert len(got) == 299 * 298 // 2 and not any("c7" in pair for pair in got)
    for i, j in [(0, 1), (0, 10), (5, 299), (63, 64), (200, 290)]:
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        r, n = got[names[i], names[j]]
        assert n == both.sum() and abs(r - np.corrcoef(x[both, i], x[both, j])[0, 1]) < 0.00051


def jobs_of(spark, name, build):
    spark.sparkContext.setJobGroup(name, name)
    out = build()
    found = spark.sparkContext.statusTracker().getJobIdsForGroup(name)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(found)


def test_deferred_joins_start_no_job_and_refuse_repeated_keys(spark):
    left = spark.createDataFrame([(i, f" K{i % 4} " if i % 3 else None) for i in range(30)], "id long, k string")
    right = spark.createDataFrame([("k1", "x", 1), ("k2", "y", 2), (None, "z", 3)], "k string, name string, id int")
    twice = right.unionByName(right.limit(1))
    (joined, hops), jobs = jobs_of(spark, "deferred", lambda: joins.deferred_chain(left, {"r": right, "t": twice}, [
        joins.Relation("k", "r", "k"), joins.Relation("k", "t", "k"), joins.Relation("absent", "r", "k")]))
    assert jobs == 0
    assert [(r["right_name"], r["applied"]) for r in hops.orderBy("position").collect()] == [("r", True), ("t", False), ("r", False)]
    names = {"k1": ("x", 1), "k2": ("y", 2)}
    for r in joined.collect():
        key = r["k"].strip().lower() if r["k"] else None
        assert (r["name"], r["r.id"]) == names.get(key, ("", None)) and r["t.name"] is None and r["t.id"] is None
    assert joined.count() == 30
    plain, made = joins.guarded_join(left, right, joins.Relation("k", "r", "k"))
    assert made and sorted(map(tuple, plain.collect()), key=str) == sorted((tuple(r)[:4] for r in joined.collect()), key=str)


def test_states_of_parts_merge_to_that_of_the_whole(spark):
    pick = np.random.default_rng(4)
    cells = np.array(["12", " 3.5", "$4", "x1 kg", "", None, "yes", "2024-01-05", "007", "1e3", "-4", "Abc"], dtype=object)
    rows = spark.createDataFrame(pd.DataFrame({"p": pick.choice(cells, 900), "q": pick.integers(0, 10**6, 900).astype(str)}), "p string, q string").repartition(4)
    part = F.pmod(F.xxhash64("q"), F.lit(3))
    whole = profile.column_states(rows, ["p", "q"], sketches=True)
    parts = [profile.column_states(rows.where(part == k), ["p", "q"], sketches=True) for k in range(3)]
    merged = profile.merge_states(profile.merge_states(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    exact = [c for c in whole.columns if c not in ("values_seen", "numbers_seen")]
    assert sorted(map(tuple, whole.select(exact).collect())) == sorted(map(tuple, merged.select(exact).collect()))
    for r in profile.estimates(merged).collect():
        texts = [t[r["column"]] for t in rows.collect()]
        seen = len({t.strip() for t in texts if t and t.strip()})
        assert abs(r["about_distinct"] - seen) <= 0.1 * seen + 1
    numbers = sorted(int(t["q"]) for t in rows.collect())
    for rank, value in zip((225, 450, 675), profile.estimates(merged).where("column = 'q'").first()["about_quartiles"]):
        assert numbers[rank - 20] <= value <= numbers[rank + 20]


def test_shape_checks_neither_write_nor_group_values(spark):
    from tallyloom.operators.shape import column_evidence

    rows = spark.createDataFrame([("2024-01-05", "1999")], "d string, y string")
    evidence, jobs = jobs_of(spark, "evidence", lambda: column_evidence(rows, ["d", "y"]).select("column", "plausible_dates", "years"))
    assert jobs == 0 and evidence._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_sums_are_exact_in_any_order_and_range(spark):
    values = [0.1] * 10 + [-0.3, 1e15, -1e15, 12345.678901, -0.000001, 2.0**53, None, float("nan"), float("inf"), 9e12 + 0.25]
    want = 1.0 - 0.3 + 12345.678901 - 0.000001 + 2.0**53 + 9e12 + 0.25
    for parts in (1, 5):
        got = spark.createDataFrame([(v,) for v in values], "v double").repartition(parts).agg(exact_sum("v")).first()[0]
        assert got == want
    rows = spark.range(200_000).selectExpr("(id % 1000) * 0.01 - 3.07 as v")
    assert len({rows.repartition(p).agg(exact_sum("v")).first()[0] for p in (1, 7, 13)}) == 1
    assert rows.agg(exact_sum("v")).first()[0] == 200 * sum(round(k - 307) for k in range(1000)) / 100
    assert spark.createDataFrame([(None,), (float("nan"),)], "v double").agg(exact_sum("v")).first()[0] is None
