"""Quantiles by rank, places over ranges, pages and bake-off states, on values of any distribution."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import quantiles as Q, ranges, reshape
from tallyloom.sources.readers import page

PROBS = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def columns():
    pick = np.random.default_rng(1)
    return {
        "log_uniform": 10 ** pick.uniform(-3, 9, 20_000), "constant": np.full(5_000, 3.0), "one_outlier": np.r_[pick.uniform(0, 1, 9_999), 1e12],
        "few_values": pick.integers(0, 5, 10_000) * 1.0, "mostly_one": np.r_[np.full(9_000, 3.0), pick.uniform(3.0, 3.01, 500)], "short": pick.uniform(0, 1, 7), "single": np.array([4.0])}


@pytest.fixture(scope="module")
def values(spark):
    frame = pd.concat([pd.DataFrame({"k": k, "x": v}) for k, v in columns().items()]).sample(frac=1, random_state=2)
    return spark.createDataFrame(frame).repartition(8).cache()


def test_quantiles_are_exact_whatever_the_distribution(spark, values, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 300)
    spans = []
    monkeypatch.setattr(Q, "materialise", lambda df, name, keep=Q.materialise: spans.append(keep(df, name)) or spans[-1])
    got = {r["k"]: r for r in Q.exact_quantiles(values, ["k"], "x", PROBS).collect()}
    for k, x in columns().items():
        assert got[k]["total"] == len(x)
        assert np.allclose([got[k][f"q{i}"] for i in range(len(PROBS))], np.quantile(x, PROBS), rtol=1e-12)
    # what was put in order at last: a few values for each rank, or a single value however often it occurs
    left = spans[-1].where("_lo < _hi").agg(F.max("_held")).first()[0]
    assert left is None or left <= 300
    whole = np.concatenate(list(columns().values()))
    assert np.allclose(Q.exact_quantiles(values, [], "x", [0.3, 0.5]).select("q0", "q1").first(), np.quantile(whole, [0.3, 0.5]), rtol=1e-12)
    assert Q.exact_quantiles(values.where("false"), [], "x", [0.5]).count() == 0


def test_weights_count_as_rows(spark):
    rows = spark.createDataFrame([(1.0, 5), (2.0, 1), (9.0, 4), (None, 3)], "x double, n long")
    assert Q.exact_quantiles(rows, [], "x", [0.5, 0.25], weight="n").first()[0:3] == (10, 1.5, 1.0)


def test_approximate_quantiles_are_near_in_rank(values):
    for r in Q.approx_quantiles(values, ["k"], "x", [0.5]).collect():
        x = np.sort(columns()[r["k"]])
        assert np.searchsorted(x, r["q0"], "left") / len(x) <= 0.51 and np.searchsorted(x, r["q0"], "right") / len(x) >= 0.49


def test_places_and_running_sums_over_ranges(spark):
    pick = np.random.default_rng(3)
    frame = pd.DataFrame({"g": pick.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1]), "id": np.arange(3000), "v": pick.integers(-50, 50, 3000)})
    rows = spark.createDataFrame(frame, "g string, id long, v long").repartition(7)
    placed = ranges.running(rows, ["g"], ["-v", "id"], {"s": F.col("v")})
    got = placed.toPandas()
    assert len(got) == 3000
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values(["v", "id"], ascending=[False, True])
        assert part["place"].tolist() == list(range(len(part))) and part["s"].tolist() == part["v"].cumsum().tolist()
    every = ranges.running(rows, [], ["id"]).toPandas()
    assert (every["place"] == every["id"]).all()
    assert ranges.running(rows.limit(0), ["g"], ["id"]).count() == 0
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("skewed", [False, True])
def test_pages_are_those_of_the_sorted_table(spark, monkeypatch, skewed):
    monkeypatch.setattr(ranges, "FEW", 50)
    monkeypatch.setattr(ranges, "SAMPLE", 40)
    pick = np.random.default_rng(4)
    name = np.where(pick.random(4000) < 0.4, "same", pick.integers(0, 900, 4000).astype(str)) if skewed else pick.integers(0, 900, 4000).astype(str)
    frame = pd.DataFrame({"name": name, "id": pick.permutation(4000)})
    frame.loc[frame["id"] % 50 == 0, "name"] = None
    rows = spark.createDataFrame(frame, "name string, id long").repartition(6)
    order = sorted((tuple(r) for r in rows.collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    for number in (0, 1, 77, 133, 159, 160, 400):
        got = page(rows, ["name", "id"], number, 25).collect()
        assert [(r["name"], r["id"]) for r in got] == order[25 * number : 25 * number + 25]
        assert all(r["total"] == 4000 and r["has_more"] == (25 * number + 25 < 4000) for r in got)
    same = page(spark.range(500).select(F.lit(1).alias("k")), ["k"], 3, 20)
    assert same.count() == 20
    assert page(rows.limit(0), ["name"], 0).count() == 0


def test_breaks_are_values_at_their_ranks(spark):
    rows = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, 9, 8, 7, 6, 10]], "value double")
    assert reshape.quantile_breaks(rows).first()[0] == [3.0, 5.0, 7.0, 9.0]
    assert reshape.quantile_breaks(spark.createDataFrame([(2.0,), (2.0,)], "value double")).first()[0] == []


def test_a_table_is_taken_in_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    from tallyloom.sources import append as AP

    folder = str(tmp_path / "taken")
    first = AP.ingest(spark.createDataFrame([("1", "x"), ("2", "y")], "n string, t string"))
    with pytest.raises(FileNotFoundError):
        AP.read_ingested(spark, folder)
    first.write(folder, "a")
    second = AP.ingest(spark.createDataFrame([("3", "z")], "n string, t string"))
    second.score = spark.range(1).select(F.raise_error(F.lit("lost half way")).alias("score"))
    with pytest.raises(Exception, match="lost half way"):
        second.write(folder, "b")
    assert sorted(r["n"] for r in AP.read_ingested(spark, folder)["rows"].collect()) == ["1", "2"]
    second.score = first.score
    second.write(folder, "b")
    second.write(folder, "b")
    assert [r["n"] for r in AP.read_ingested(spark, folder)["rows"].collect()] == ["3"]
    assert sorted(map(tuple, AP.published(spark, folder).collect())) == [("a", 0), ("b", 1)]


def test_files_with_the_columns_in_another_order_arrive_and_others_are_refused(spark, tmp_path):
    from tallyloom.streaming import jobs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "in" / "two.csv").write_text("b,a\nz,3\n")
    run = lambda: jobs.ingest_files(spark, str(tmp_path / "in"), "a string, b string", [], str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    run()
    assert sorted(map(tuple, jobs.read_batches(spark, str(tmp_path / "out")).collect())) == [("1", "x"), ("2", "y"), ("3", "z")]
    (tmp_path / "in" / "three.csv").write_text("a,c\n1,x\n")
    with pytest.raises(Exception, match="missing \\['b'\\], extra \\['c'\\]"):
        run()


def test_days_are_final_once_the_watermark_has_passed(spark, tmp_path):
    from tallyloom.streaming import jobs

    events = "ts timestamp, kind string, value double"
    day = lambda d, v: (datetime.datetime(2024, 1, d, 10), "k", v)
    rules = spark.createDataFrame([(1, "k", "LT", 50.0), (2, "k", "GT", 8.0)], "rule_id int, metric string, comparator string, threshold double")
    none = spark.createDataFrame([], "rule_id int")
    job = None
    for part, rows in enumerate([[day(1, 5.0), day(2, 7.0)], [day(2, 2.0), day(4, 1.0)], [day(9, 3.0)]]):
        spark.createDataFrame(rows, events).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = lambda: spark.readStream.schema(events).parquet(str(tmp_path / "in"))
        totals = jobs.daily_totals(stream(), "ts", ["kind"], "value")
        jobs.write_daily_totals(totals, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
        metrics = jobs.daily_totals(stream(), "ts", ["kind"], "value").select(F.col("kind").alias("metric"), "day", "value", "latest")
        job = jobs.threshold_alerts(metrics, rules, none, str(tmp_path / "alerts"), str(tmp_path / "c2"))
        job.awaitTermination()
        found = {r["day"].day: (r["value"], r["final"]) for r in jobs.read_daily_totals(spark, str(tmp_path / "out"), ["kind"]).collect()}
        assert found == [{1: (5.0, False), 2: (7.0, False)}, {1: (5.0, True), 2: (9.0, True), 4: (1.0, False)}, {1: (5.0, True), 2: (9.0, True), 4: (1.0, True), 9: (3.0, False)}][part]
        alerts = {r["rule_id"]: (r["day"].day, r["value"]) for r in jobs.read_batches(spark, str(tmp_path / "alerts" / "alerts")).collect()}
        assert alerts == [{}, {1: (1, 5.0), 2: (2, 9.0)}, {1: (1, 5.0), 2: (2, 9.0)}][part]
    assert all(r["final"] for r in jobs.read_daily_totals(spark, str(tmp_path / "out"), ["kind"], closed=True).collect())
    jobs.close_alerts(spark, rules, str(tmp_path / "alerts"), job)
    assert jobs.read_batches(spark, str(tmp_path / "alerts" / "alerts")).count() == 2


def test_a_scratch_block_leaves_nothing_but_what_is_kept(spark):
    import os

    from tallyloom.session import materialise, scratch, shared_dir

    folder = shared_dir(spark, "").replace("file:", "").rstrip("/")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark) as outer:
        with scratch(spark) as tables:
            first = materialise(spark.range(10), "scratch-first")
            second = tables.keep(materialise(first.where("id > 3"), "scratch-second"))
        assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"scratch-second"}
        assert second.count() == 6
        third = outer.keep(materialise(second.where("id > 7"), "scratch-third"))
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before} == {"scratch-third"} and third.count() == 2
