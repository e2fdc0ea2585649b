"""How often an operator reads its table, and that what it leaves out changes nothing."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators import basket as B, clean as CL, customers as CU, formats as FM, profile as PR, quantiles as Q
from tallyloom.plans import all_queries
from tallyloom.sources import append as AP


@pytest.fixture
def counted(spark):
    """A frame that counts the rows read from it, and the counter."""

    def make(rows, schema):
        read = spark.sparkContext.accumulator(0)

        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, schema).repartition(3).mapInArrow(run, schema), read

    return make


def test_quantiles_read_the_table_twice(counted, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 20)
    rng = np.random.default_rng(3)
    for values in (rng.lognormal(0, 3, 20_000), np.repeat([1.0, 2.0, 3.0], [9000, 10_000, 1000]), np.round(rng.normal(0, 5, 20_000))):
        df, read = counted([("a", float(v)) for v in values] + [("b", 1.0), ("b", None)], "k string, x double")
        got = {r["k"]: r for r in Q.exact_quantiles(df, ["k"], "x", [0.25, 0.75, 1.0], few_keys=True).collect()}
        assert read.value <= 2 * (len(values) + 2)
        assert np.allclose([got["a"][f"q{i}"] for i in range(3)], np.quantile(values, [0.25, 0.75, 1.0]), rtol=1e-12)
        assert got["a"]["total"] == len(values) and got["b"]["q1"] == 1.0


def test_quantiles_are_right_where_the_sketch_is_not(spark, monkeypatch):
    monkeypatch.setattr(Q, "FEW", 20)
    monkeypatch.setattr(Q, "_around", lambda *a: None)
    df = spark.range(5000).select((F.col("id") * 7 % 5000).cast("double").alias("x"))
    assert Q.exact_quantiles(df, [], "x", [0.5, 0.9]).select("q0", "q1").first()[0:2] == (2499.5, 4499.1)


def test_types_group_only_what_the_counts_leave_open(spark, monkeypatch):
    rows = [(str(i), f"2024-01-{i % 28 + 1:02d}", "ab"[i % 2], f"w{chr(97 + i % 26)}{chr(97 + i // 26)}", None) for i in range(60)]
    df = spark.createDataFrame(rows, "number string, day string, kind string, words string, nothing string")
    grouped, real = [], PR.value_counts
    monkeypatch.setattr(PR, "value_counts", lambda df, columns: grouped.extend(columns) or real(df, columns))
    got = {r["column"]: r["type"] for r in PR.column_types(df, df.columns).collect()}
    assert got == {"number": "number", "day": "date", "kind": "category", "words": "text", "nothing": "empty"}
    assert sorted(grouped) == ["kind", "words"]
    assert {r["type"] for r in PR.column_types(df, ["number", "nothing"]).collect()} == {"number", "empty"}


def test_notes_read_the_table_for_the_decisions_and_once_a_way(counted):
    df, read = counted([(f"{i},5", f"{i % 28 + 1:02d}/01/2024", "x") for i in range(50)], "amount string, day string, word string")
    notes = {r["column"]: (r["decision"], r["rewritten"]) for r in FM.format_notes(df, df.columns).collect()}
    assert notes == {"amount": ("1.234,56", 50), "day": ("dmy", 50)}
    assert read.value <= 3 * 50
    plain, _ = counted([("word",)], "word string")
    assert FM.format_notes(plain, ["word"]).count() == 0


def test_a_table_taken_in_is_not_read_again_to_be_written(spark, counted, tmp_path):
    df, read = counted([(f" {i}", None if i % 3 else "y") for i in range(30)], "amount string, flag string")
    taken = AP.ingest(df, [CL.Step("whitespace", "amount"), CL.Step("missing_values", "flag", "Unknown")])
    before = read.value
    for _ in range(2):
        taken.write(str(tmp_path), "first")
    assert read.value == before
    assert AP.read_ingested(spark, str(tmp_path))["applied"].count() == 2


def test_customers_are_grouped_once(counted):
    day = datetime.date(2024, 1, 1)
    rows = [(i % 7, day + datetime.timedelta(days=i), f"o{i}", 2.0) for i in range(70)] + [(None, day + datetime.timedelta(days=99), "o", 1.0)]
    df, read = counted(rows, "customer long, date date, order string, revenue double")
    got = {r["customer"]: r[1:] for r in CU.rfm(df, "customer", "date", "order", "revenue").collect()}
    assert got == {k: (6 - k, 10, 20.0) for k in range(7)}
    assert read.value == len(rows)


def test_baskets_are_read_once(counted):
    df, read = counted([(f"o{i}", p) for i in range(40) for p in ("ab", "ac", "bc", "abc")[i % 4]], "order string, product string")
    rules = B.association_rules(B.frequent_itemsets(df, 0.05), 0.0).collect()
    n = sum(len(("ab", "ac", "bc", "abc")[i % 4]) for i in range(40))
    assert read.value == n and all(r["orders"] in (10, 20) for r in rules)


def test_customers_of_a_group_count_once_and_nulls_form_a_group(spark, tmp_path):
    def table(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    table("part", [(1, "t", "b"), (2, "t", "b"), (3, None, "b"), (4, None, None), (1, "u", "b")], "p_partkey long, p_type string, p_brand string")
    table("customer", [(1, "s"), (2, None), (3, "s"), (3, "s")], "c_custkey long, c_mktsegment string")
    table("orders", [(1, 1, "2020-01-01"), (2, 1, "2022-01-01"), (3, 2, "2020-01-01"), (4, 9, "2020-05-01"), (5, None, "2021-01-01"), (6, 3, None)],
          "o_orderkey long, o_custkey long, o_orderdate string")
    lines = [(1, 1), (2, 2), (3, 3), (3, 4), (4, 4), (4, 8), (5, 8), (6, 2), (7, 1)]
    table("lineitem", lines, "l_orderkey long, l_partkey long")
    got = {tuple(r[c] for c in ("department", "category", "brand")): (r["customers"], r["span_days"]) for r in all_queries()["o15_refusal_status"](spark, str(tmp_path)).collect()}
    assert got == {("s", "t", "b"): (2, 731), ("s", "u", "b"): (1, 0), (None, None, "b"): (1, 0), (None, None, None): (2, 366), (None, "t", "b"): (0, None), (None, "u", "b"): (0, None)}


def test_o15_sorts_no_names(spark):
    plan = all_queries()["o15_refusal_status"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan
