"""Properties that must hold on any table, on small frames of our own."""

import datetime
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.context import Calendar, Filters
from tallyloom.functions import calendar as C, dates as D, numbers as N, strings as S
from tallyloom.operators import (basket as B, clean as CL, compare as P, customers as CU, drivers as DR, evidence as EV, filters as FL,
                                 forecast as FC, formats as FM, joins as J, metrics as MT, profile as PR, quantiles as Q, scenario as SC,
                                 stats as ST)
from tallyloom.sources import append as AP, readers as RD, sinks as SK
from tests import forecast_check

SCHEMA = {"date": "date", "region": "region", "product_name": "product", "revenue": "revenue", "order_id": "order", "customer_id": "customer"}
CALENDARS = [Calendar(), Calendar(4), Calendar(2, "445", 0), Calendar(1, "454", 1), Calendar(7, "544", 6)]


@pytest.fixture(scope="module")
def sales(spark):
    rng = random.Random(7)
    rows = []
    for i in range(600):
        day = datetime.date(2023, 1, 1) + datetime.timedelta(days=rng.randrange(700))
        # One region holds a third of all rows.
        region = "North" if i % 3 == 0 else rng.choice(["South", "East ", " west", None])
        rows.append((day, region, rng.choice("ABCDE"), round(rng.uniform(1, 100), 2), f"o{i // 2}", f"c{rng.randrange(40)}"))
    return spark.createDataFrame(rows, "date date, region string, product string, revenue double, order string, customer string").persist()


def one(df):
    return df.first().asDict()


@pytest.mark.parametrize("text,expected", [
    ("1,234.56", 1234.56), ("(5,000)", -5000.0), ("5,000-", -5000.0), ("-(500)", 500.0), ("$(1,200)", -1200.0), ("1 234", 1234.0),
    ("€ 12.5", 12.5), ("5%", 5.0), ("--5", 5.0), ("+7", 7.0), ("(5", None), ("1.2.3", None), ("1.234,56", None), ("n/a", None), ("", None),
    (".", None), (".5", 0.5), ("2024-01-05", None), (" 1 234 ", 1234.0),
])
def test_parse_number(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(N.parse_number(F.col("t")).alias("n")).first()["n"]
    assert got == expected


@pytest.mark.parametrize("value,expected", [(2.00496, 2.0), (7.00499, 7.0), (1.005, 1.0), (2.675, 2.68), (-1.125, -1.12), (-2.5, -2.5), (0.125, 0.13), (None, None)])
def test_two_decimals_halves_up(spark, value, expected):
    assert spark.createDataFrame([(value,)], "x double").select(N.round2(F.col("x")).alias("r")).first()["r"] == expected


def test_exact_sums_do_not_depend_on_order(spark):
    values = [(0.1 * k + 1e6 * (k % 7),) for k in range(2000)]
    sums = {one(spark.createDataFrame(values[::step], "x double").repartition(parts).agg(N.exact_sum("x").alias("t")))["t"]
            for step in (1, -1) for parts in (1, 13)}
    assert len(sums) == 1


@pytest.mark.parametrize("text,order,expected", [
    ("31/04/2026", "dmy", None), ("01/02/2026", "dmy", "2026-02-01"), ("01/02/2026", "mdy", "2026-01-02"), ("5-3-69", "dmy", "2069-03-05"),
    ("5-3-70", "dmy", "1970-03-05"), ("2026/1/9", "mdy", "2026-01-09"), ("2026-01-01T00:30:00+05:30", "mdy", "2026-01-01"), ("x", "mdy", None),
])
def test_to_iso_date(spark, text, order, expected):
    got = spark.createDataFrame([(text,)], "t string").select(D.to_iso_date(F.col("t"), order, "Asia/Kolkata").alias("d")).first()["d"]
    assert got == expected


def test_four_ways_to_write_one_business_total_the_same(spark):
    styles = {
        "plain": [("2026-01-13", "1000"), ("2026-02-20", "1000.5"), ("2026-03-01", "499.5")],
        "grouped": [("2026-01-13", "1,000"), ("2026-02-20", "$1,000.50"), ("2026-03-01", "499.50")],
        "german": [("13.01.2026", "1.000,00"), ("20.02.2026", "1.000,50"), ("01.03.2026", "499,50")],
        "spaced": [("13/01/2026", "1 000"), ("20/02/2026", "1 000"), ("01/03/2026", "500")],
    }
    for rows in styles.values():
        df = spark.createDataFrame(rows, "date string, amount string")
        read = FM.normalise_columns(df, ["date", "amount"], FM.detect_formats(df, ["date", "amount"]))
        got = read.agg(F.sum(N.number_or_zero(F.col("amount"))).alias("t"), F.min("date").alias("a"), F.max("date").alias("z")).first()
        assert (got["t"], got["a"], got["z"]) == (2500.0, "2026-01-13", "2026-03-01")


@pytest.mark.parametrize("cal", CALENDARS, ids=lambda c: f"{c.scheme}-{c.fiscal_year_start_month}")
def test_period_ranges_hold_exactly_their_days_and_tile(spark, cal):
    days = spark.sql("select explode(sequence(date'2019-01-01', date'2031-12-31')) as day")
    for grain in C.GRAINS:
        keyed = days.select("day", C.grain_key(F.col("day"), cal, grain).alias("key"))
        spans = C.with_period_range(keyed.groupBy("key").agg(F.min("day").alias("a"), F.max("day").alias("z")), "key", cal)
        rows = sorted(spans.collect(), key=lambda r: r["a"])
        for r in rows[1:-1]:  # the outermost buckets are cut off by the span
            assert (r["a"], r["z"]) == (r["period_from"], r["period_to"])
        for left, right in zip(rows, rows[1:]):
            assert right["period_from"] == left["period_to"] + datetime.timedelta(days=1)
            assert left["key"] < right["key"]
    keys = [r["key"] for r in sorted(days.select(C.period_key(F.col("day"), cal).alias("key")).distinct().collect())]
    following = {r["key"]: r["n"] for r in spark.createDataFrame([(k,) for k in keys], "key string").select(
        "key", C.next_period(F.col("key")).alias("n")).collect()}
    assert [following[k] for k in keys[:-1]] == keys[1:]


def test_rebucketing_keeps_the_total(sales):
    whole = one(sales.agg(N.round2(F.sum("revenue")).alias("t")))["t"]
    for cal, grain in itertools.product(CALENDARS, C.GRAINS):
        series = MT.time_series(sales, SCHEMA, "revenue", cal=cal, grain=grain)
        assert abs(one(series.agg(F.sum("value").alias("t")))["t"] - whole) < 0.05


def test_a_drill_is_a_filter_and_stepping_up_restores(sales):
    geography = FL.Hierarchy("g", ("region", "product"))
    down = geography.drill_to(Filters(), "region", "north")
    assert geography.next_level(down) == "product" and geography.drill_up(down, None) == Filters()
    drilled = MT.group_totals(sales, SCHEMA, "product_name", "revenue", down).collect()
    by_hand = MT.group_totals(sales.where("lower(trim(region)) = 'north'"), SCHEMA, "product_name").collect()
    assert sorted(drilled) == sorted(by_hand)
    assert FL.apply_filters(sales, SCHEMA, Filters(slots={"city": "x"})).count() == 0


def test_filter_exclusions_partition_the_rows(sales):
    filters = Filters("2023-03-01", "2024-06-30", {"region": ["north", "west"], "product": "A"})
    dropped = one(FL.cascade_exclusions(sales, SCHEMA, filters).agg(F.sum("excluded").alias("n")))["n"]
    assert dropped + FL.apply_filters(sales, SCHEMA, filters).count() == sales.count()


def test_kpis_match_plain_counts_and_evidence_matches_kpis(sales):
    kpis = {r["kpi"]: r["value"] for r in MT.kpi_table(sales, SCHEMA).collect()}
    plain = one(sales.agg(F.sum("revenue").alias("r"), F.count_distinct("order").alias("o"), F.count_distinct("customer").alias("c")))
    assert abs(kpis["revenue"] - plain["r"]) < 0.01 and kpis["orders"] == plain["o"] and kpis["customers"] == plain["c"]
    lines = EV.evidence_rows(EV.kpi_evidence(sales, SCHEMA, "revenue")).collect()
    figure = json.loads(next(r["line"] for r in lines if r["block"] == "figure"))
    assert figure["value"] == kpis["revenue"]


def test_contributions_reconcile_and_the_rest_adds_up(sales):
    bounds = P.period_bounds(sales, SCHEMA)
    members = DR.contributions(sales, SCHEMA, ["region", "product_name"], F.col("revenue"), bounds)
    whole = {r["dimension"]: r["total_delta"] for r in members.collect()}
    assert len(set(whole.values())) == 1
    for n in (1, 2, 50):
        for r in DR.top_contributions(members, n).groupBy("dimension").agg(F.sum("delta").alias("d")).collect():
            assert abs(r["d"] - whole[r["dimension"]]) < 0.05


def test_comparison_windows(spark):
    def bounds(days, filters=Filters(), compare="previous_period", cal=Calendar()):
        df = spark.createDataFrame([(d,) for d in days], "date string")
        return one(P.period_bounds(df, {"date": "date"}, filters, compare, cal))

    august = [f"2026-{m:02d}-{d:02d}" for m in (7, 8) for d in range(1, 32)]
    got = bounds(august, Filters("2026-08-01", "2026-08-31"))
    assert (str(got["previous_from"]), str(got["previous_to"])) == ("2026-07-01", "2026-07-31")
    got = bounds([f"2026-01-{d:02d}" for d in range(1, 8)])  # seven days: the oldest is left out
    assert [str(got[k]) for k in ("previous_from", "previous_to", "current_from", "current_to")] == [
        "2026-01-02", "2026-01-04", "2026-01-05", "2026-01-07"]
    assert bounds(["2026-01-01"] * 3)["reason"] == "insufficient_history"
    assert bounds(["2026-01-01"] * 9)["reason"] == "insufficient_history"
    assert bounds(august, Filters("2026-07-01", "2026-08-31"))["reason"] == "no_prior_data"
    got = bounds(["2023-02-28", "2024-02-29"], Filters("2024-02-29", "2024-02-29"), "previous_year")
    assert got["reason"] is None and str(got["previous_from"]) == "2023-02-28"


def test_a_join_never_moves_a_measure(spark):
    orders = spark.createDataFrame([(1, " C1", 100.0), (2, "c2", 200.0), (3, "", 25.0), (4, "c9", 150.0), (5, "c1", 50.0)], "id int, customer string, revenue double")
    people = spark.createDataFrame([("c1", "Ann", 1.0), ("C2", "Bo", 2.0), ("c3", "Cy", 3.0)], "customer string, name string, revenue double")
    joined, made = J.guarded_join(orders, people, J.Relation("customer", "people", "customer"))
    rows = {r["id"]: r for r in joined.collect()}
    assert made and len(rows) == 5 and sum(r["revenue"] for r in rows.values()) == 525
    assert rows[1]["name"] == "Ann" and rows[3]["name"] == "" and rows[4]["name"] == "" and rows[2]["people.revenue"] == 2.0
    twice = people.unionByName(people)
    same, made = J.guarded_join(orders, twice, J.Relation("customer", "people", "customer"))
    assert not made and same.columns == orders.columns
    report = one(J.join_report(J.key_counts(orders, twice, "customer", "customer")))
    assert report["kind"] == "many_to_many" and not report["safe"] and report["blank_left"] == 1 and report["fan_out"] == 1.6
    assert J.creates_cycle([("a", "b")], "b", "a") and not J.creates_cycle([("a", "b")], "b", "c")


def test_recipes_are_idempotent_and_leave_the_input_alone(spark):
    rows = [("1", " West ", "1,200 kg"), ("2", "west", ""), ("2", "west", ""), ("3", "EAST", None)]
    df = spark.createDataFrame(rows, "id string, region string, amount string")
    steps = CL.build_recipe(
        ["whitespace", "inconsistent_case", "numeric_with_text", "missing_values", "duplicate_rows"],
        [{"type": "inconsistent_case", "column": "region"}, {"type": "numeric_with_text", "column": "amount"}],
        [("id", "number"), ("region", "category"), ("amount", "number")])
    cleaned = CL.apply_recipe(df, steps)
    again = CL.apply_recipe(cleaned, steps)
    expected = [("1", "West", "1200"), ("2", "West", "0"), ("3", "East", "0")]
    assert sorted(map(tuple, cleaned.collect())) == expected == sorted(map(tuple, again.collect()))
    assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str)
    log = {(r["type"], r["column"]): r["affected_rows"] for r in CL.applied_log(df, steps).collect()}
    assert log[("whitespace", "region")] == 1 and log[("missing_values", "amount")] == 3 and log[("duplicate_rows", None)] == 1
    assert ("missing_values", "region") not in log
    assert CL.validate([CL.Step("whitespace"), CL.Step("missing_values", "a")])


def test_title_case(spark):
    got = spark.createDataFrame([("mcdonald  o'NEIL mcleod",)], "t string").select(S.title_case(F.col("t")).alias("t")).first()["t"]
    assert got == "McDonald  O'neil McLeod"


@pytest.mark.parametrize("values", [
    [1, 2, 3, 4], [5.0] * 100 + [1, 9], list(range(1000)), [10.0**k for k in range(12)], [3], [-1e9, 0.1, 0.2, 0.3, 1e9] * 7])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = one(Q.exact_quantiles(df, [], "x", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]))
    assert np.allclose([got[f"q{i}"] for i in range(6)], np.percentile(values, [0, 25, 50, 75, 90, 100]))


def test_a_flat_series_has_no_anomalies_and_flagged_points_lie_outside_their_band(spark):
    flat = [("flat", f"2024-{m:02d}", 5.0) for m in range(1, 13)]
    wild = [("wild", f"2024-{m:02d}", 100.0 + m % 3 + (900 if m == 7 else 0)) for m in range(1, 13)]
    short = [("short", "2024-01", 1.0), ("short", "2024-02", 99.0)]
    points = ST.anomalies(spark.createDataFrame(flat + wild + short, "s string, period string, value double"), ["s"]).collect()
    assert {(p["s"], p["period"]) for p in points if p["is_anomaly"]} == {("wild", "2024-07")}
    assert all(not p["lower"] <= p["value"] <= p["upper"] for p in points if p["is_anomaly"])
    assert "short" not in {p["s"] for p in points}


def _history(spark):
    months = [f"{y}-{m:02d}" for y in range(2019, 2024) for m in range(1, 13)]
    rows = []
    for i, p in enumerate(months):
        rows += [("wave", p, 1000 + 10 * i + 200 * np.sin(i / 12 * 2 * np.pi)), ("line", p, 50.0 + 3 * i),
                 ("spike", p, 500.0 + i % 5 + (5000 if i == 30 else 0)), ("zero", p, 0.0)]
    rows += [("one", "2023-01", 40.0), ("five", "2023-01", 1.0), ("five", "2023-02", 2.0), ("five", "2023-03", 3.0), ("five", "2023-04", 4.0),
             ("five", "2023-05", 5.0)]
    return spark.createDataFrame([(s, p, float(v)) for s, p, v in rows], "s string, period string, value double")


def test_forecasts_pick_one_winner_bracket_the_point_and_repeat(spark):
    result = FC.bake_off(_history(spark), ["s"], 6).persist()
    winners = {r["s"]: r["method"] for r in FC.scoreboard(result, ["s"]).where("winner").collect()}
    assert set(winners) == {"wave", "line", "spike", "zero", "five"}
    assert winners["line"] == "linear_regression" and winners["wave"].startswith(("seasonal", "holt_winters"))
    points = FC.forecast_points(result, ["s"]).collect()
    assert all(p["lower"] <= p["value"] <= p["upper"] and p["worst"] <= p["value"] <= p["best"] for p in points)
    first = {(p["s"], p["step"]): p for p in points}
    assert first[("line", 1)]["period"] == "2024-01" and abs(first[("line", 1)]["value"] - 230.0) < 0.01
    assert first[("one", 1)]["method"] == "flat" and (first[("one", 1)]["lower"], first[("one", 1)]["upper"]) == (32.0, 48.0)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = FC.forecast_points(FC.bake_off(_history(spark), ["s"], 6), ["s"]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(tuple, points)) == sorted(map(tuple, again))


def test_the_bake_off_equals_one_series_at_a_time(spark):
    history = _history(spark)
    result = FC.bake_off(history, ["s"], 8).persist()
    scores = {(r["s"], r["method"]): r for r in FC.scoreboard(result, ["s"]).collect()}
    points = {(r["s"], r["step"]): r for r in FC.forecast_points(result, ["s"]).collect()}
    by_name = {}
    for r in sorted(history.collect()):
        by_name.setdefault(r["s"], []).append((int(r["period"][5:]) - 1, r["value"]))
    for name, rows in by_name.items():
        board, ahead = forecast_check._bake_off(np.array([v for _, v in rows]), np.array([s for s, _ in rows]), 8)
        for want in board:
            got = scores[(name, want["method"])]
            assert (got["eligible"], got["reason"], got["winner"], got["origins"], got["params"]) == tuple(
                want[k] for k in ("eligible", "reason", "winner", "origins", "params")), (name, want)
            for k in ("mase", "mape", "mae"):
                assert (got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 2e-4), (name, want)
        for want in ahead:
            got = points[(name, want["step"])]
            assert (got["method"], got["basis"]) == (want["method"], want["basis"])
            assert all(abs(got[k] - want[k]) < 0.02 for k in ("value", "lower", "upper", "best", "worst")), (name, want)


def test_one_method_alone_projects_what_the_plain_loop_does(spark):
    got = {(r["s"], r["method"], r["step"]): r["value"] for r in FC.method_forecasts(
        _history(spark), ["s"], 3, ["holt", "damped_holt", "holt_winters_additive"]).collect()}
    y = np.array([1.0, 2.0, 3.0, 4.0, 5.0])
    assert ("five", "damped_holt", 1) in got and ("five", "holt_winters_additive", 1) not in got
    for m in ("holt", "damped_holt"):
        _, ahead, _ = forecast_check._fit(m, y, None)
        assert np.allclose([got[("five", m, h)] for h in (1, 2, 3)], ahead(np.array([1, 2, 3]), None), atol=0.006)


def test_levers_compound_and_an_empty_scenario_changes_nothing(sales):
    assert SC.apply_levers(sales, SCHEMA, [SC.Lever("revenue", 0), SC.Lever("cost", 5)]) is sales
    moved = SC.apply_levers(sales, SCHEMA, [SC.Lever("revenue", 10), SC.Lever("revenue", 10)])
    a, b = (one(d.agg(F.sum("revenue").alias("t")))["t"] for d in (sales, moved))
    assert abs(b / a - 1.21) < 1e-6
    effect = SC.lever_effects({"revenue": "r", "cost": "c"}, [SC.Lever("cost", 5), SC.Lever("quantity", 5)])
    assert effect[0]["moves"] == ["profit"] and effect[1]["moves"] == []


def test_metric_specs(sales):
    assert MT.MetricSpec("Bad Key", "", "median").problems() and not MT.MetricSpec("a", "A", "count").problems()
    spec = MT.MetricSpec("r", "R", "ratio", "percent", "revenue", "missing")
    assert one(sales.agg(MT.metric_column(sales, SCHEMA, spec).alias("v")))["v"] == 0.0
    assert MT.MetricSpec("a", "A", "sum", field="revenue", filter=("region", "eq", "West")).describe(SCHEMA) == "SUM(revenue) WHERE region EQ West"
    with pytest.raises(ValueError):
        MT.metric_column(sales, SCHEMA, MT.MetricSpec("a", "A", "sum"))


def test_fingerprint_ignores_order_and_sees_every_change(sales):
    base = one(EV.fingerprint(sales))
    assert one(EV.fingerprint(sales.orderBy("revenue").select(*reversed(sales.columns)))) == base
    assert one(EV.fingerprint(sales.unionByName(sales.limit(1)))) != base
    assert one(EV.fingerprint(sales.withColumn("region", F.coalesce("region", F.lit(""))))) != base


def test_rules_against_all_splits_of_all_sets(spark):
    rng = random.Random(3)
    orders = [set(rng.sample("abcdef", rng.randrange(1, 5))) | ({"a", "b", "c"} if i % 4 == 0 else set()) for i in range(240)]
    rows = spark.createDataFrame([(f"o{i}", p) for i, o in enumerate(orders) for p in o], "o string, p string")
    found = B.association_rules(B.frequent_itemsets(B.basket_rows(rows, "o", "p"), 0.05), limit=None)
    got = {(r["buys"], r["also_buys"]): (r["orders"], r["support"], r["confidence"], r["lift"]) for r in found.collect()}
    support = {}
    for k in range(1, 7):
        for c in itertools.combinations("abcdef", k):
            share = sum(set(c) <= o for o in orders) / len(orders)
            if share >= 0.05:
                support[c] = share
    want = {}
    for c, s in support.items():
        for k in range(1, len(c)):
            for left in itertools.combinations(c, k):
                right = tuple(x for x in c if x not in left)
                confidence, lift = s / support[left], s / support[left] / support[right]
                if confidence >= 0.1 and lift > 1 + 1e-12:
                    want[(", ".join(left), ", ".join(right))] = (round(s * 240), s, confidence, lift)
    assert got.keys() == want.keys() and any("," in right for _, right in got)
    for k, v in want.items():
        assert got[k][0] == v[0] and np.allclose(got[k][1:], v[1:], atol=6e-4)


def test_churn_model_learns_who_stops(spark):
    rng = random.Random(11)
    rows, start = [], datetime.date(2022, 1, 1)
    for c in range(300):
        # Customers who will lapse space their orders out more and more; the others keep their rhythm.
        lapses, day, gap, i = c % 3 == 0, rng.randrange(30), rng.randrange(12, 20), 0
        stop = rng.randrange(250, 850) if lapses else 900
        while day < stop:
            rows.append((f"c{c}", f"c{c}-{i}", start + datetime.timedelta(days=day), 20.0 + rng.random()))
            gap = gap * (1.25 if lapses and day > stop - 200 else 1.0)
            day, i = day + max(1, int(gap + rng.randrange(-2, 3))), i + 1
    df = spark.createDataFrame(rows, "customer string, order_key string, date date, revenue double")
    scored, report = CU.churn_scores(df)
    got = one(report)
    assert got["reason"] is None and got["auc"] >= CU.MIN_AUC
    people = scored.collect()
    assert len(people) == 300 and all(0 <= p["risk"] <= 1 and p["factors"].count(",") == 2 for p in people)
    refused = CU.churn_scores(df.where("customer < 'c11'"))[1]
    assert one(refused)["reason"] is not None


def test_clusters_of_planted_groups(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(1, 9), rng.randrange(30, 40), rng.uniform(900, 1100)) if i % 2 else
            (i, rng.randrange(300, 400), rng.randrange(1, 3), rng.uniform(5, 9)) for i in range(120)]
    table = spark.createDataFrame(rows, "customer int, recency_days int, frequency int, monetary double")
    labelled, scores = CU.cluster(table)
    assert max(scores, key=lambda s: s[1])[0] == 2
    named = {r["name"]: r["size"] for r in CU.describe_clusters(labelled).collect()}
    assert named == {"Champions": 60, "Hibernating": 60}
    assert CU.cluster(table.limit(20))[1] == []


def test_unusable_purchases_take_no_part(spark):
    day = datetime.date(2024, 1, 1)
    rows = [(" b", day, "1", 2.0), ("b", day, "2", 3.0), ("", day, "3", 9.0), (None, day, "4", 9.0), ("c", None, "5", 9.0), ("d", day, "6", None)]
    df = spark.createDataFrame(rows, "customer string, date date, order_key string, revenue double")
    assert [(r["customer"], r["frequency"], r["monetary"]) for r in CU.rfm(df, "customer", "date", "order_key", "revenue").collect()] == [("b", 2, 5.0)]
    scored, report = CU.churn_scores(df.limit(0))
    assert scored.count() == 0 and one(report)["reason"] is not None


def test_limits_are_the_callers_and_carry_the_rest(spark, sales):
    every = MT.composition(sales, SCHEMA, "product_name").collect()
    top = {r["label"]: r["value"] for r in MT.composition(sales, SCHEMA, "product_name", limit=2).collect()}
    assert len(every) == 5 and len(top) == 3 and abs(sum(r["value"] for r in every) - sum(top.values())) < 0.01
    rows = spark.range(6000).select(F.col("id").cast("string").alias("order"), (F.col("id") % 600).cast("string").alias("product"))
    assert B.best_sellers(rows).select("product").distinct().count() == 600
    assert B.frequent_itemsets(rows, 0.001).count() == 600


def test_blank_keys_pass_a_join(spark):
    left = spark.createDataFrame([(i, None if i % 3 == 0 else "k1") for i in range(30)], "id int, k string")
    joined, made = J.guarded_join(left, spark.createDataFrame([("k1", "x"), (None, "y")], "k string, name string"), J.Relation("k", "r", "k"))
    assert made and sorted((r["id"], r["name"]) for r in joined.collect()) == [(i, "" if i % 3 == 0 else "x") for i in range(30)]


def test_append_refuses_and_names_both_sides(spark):
    a = spark.createDataFrame([("1", "x")] * 30, "n string, t string")
    with pytest.raises(ValueError, match="type_mismatch n: number / category"):
        AP.append(a, spark.createDataFrame([("hello", "x")] * 30, "n string, t string"))
    with pytest.raises(ValueError, match="missing_column t"):
        AP.append(a, a.select("n"))
    assert AP.append(a, spark.createDataFrame([("$5", "y"), ("", "z")], "n string, t string")).count() == 32


def test_jdbc_options_quote_names_and_refuse_anything_else():
    got = RD.jdbc_options("mysql", "h", "d", "shop.orders", "u", "p", partition_column="id", lower=0, upper=9, partitions=4)
    assert got["dbtable"] == "`shop`.`orders`" and got["url"] == "jdbc:mysql://h:3306/d" and got["numPartitions"] == "4"
    assert RD.jdbc_options("sqlserver", "h", "d", "t", "u", "p")["dbtable"] == "[t]"
    for bad in ("t; drop table x", 'a"b', "a b", ""):
        with pytest.raises(ValueError):
            RD.jdbc_options("postgres", "h", "d", bad, "u", "p")


def test_report_blocks_and_formula_safe_cells(spark, sales):
    blocks = {"summary": sales, "sections.a": sales, "kpis": sales}
    assert list(SK.select_blocks(blocks, {"summary": False, "sections": False})) == ["kpis"]
    safe = SK.formula_safe(spark.createDataFrame([("=1+1", 5), ("ok", -1)], "t string, n int")).collect()
    assert [tuple(r) for r in safe] == [("'=1+1", 5), ("ok", -1)]


def test_quality_score_and_types(spark):
    rows = [("West", "$5", "yes", "2024-01-01", ""), ("west", "$6", "no", "2024-01-02", "")] * 15
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    types = {r["column"]: r["type"] for r in PR.profile(df, df.columns).collect()}
    assert types == {"a": "category", "b": "currency", "c": "boolean", "d": "date", "e": "empty"}
    issues = PR.quality_issues(df, df.columns)
    found = {(r["type"], r["column"]): r["affected_rows"] for r in issues.collect()}
    assert found == {("inconsistent_case", "a"): 0, ("empty_column", "e"): 30, ("duplicate_rows", None): 28}
    # 1.5 * 0.52 + 4 * 1.0 + 8 * (0.4 + 0.6 * 28 / 30)
    assert one(PR.quality_score(issues))["score"] == round(100 - (1.5 * 0.52 + 4 + 8 * (0.4 + 0.6 * 28 / 30)))
