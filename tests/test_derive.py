"""Binding the columns of unfamiliar tables, and their own figures."""

import datetime

from tallyloom.operators import derive, shape


def day(i):
    return (datetime.date(2026, 1, 1) + datetime.timedelta(days=i)).isoformat()


def bound(spark, rows):
    df = spark.createDataFrame(rows)
    ranked = shape.ranked_columns(df, df.columns)
    figures = {r["label"]: r for r in derive.derived_figures(df, ranked).collect()}
    return derive.derived_schema(df, ranked), figures


def test_an_unfamiliar_table_is_bound_and_named_from_its_own_columns(spark):
    wards = ["Cardiology", "Oncology", "Paediatrics", "Neurology"]
    schema, figures = bound(spark, [{"admission_ref": f"ADM-{1000 + i}", "discharge_date": day(i), "ward": wards[i % 4], "bed_days": 1 + (i * 13) % 28} for i in range(60)])
    assert schema["date"] == "discharge_date" and schema["revenue"] == "bed_days" and schema["category"] == "ward" == schema["product_name"]
    assert schema["order_id"] == "admission_ref" and not schema.keys() & {"cost", "profit"}
    assert set(figures) == {"Bed Days", "Admission Ref", "Records"}
    assert figures["Bed Days"]["value"] == sum(1 + (i * 13) % 28 for i in range(60)) and figures["Admission Ref"]["value"] == figures["Records"]["value"] == 60
    assert all(f["format"] != "money" for f in figures.values())


def test_a_real_cost_beside_real_revenue_gives_profit(spark):
    rows = [{"order_id": 10_000 + i, "order_date": day(i), "product_name": "abcd"[i % 4] * 3, "region": "NSEW"[i % 4] * 2, "revenue": 100 + (i * 37) % 900, "cost": 40 + (i * 17) % 300} for i in range(60)]
    schema, figures = bound(spark, rows)
    assert schema["revenue"] == "revenue" and schema["cost"] == "cost" and schema["order_id"] == "order_id"
    total, cost = sum(r["revenue"] for r in rows), sum(r["cost"] for r in rows)
    assert figures["Profit"]["value"] == total - cost and figures["Margin"]["value"] == round((total - cost) / total * 100, 2)


def test_unrelated_numbers_and_other_scales_are_no_cost(spark):
    schema, figures = bound(spark, [{"when": day(i), "bed_days": 1 + i % 25, "admissions": 1 + i % 6, "ward": "AB"[i % 2] * 2} for i in range(40)])
    assert not schema.keys() & {"cost", "profit"} and "Margin" not in figures
    schema, figures = bound(spark, [{"when": day(i), "revenue": f"${100_000 + i * 500}", "handling_cost": f"${1 + i % 4}.5", "region": "NS"[i % 2] * 2} for i in range(40)])
    assert "cost" not in schema and "Margin" not in figures
    schema, _ = bound(spark, [{"when": day(i), "revenue": f"${100 + (i % 50) * 9}", "profit": ["up", "down", "flat"][i % 3], "region": "NS"[i % 2] * 2} for i in range(40)])
    assert "profit" not in schema


def test_a_table_without_a_measure_leads_with_its_records(spark):
    _, figures = bound(spark, [{"kind": "ab"[i % 2] * 2, "who": f"person {i}"} for i in range(30)])
    assert min(figures.values(), key=lambda f: f["position"])["label"] == "Records"
