"""Registered queries next to their SQL, at the smallest scale.

A spread of queries by default; FULL_CHECK=1 runs all of them.
"""

import os

import pytest

from tallyloom.plans import all_queries, all_sql
from tests.oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
SPREAD = [
    "a1_csv_scan", "a7_append_problems", "a10_csv_export", "a11_paged_read", "b1_parse_number", "b7_to_iso_date", "b14_money_format",
    "c3_iqr_outlier_count", "c12_quality_issues", "d2_apply_recipe", "d9_applied_log", "e5_column_roles", "f5_cascade_exclusions",
    "g1_guarded_join", "g2_join_analysis", "h4_kpi_table", "i6_period_range", "j1_previous_period", "k1_anomalies", "k2_metric_correlation",
    "l1_driver_contributions", "l5_headline", "m3_moving_average", "m20_forecast_scoring", "o1_value_tiers", "o6_churn_features",
    "a9_ingest", "a13_report", "c1_merged_states", "e14_slot_binding", "e16_derived_figures", "f3_written_dates", "g5_join_chain", "h7_written_dates",
    "l4_investigation", "m13_selection", "m15_forecast_bands", "o5_described_segments", "o14_pair_rules", "p3_rank_by_period", "q3_evidence_figures",
    "p1_pivot_totals", "p5_quantile_buckets", "q1_fingerprint", "r2_threshold_rules", "r3_score_upsert", "r4_period_totals",
]
NAMES = sorted(all_sql()) if os.environ.get("FULL_CHECK") else SPREAD


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(all_queries()[name](spark, SF), con, all_sql()[name]) in ("", "EMPTY")


def test_every_sql_has_a_query():
    assert set(all_sql()) <= set(all_queries())


def test_results_do_not_depend_on_the_number_of_partitions(spark):
    def rows(name, partitions):
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        return sorted(map(str, all_queries()[name](spark, SF).collect()))

    for name in ("h4_kpi_table", "o6_churn_features", "l3_multi_dimension_drivers"):
        assert rows(name, 1) == rows(name, 13)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_the_flagship_query(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() == 9
