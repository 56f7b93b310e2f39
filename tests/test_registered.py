"""Registered queries against their SQL on the smallest tables, and their plans."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as app  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
CHECKED = [
    "d1_active_fault_stats", "d3_faults_per_day", "d5_keys_per_day", "d7_top_components", "c5_c6_fault_list", "d8_network_means",
    "d15_c11_role_catalogue", "e12_failure_streaks", "d34_policy_detail", "b6_b7_session_search", "c13_fault_audit", "h1_h2_scored_links",
    "e7_path_hops", "e8_busiest_segments", "d22_c2_c3_training_frame", "c4_band_join_recent", "d23_snapshot", "i1_feature_matrix",
    "e4_half_split_trend", "h4_h5_h6_diagnosis", "j3_f3_bm25_search", "j7_j8_hybrid_search", "k1_fixed_chunks", "k4_sentence_chunks",
    "k9_alarm_requests", "l1_acknowledge_log", "l2_resolved_faults", "m2_tumbling_means", "h8_insights",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, name):
    df = app.queries()[name](spark, FOLDER)
    cursor = con.execute(app.oracle_sql()[name])
    assert compare(df.columns, df.collect(), [c[0] for c in cursor.description], cursor.fetchall()) == ""


def test_every_oracle_has_a_query():
    assert set(app.oracle_sql()) <= set(app.queries())


@pytest.mark.parametrize("name", ["c2_node_link_incidence", "d22_c2_c3_training_frame", "c4_band_join_recent", "c5_c6_fault_list", "e7_path_hops", "c18_section_of_page"])
def test_no_nested_loops(spark, name):
    plan = app.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_filters_reach_the_scan(spark):
    plan = app.queries()["d3_faults_per_day"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "ReadSchema: struct<o_orderdate:timestamp_ntz>" in plan


def test_entry(spark):
    assert app.entry(spark).count() > 0
