import random
import re

import pytest
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.functions import scores
from photonwatch.operators import topology
from photonwatch.plans.fixtures import Tables
from photonwatch.session import prepare


def walked(start, links):
    """Plain loop over one path."""
    out, here = [], start
    for s, d in links:
        there = d if s == here else s
        out.append((here, there))
        here = there
    return out


@pytest.mark.parametrize("bucket", [4, 1024])
def test_path_hops_equal_a_plain_walk(spark, monkeypatch, bucket):
    monkeypatch.setattr(topology, "_STEP_BUCKET", bucket)
    rng = random.Random(3)
    paths = {i: [(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(rng.choice([1, 2, 5, 30]))] for i in range(60)}
    steps = [(i, n * rng.randint(1, 1) + 1, s, d) for i, links in paths.items() for n, (s, d) in enumerate(links)]
    starts = {i: rng.randint(0, 3) for i in paths}
    df = spark.createDataFrame(steps, "session_id long, step_order long, source_node long, destination_node long")
    given = spark.createDataFrame(list(starts.items()), "session_id long, start_node long")
    for first, frame in ((starts, given), ({i: p[0][0] for i, p in paths.items()}, None)):
        rows = topology.path_hops(df, frame).collect()
        got = {(r.session_id, r.step_order): (r.from_node, r.to_node) for r in rows}
        want = {(i, n + 1): hop for i, p in paths.items() for n, hop in enumerate(walked(first[i], p))}
        assert got == want


def test_segments_ignore_direction_and_repeats(spark):
    steps = [(1, 1, 1, 2), (1, 2, 2, 3), (1, 3, 3, 2), (1, 4, 2, 1), (2, 1, 3, 2), (2, 2, 2, 1), (3, 1, 5, 6), (3, 2, 6, 7)]
    df = spark.createDataFrame(steps, "session_id long, step_order long, source_node long, destination_node long")
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 8)], "id long, node_id string")
    top = topology.busiest_segments(topology.path_hops(df), nodes, 3).collect()
    assert {(r.node_1, r.node_2, r.node_3): r.num_sessions for r in top}[("n1", "n2", "n3")] == 2


def test_link_scores_by_hand(spark):
    rows = [(5.5, 90.0, 5.0, 20.0), (22.0, 0.0, 20.0, 100.0), (0.0, 100.0, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "qber double, visibility double, key_rate double, photon_loss double")
    got = [(r[0], r[1]) for r in df.select(scores.instability(), scores.quality_index()).collect()]
    # 0.4*.5 + 0.3*.1 + 0.1*.5 + 0.2*.2 = .32; capped QBER and rate: .4 + .3 + 0 + .2 = .9
    assert got == [(32.0, 68.0), (90.0, 10.0), (0.0, 100.0)]


def test_new_links_guard(spark):
    nodes = spark.createDataFrame([(1, "a", "QKD"), (2, "b", "QKD"), (3, "c", "Switch")], "id long, node_id string, type string")
    links = spark.createDataFrame([(1, 2)], "source_node long, destination_node long")
    asked = [(1, "a", "a"), (2, "b", "a"), (3, "a", "x"), (4, "c", "a"), (5, "b", "c")]
    got = topology.new_links(spark.createDataFrame(asked, "request_id long, source string, destination string"), nodes, links)
    assert sorted((r.request_id, r.link_type) for r in got.collect()) == [(4, "Classical"), (5, "Classical")]


def test_paths_broadcast_no_row_per_session(spark, tmp_path):
    """Small in their packed file, the tables of one row per session would be sent to every task by way of the driver."""
    orders = spark.range(3000).selectExpr("id AS o_orderkey", "id % 50 AS o_custkey", "'O' AS o_orderstatus", "current_date() AS o_orderdate")
    lines = spark.range(6000).selectExpr("id % 3000 AS l_orderkey", "id div 3000 AS l_linenumber", "id AS l_partkey", "id % 40 AS l_suppkey")
    suppliers = spark.range(40).selectExpr("id AS s_suppkey")
    for name, df in (("orders", orders), ("lineitem", lines), ("supplier", suppliers)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    t = Tables(prepare(spark), str(tmp_path))
    starts = t.sessions.selectExpr("id AS session_id", "source_node AS start_node")
    hops = topology.path_hops(topology.session_steps(t.session_path, t.links), starts)
    hops.collect()
    plan = hops._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    broadcast = re.findall(r"BroadcastExchange[^\n]*\n[^\n]*", plan)
    assert not [b for b in broadcast if "o_orderkey" in b or "session_id" in b], broadcast


def test_only_buckets_that_get_something_are_joined(spark):
    rows = [(k, n // 4, n) for k, size in ((1, 10), (2, 3), (None, 2)) for n in range(size)]
    df = spark.createDataFrame(rows, "k long, b long, n long")
    numbered = scale.split_row_number(df, ["k"], "b", [F.col("n")], "r").collect()
    assert sorted((r.k, r.n, r.r) for r in numbered) == sorted((k, n, n + 1) for k, _, n in rows if k is not None)
    lagged = scale.split_lag(df, ["k"], "b", ["n"], {"n": "before"}).collect()
    assert sorted((r.k, r.n, r.before or 0) for r in lagged) == sorted((k, n, max(0, n - 1)) for k, _, n in rows if k is not None)
    carried = scale._with_carried(df, df.groupBy("k", "b").agg(F.lit(None).cast("long").alias("c")), ["k"], "b", "c")
    assert carried.filter("c IS NOT NULL").count() == 0 and carried.count() == 13


def test_starts_are_not_copied_and_paths_are_read_once(spark, tmp_path):
    """Each start went to a quarter of the shuffle partitions, and the paths were shuffled once with and once without it."""
    prepare(spark)
    spark.range(4000).selectExpr("id div 4 AS session_id", "id % 4 AS step_order", "id % 7 AS source_node", "id % 5 AS destination_node").write.parquet(f"{tmp_path}/steps")
    spark.range(1000).selectExpr("id AS session_id", "id % 7 AS start_node").write.parquet(f"{tmp_path}/starts")
    hops = topology.path_hops(spark.read.parquet(f"{tmp_path}/steps"), spark.read.parquet(f"{tmp_path}/starts"))
    assert len(hops.collect()) == 4000
    plan = hops._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Generate" not in plan and len(re.findall(r"FileScan parquet.*destination_node", plan)) == 1, plan


def test_paths_with_repeated_and_missing_keys(spark):
    """A session with two starts gives its steps for both, one without a start gives none; nulls give none."""
    steps = [(1, 1, 5, 6), (1, 2, 6, 7), (2, 1, 1, 2), (None, 1, 1, 2), (3, 3000, 8, 9), (3, 1, 9, 4), (4, 1, 2, 3)]
    df = spark.createDataFrame(steps, "session_id long, step_order long, source_node long, destination_node long")
    starts = spark.createDataFrame([(1, 5), (2, 2), (2, 2), (3, 4), (None, 1), (4, None)], "session_id long, start_node long")
    got = topology.path_hops(df, starts).collect()
    want = [(1, 1, 5, 6), (1, 2, 6, 7), (2, 1, 2, 1), (2, 1, 1, 1), (3, 1, 4, 9), (3, 3000, 9, 8), (4, 1, None, 2)]
    assert sorted(repr(tuple(r)[:4]) for r in got) == sorted(map(repr, want))
