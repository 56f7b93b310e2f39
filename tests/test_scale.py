"""Bucketed windows must equal plain ones, also for a key that holds most rows."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photonwatch import scale


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 400
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.6, np.nan, np.round(rng.random(n), 3))
    flag = (rng.random(n) < 0.3).astype(int)
    return pd.DataFrame({"k": key, "t": rng.permutation(n), "v": value, "f": flag})


@pytest.fixture(scope="module")
def rows(spark, frame):
    df = spark.createDataFrame(frame.astype({"v": object}).where(frame.notna(), None), "k string, t long, v double, f long")
    return scale.spread(df.withColumn("b", F.floor(F.col("t") / 16)), ["k"], "b")


def collected(df, column):
    return {(r.k, r.t): r[column] for r in df.collect()}


def expected(frame, fn):
    out = {}
    for k, part in frame.sort_values("t").groupby("k"):
        for t, v in zip(part["t"], fn(part)):
            out[(k, t)] = None if pd.isna(v) else v
    return out


def test_row_number_and_total(rows, frame):
    got = scale.split_row_number(rows, ["k"], "b", [F.col("t")], "i", total="n")
    assert collected(got, "i") == expected(frame, lambda p: np.arange(1, len(p) + 1))
    assert collected(got, "n") == expected(frame, lambda p: [len(p)] * len(p))


def test_running_sum(rows, frame):
    got = scale.split_running_sum(rows, ["k"], "b", [F.col("t")], "f", "s")
    assert collected(got, "s") == expected(frame, lambda p: p["f"].cumsum())


def test_lag(rows, frame):
    got = scale.split_lag(rows, ["k"], "b", ["t"], {"f": "p"})
    assert collected(got, "p") == expected(frame, lambda p: p["f"].shift())


def test_fills(rows, frame):
    assert collected(scale.split_fill(rows, ["k"], "b", ["t"], ["v"]), "v") == expected(frame, lambda p: p["v"].ffill())
    both = scale.split_fill_both(rows, ["k"], "b", ["t"], ["v"])
    assert collected(both, "v") == expected(frame, lambda p: p["v"].ffill().bfill())
    other = scale.split_fill_both(rows, ["k"], "b", ["t"], ["v"], newest_first=True)
    assert collected(other, "v") == expected(frame, lambda p: p["v"].bfill().ffill())


def test_buckets_are_not_gathered_by_key(spark, rows):
    """A window over (key, bucket) after a shuffle by key must shuffle again."""
    by_key = rows.repartition(4, "k")
    plan = scale.split_row_number(by_key, ["k"], "b", [F.col("t")], "i")._jdf.queryExecution().executedPlan().toString()
    # expression ids vary: look for the two-column clustering below the row number
    assert "hashpartitioning(k#" in plan and ", b#" in plan.split("row_number")[1].split("Exchange", 1)[1][:60]


def test_a_summary_beside_every_row_keeps_hot_keys_spread(spark):
    rows = spark.range(2000).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    sums = rows.groupBy("k").agg(F.sum("id").alias("total"))
    got = {(r.id, r.k, r.total) for r in scale.beside(rows, sums.filter("k <> 'k0'"), ["k"], 8).collect()}
    hot = sum(i for i in range(2000) if i % 3)
    assert got == {(i, "hot", hot) if i % 3 else (i, f"k{i}", i) for i in range(1, 2000)}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scale.beside(rows, sums, ["k"], 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    shuffles = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    # by key alone only sums per task, for the summary itself
    assert [s for s in shuffles if "_salt" in s] and len([s for s in shuffles if "_salt" not in s]) <= 1
