"""Monitors over a finished table judge all of it, to its last row."""

import datetime as dt
import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as app  # noqa: E402
from check_queries import TABLES, compare  # noqa: E402
from photonwatch.streaming import monitors  # noqa: E402

FOLDER = "/root/testdata/sf0.01"
MONITORS = ["m2_tumbling_means", "m4_state_monitor", "m5_lockouts", "m6_sustained_breaches"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
@pytest.mark.parametrize("name", MONITORS)
def test_monitors_reach_the_end(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    cursor = con.execute(app.oracle_sql()[name])
    rows, columns = cursor.fetchall(), [c[0] for c in cursor.description]
    df = app.queries()[name](spark, FOLDER)
    assert compare(df.columns, df.collect(), columns, rows) == ""


def test_closing_comes_after_all_batches(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "event_id long, user_id long, ts timestamp, success boolean"
    for k in range(5):
        spark.createDataFrame([(k, 1, start + dt.timedelta(minutes=k), False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    end = spark.createDataFrame([(-1, -1, start + dt.timedelta(hours=3), True)], schema)
    both, close = monitors.closable(stream, end)
    logins = monitors.lockout_monitor(both.withWatermark("ts", "1 hour"))
    got = monitors.run_to_folder(logins, "t", close=close).select("user_id", F.col("locked_at").cast("string").alias("at")).collect()
    assert [tuple(r) for r in got] == [(1, "2024-01-01 00:04:00")]
