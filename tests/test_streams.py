"""Monitors over several micro-batches against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from photonwatch.session import prepare
from photonwatch.sources import sinks
from photonwatch.streaming import monitors

START = dt.datetime(2024, 1, 1)


def batches(spark, folder, rows, schema, parts=4):
    """Write rows as time-ordered files and stream them one file per batch."""
    size = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * size : (i + 1) * size], schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder / "in"))


@pytest.fixture
def logins():
    rng = random.Random(9)
    return [(i, 1 if rng.random() < 0.5 else rng.randint(2, 4), START + dt.timedelta(minutes=i), rng.random() < 0.12) for i in range(200)]


def shuffled(rows, span, seed=1):
    """Rows out of order by at most ``span`` places, so files overlap in time."""
    rng = random.Random(seed)
    return [r for _, r in sorted((i + rng.uniform(0, span), r) for i, r in enumerate(rows))]


@pytest.mark.parametrize("span", [0, 12])
def test_lockouts_over_batches(spark, tmp_path, logins, span):
    end = [(900 + i, 9, START + dt.timedelta(days=1 + i), True) for i in range(2)]  # moves the watermark on
    stream = batches(spark, tmp_path, shuffled(logins, span) + end, "event_id long, user_id long, ts timestamp, success boolean", 5)
    got = monitors.run_to_folder(monitors.lockout_monitor(stream.withWatermark("ts", "60 minutes")), "t").collect()
    failures, want = {}, []
    for _, user, ts, success in logins:
        failures[user] = 0 if success else failures.get(user, 0) + 1
        if failures[user] == 5:
            want.append((user, ts))
    assert sorted((r.user_id, r.locked_at) for r in got) == sorted(want)


def test_a_late_success_prevents_a_lockout(spark, tmp_path):
    rows = [(i, 1, START + dt.timedelta(seconds=s), False) for i, s in enumerate((0, 10, 20, 40, 50))]
    rows += [(9, 1, START + dt.timedelta(seconds=30), True)] * 1 + [(20 + i, 2, START + dt.timedelta(hours=1 + i), True) for i in range(4)]
    stream = batches(spark, tmp_path, rows, "event_id long, user_id long, ts timestamp, success boolean", 2)
    assert monitors.run_to_folder(monitors.lockout_monitor(stream.withWatermark("ts", "10 minutes")), "t").count() == 0


@pytest.mark.parametrize("span", [0, 6])
def test_state_changes_and_timeout(spark, tmp_path, span):
    rows = [(i, i % 3, START + dt.timedelta(seconds=10 * i), "requested" if i < 12 or i % 3 else "active") for i in range(60)]
    stream = batches(spark, tmp_path, shuffled(rows, span) + [(99, 9, START + dt.timedelta(days=1), "x")] * 2, "event_id long, service_id long, ts timestamp, state string")
    got = monitors.run_to_folder(monitors.state_change_monitor(stream.withWatermark("ts", "2 minutes"), 200.0), "t").collect()
    kinds = sorted((r.service_id, r.state, r.kind, r.elapsed) for r in got)
    assert kinds == sorted(
        [(0, "requested", "change", 0.0), (0, "active", "change", 120.0), (1, "requested", "change", 0.0), (2, "requested", "change", 0.0)]
        + [(k, "requested", "timeout", 200.0) for k in (1, 2)]
    )


BREACH = "event_id long, node_name string, metric string, ts timestamp, value double"


@pytest.mark.parametrize("span", [0, 4])
def test_sustained_breach(spark, tmp_path, span):
    values = [10, 40, 10, 40, 45, 50, 42, 25, 15, 15, 15, 15, 40, 10]
    rows = [(i, "n", "qber", START + dt.timedelta(seconds=20 * i), float(v)) for i, v in enumerate(values)]
    rows = shuffled(rows, span) + [(99 + i, "z", "qber", START + dt.timedelta(hours=1 + i), 0.0) for i in range(2)]
    stream = batches(spark, tmp_path, rows, BREACH, 4)
    found = monitors.sustained_breach_monitor(stream.withWatermark("ts", "2 minutes"), 30.0, 20.0, 40.0, 20.0)
    got = [(r.event, r.value, (r.ts - START).total_seconds()) for r in monitors.run_to_folder(found, "t").orderBy("ts").collect()]
    # breach from the 4th reading on, held 60 s at the 7th; calm from the 9th on, held 30 s after the 10th
    assert got == [("raised", 42.0, 120.0), ("cleared", 15.0, 190.0)]


def test_a_breach_followed_by_silence_is_raised(spark, tmp_path):
    rows = [(1, "n", "qber", START, 50.0)] + [(9 + i, "z", "qber", START + dt.timedelta(hours=1 + i), 0.0) for i in range(3)]
    stream = batches(spark, tmp_path, rows, BREACH, 2)
    found = monitors.sustained_breach_monitor(stream.withWatermark("ts", "1 minute"), 30.0, 20.0, 40.0, 20.0)
    got = monitors.run_to_folder(found, "t").collect()
    assert [(r.node_name, r.event, r.value, r.ts) for r in got] == [("n", "raised", 50.0, START + dt.timedelta(seconds=60))]


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [(START + dt.timedelta(minutes=m), "n", "cpu", 1.0) for m in (1, 20, 120, 240, 260, 280, 2, 400)]
    stream = batches(spark, tmp_path, rows, "timestamp timestamp, node_name string, metric string, value double", 4)
    got = monitors.run_to_folder(monitors.tumbling_means(stream.withWatermark("timestamp", "30 minutes")), "t").collect()
    assert sum(r.points for r in got if r.start == START) == 1  # minute 2 comes after its window closed
    assert {r.start for r in got} >= {START, START + dt.timedelta(minutes=15), START + dt.timedelta(minutes=120)}


def test_band_join(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), START + dt.timedelta(seconds=rng.randint(0, 900)), i % 2) for i in range(80)]
    stream = batches(spark, tmp_path, rows, "event_id long, node_name string, ts timestamp, side int", 1)
    left = stream.filter("side = 0").select(F.col("event_id").alias("a"), "node_name", F.col("ts").alias("node_time")).withWatermark("node_time", "1 minute")
    right = stream.filter("side = 1").select(F.col("event_id").alias("b"), "node_name", F.col("ts").alias("link_time")).withWatermark("link_time", "1 minute")
    got = monitors.run_to_folder(monitors.near_in_time(left, right).select("a", "b"), "t").collect()
    want = [(x[0], y[0]) for x in rows for y in rows if x[3] == 0 and y[3] == 1 and x[1] == y[1] and abs((x[2] - y[2]).total_seconds()) < 60]
    assert sorted((r.a, r.b) for r in got) == sorted(want)


def test_a_changed_rule_holds_from_the_next_batch(spark, tmp_path):
    path, folder = str(tmp_path / "rules"), str(tmp_path / "out")
    columns = "metric string, kind string, threshold double"
    monitors.write_rules(spark.createDataFrame([("q", "max", 5.0), ("v", "min", 1.0)], columns), path)
    rows = [(k, m, float(k % 10)) for k in range(40) for m in ("q", "v")]
    schema = "event_id long, metric string, value double"
    spark.createDataFrame(rows[:40], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    monitors.ruled_violations(stream(), ["event_id"], path, folder)
    # between batches a rule is changed, one dropped and one added
    monitors.write_rules(spark.createDataFrame([("q", "max", 7.0), ("q", "min", 1.0)], columns), path)
    spark.createDataFrame(rows[40:], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = monitors.ruled_violations(stream(), ["event_id"], path, folder).collect()
    want = [(k, m, v, 5.0, "exceeds", 1) for k, m, v in rows[:40] if m == "q" and v > 5] + [(k, m, v, 1.0, "below", 1) for k, m, v in rows[:40] if m == "v" and v < 1]
    want += [(k, m, v, 7.0, "exceeds", 2) for k, m, v in rows[40:] if m == "q" and v > 7] + [(k, m, v, 1.0, "below", 2) for k, m, v in rows[40:] if m == "q" and v < 1]
    assert sorted((r.event_id, r.metric, r.value, r.threshold, r.type, r.version) for r in got) == sorted(want)


def test_a_changed_file_replaces_its_old_version(spark, tmp_path):
    landing, store = tmp_path / "landing", str(tmp_path / "store")

    def upload(number, files):
        for name, text in files.items():
            folder = landing / f"upload-{number}" / f"filename={name}"
            folder.mkdir(parents=True)
            (folder / "part-0.txt").write_text(text, encoding="utf-8")

    def cut(rows):
        return rows.select("filename", "content_hash", F.posexplode(F.split("text", "[|]")).alias("chunk_index", "content"))

    steps = [
        {"a.txt": "one|two|three", "b.txt": "x"},
        {"a.txt": "one|2", "b.txt": "x", "c.txt": "é"},  # b is the same again
        {"a.txt": "one|two|three"},  # an old content comes back
    ]
    active = []
    for number, files in enumerate(steps):
        upload(number, files)
        monitors.ingest_versions(monitors.upload_stream(spark, str(landing)), store, cut)
        chunks = monitors.active_version_chunks(spark, store)
        active.append(sorted((r.filename, r.content) for r in chunks.collect()))
    assert active[0] == [("a.txt", "one"), ("a.txt", "three"), ("a.txt", "two"), ("b.txt", "x")]
    assert active[1] == [("a.txt", "2"), ("a.txt", "one"), ("b.txt", "x"), ("c.txt", "é")]
    assert active[2] == [("a.txt", "one"), ("a.txt", "three"), ("a.txt", "two"), ("b.txt", "x"), ("c.txt", "é")]
    found = monitors.versions(spark, store).groupBy("filename").agg(F.count("*").alias("n"), F.count_if(F.col("valid_to").isNull()).alias("open")).collect()
    assert {r.filename: (r.n, r.open) for r in found} == {"a.txt": (3, 1), "b.txt": (1, 1), "c.txt": (1, 1)}


def test_many_files_are_listed_by_few_tasks(spark, tmp_path):
    """One task for each file of every upload took longer than the files themselves."""
    prepare(spark)
    for n in range(150):
        folder = tmp_path / "landing" / "upload-1" / f"filename=f{n}"
        folder.mkdir(parents=True)
        (folder / "part-0.txt").write_text(f"text {n}")
    (tmp_path / "landing" / "upload-1" / "_SUCCESS").write_text("")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    cut = lambda rows: rows.select("filename", "content_hash", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    monitors.ingest_versions(monitors.upload_stream(spark, str(tmp_path / "landing")), str(tmp_path / "store"), cut)
    chunks = monitors.active_version_chunks(spark, str(tmp_path / "store")).collect()
    assert sorted((r.filename, r.content) for r in chunks) == sorted((f"f{n}", f"text {n}") for n in range(150))
    infos = [tracker.getJobInfo(j) for j in set(tracker.getJobIdsForGroup(None)) - before]
    tasks = [tracker.getStageInfo(s).numTasks for i in infos if i for s in i.stageIds if tracker.getStageInfo(s)]
    assert max(tasks, default=0) < 150


def test_many_small_files_are_few_batches_and_tasks(spark, tmp_path):
    """By number and as 4 MB each, small files made a batch per thousand and a task per few; each was written by way of three programs."""
    prepare(spark)
    rows = [(f"f{n}", f"text {n}") for n in range(1300)]
    sinks.write_files(spark.createDataFrame(rows, "filename string, text string").repartition(3), f"{tmp_path}/landing/upload-1")
    assert not list((tmp_path / "landing").rglob("*.crc")) and len(list((tmp_path / "landing").rglob("part-*.txt"))) == 1300
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    cut = lambda rows: rows.select("filename", "content_hash", F.lit(0).alias("chunk_index"), F.col("text").alias("content"))
    monitors.ingest_versions(monitors.upload_stream(spark, str(tmp_path / "landing")), str(tmp_path / "store"), cut)
    chunks = monitors.active_version_chunks(spark, str(tmp_path / "store")).collect()
    assert sorted((r.filename, r.content) for r in chunks) == sorted((name, text + "\n") for name, text in rows)
    assert len(list((tmp_path / "store" / "versions").glob("batch=*"))) == 1
    infos = [tracker.getJobInfo(j) for j in set(tracker.getJobIdsForGroup(None)) - before]
    assert max((tracker.getStageInfo(s).numTasks for i in infos if i for s in i.stageIds if tracker.getStageInfo(s)), default=0) <= 64
    assert spark.conf.get("spark.sql.files.openCostInBytes") in ("4194304", "4194304b", "4MB")


def test_files_are_written_as_spark_writes_them(spark, tmp_path):
    names = ["a", "a b", "é%41", "x=y:z/[1]{2}*?'\"#^\\", "tab\t", None, "", "a", "\x7f"]
    df = spark.createDataFrame([(n, None if k == 1 else f"line {k}\nü") for k, n in enumerate(names)], "filename string, text string").coalesce(1)
    df.write.partitionBy("filename").text(f"{tmp_path}/spark")
    sinks.write_files(df, f"file://{tmp_path}/own")
    read = [sorted((p.parent.name, p.read_bytes()) for p in (tmp_path / d).rglob("part-*.txt")) for d in ("spark", "own")]
    assert read[0] == read[1] and len(read[0]) == 7
    with pytest.raises(FileExistsError):
        sinks.write_files(df, f"file://{tmp_path}/own")
