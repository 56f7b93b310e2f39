"""Registered queries: the streaming monitors run over the event file until it is read."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch.functions.rules import RULE_SETS
from photonwatch.operators import text
from photonwatch.plans.fixtures import Tables
from photonwatch.plans.registry import query
from photonwatch.sources import sinks
from photonwatch.streaming import monitors


def _events(t: Tables) -> DataFrame:
    return monitors.file_stream(t.spark, f"{t.folder}/events.parquet", t.raw("events").schema)


def _finished_events(t: Tables, seconds: int) -> tuple[DataFrame, Callable[[], None]]:
    """The event stream, and what ends it: one event ``seconds``, the delay and the longest wait, and one more after the last."""
    events = t.raw("events")
    given = {"event_id": F.lit(-1), "user_id": F.lit(-1), "event_type": F.lit("purchase"), "value": F.lit(0)}
    given["ts"] = F.col("_last") + F.expr(f"INTERVAL {seconds + 1} SECONDS")
    last = events.agg(F.max("ts").alias("_last")).filter("_last is not null")
    end = last.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    return monitors.closable(_events(t), end)


def _node(divisor: int) -> Column:
    return F.concat(F.lit("N"), (F.col("user_id") % divisor).cast("string"))


def _readings(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", _node(12).alias("node_name"), F.col("ts").alias("timestamp"), F.col("event_type").alias("metric"), "value")
    return monitors.with_event_time(rows, "timestamp", "30 minutes")


@query("m1_live_violations", sql="""
WITH r AS (SELECT event_id, concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name, least(value / 1000, 0.2) AS q, 20 + least(value, 80) AS c FROM events)
SELECT event_id, node_name, 'qkdQber' AS metric, round(q, 6) AS value, CAST(0.06 AS DOUBLE) AS threshold, 'exceeds' AS type FROM r WHERE q > 0.06
UNION ALL SELECT event_id, node_name, 'neTemperature', round(c, 6), CAST(75 AS DOUBLE), 'exceeds' FROM r WHERE c > 75""")
def _(t: Tables):
    value = F.col("value")
    rows = _events(t).select(
        "event_id",
        _node(12).alias("node_name"),
        F.least(value / 1000, F.lit(0.2)).alias("qkdQber"),
        (F.lit(20) + F.least(value, F.lit(80.0))).alias("neTemperature"),
    )
    limits = [r for r in RULE_SETS["fault_default"] if r.metric in ("qkdQber", "neTemperature")]
    found = monitors.live_violations(rows, ["event_id", "node_name"], limits)
    return monitors.run_to_folder(found, "violations").withColumn("value", F.round("value", 6))


@query("m1_ruled_violations", sql="""
WITH r AS (SELECT event_id, concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name, event_type AS metric, value FROM events),
rules AS (SELECT metric, 'max' AS kind, max(value) * 0.5 AS threshold FROM r GROUP BY 1 UNION ALL SELECT metric, 'min', max(value) * 0.01 FROM r WHERE metric <> 'error' GROUP BY 1)
SELECT event_id, node_name, metric, value, threshold, CASE kind WHEN 'max' THEN 'exceeds' ELSE 'below' END AS type FROM r JOIN rules USING (metric)
WHERE CASE kind WHEN 'max' THEN value > threshold ELSE value < threshold END""")
def _(t: Tables):
    folder = sinks.scratch_folder(t.spark, "ruled")
    top = t.raw("events").groupBy(F.col("event_type").alias("metric")).agg(F.max("value").alias("top"))
    most = top.select("metric", F.lit("max").alias("kind"), (F.col("top") * 0.5).alias("threshold"))
    least = top.filter("metric != 'error'").select("metric", F.lit("min").alias("kind"), (F.col("top") * 0.01).alias("threshold"))
    monitors.write_rules(most, f"{folder}/rules")  # replaced before the stream begins
    monitors.write_rules(most.unionByName(least), f"{folder}/rules")
    rows = _events(t).select("event_id", _node(12).alias("node_name"), F.col("event_type").alias("metric"), "value")
    found = monitors.ruled_violations(rows, ["event_id", "node_name"], f"{folder}/rules", folder)
    return found.select("event_id", "node_name", "metric", "value", "threshold", "type")


@query("m2_tumbling_means", sql="""
WITH w AS (SELECT CAST(time_bucket(INTERVAL '15' MINUTE, ts) AS TIMESTAMP) AS start, concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name, event_type AS metric, value FROM events)
SELECT start, start + INTERVAL '15' MINUTE AS "end", node_name, metric, round(avg(value), 6) AS mean, count(*) AS points FROM w
GROUP BY 1, 2, 3, 4""")
def _(t: Tables):
    events, close = _finished_events(t, 1800 + 900)
    means = monitors.run_to_folder(monitors.tumbling_means(_readings(events)), "means", close=close)
    return means.select(
        F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"),
        "node_name", "metric", F.round("mean", 6).alias("mean"), "points",
    )


_PRESET_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS preset, CAST(time_bucket(INTERVAL '{step}' MINUTE, ts) AS TIMESTAMP) - to_minutes({step} * k) AS start, {length} AS minutes, node_name, metric, value "
    f"FROM r, range({length} // {step}) x(k)"
    for name, length, step in (("1h", 60, 15), ("24h", 1440, 60), ("7d", 10080, 1440))
)


@query("m2_preset_means", sql=f"""
WITH r AS (SELECT ts, concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name, event_type AS metric, value FROM events), w AS ({_PRESET_SQL})
SELECT preset, start, start + to_minutes(minutes) AS "end", node_name, metric, round(avg(value) + 1e-9, 6) AS mean, count(*) AS points FROM w GROUP BY ALL""")
def _(t: Tables):
    means = None
    for preset in monitors.PRESETS:
        # the delay, the longest window, and the short windows that it is made of
        events, close = _finished_events(t, 1800 + 7 * 86400 + 900)
        own = monitors.run_to_folder(monitors.preset_means(_readings(events), preset), "presets", close=close)
        means = own if means is None else means.unionByName(own)
    return means.select(
        "preset", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"),
        "node_name", "metric", F.round(F.col("mean") + 1e-9, 6).alias("mean"), "points",  # off the halves, where sums of sums may differ
    )


@query("m3_near_in_time", sql="""
WITH n AS (SELECT event_id AS node_event, concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name, ts FROM events WHERE event_type NOT IN ('purchase', 'signup')),
l AS (SELECT event_id AS link_event, concat('N', CAST(user_id % 9 AS VARCHAR)) AS node_name, ts FROM events WHERE event_type IN ('purchase', 'signup'))
SELECT n.node_event, l.link_event, n.node_name FROM n JOIN l ON n.node_name = l.node_name AND abs(epoch_us(n.ts) - epoch_us(l.ts)) < 60000000""")
def _(t: Tables):
    link = F.col("event_type").isin("purchase", "signup")
    nodes = _events(t).filter(~link).select(F.col("event_id").alias("node_event"), _node(12).alias("node_name"), F.col("ts").alias("node_time"))
    links = _events(t).filter(link).select(F.col("event_id").alias("link_event"), _node(9).alias("node_name"), F.col("ts").alias("link_time"))
    pairs = monitors.near_in_time(
        monitors.with_event_time(nodes, "node_time", "10 minutes"), monitors.with_event_time(links, "link_time", "10 minutes")
    )
    return monitors.run_to_folder(pairs.select("node_event", "link_event", "node_name"), "pairs")


@query("m4_state_monitor", sql="""
WITH s AS (SELECT event_id, user_id AS service_id, ts, CASE event_type WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'failed' ELSE event_type END AS state FROM events),
w AS (SELECT service_id, event_id, state, epoch_us(ts) AS us, lag(state) OVER (PARTITION BY service_id ORDER BY ts, event_id) AS before,
  min(epoch_us(ts)) OVER (PARTITION BY service_id) AS begin FROM s)
SELECT service_id, event_id, state, round((us - begin) / 1000000.0, 3) AS elapsed, 'change' AS kind FROM w WHERE before IS DISTINCT FROM state
UNION ALL SELECT service_id, -1, arg_max(state, struct_pack(a := us, b := event_id)) FILTER (WHERE us <= begin + 3600000000), 3600.0, 'timeout' FROM w
GROUP BY service_id, begin HAVING count(*) FILTER (WHERE state IN ('active', 'failed') AND us - begin < 3600000000) = 0""")
def _(t: Tables):
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "active").when(kind == "error", "failed").otherwise(kind)
    events, close = _finished_events(t, 3600 + 3600)
    log = events.select("event_id", F.col("user_id").alias("service_id"), "ts", state.alias("state"))
    rows = monitors.run_to_folder(monitors.state_change_monitor(monitors.with_event_time(log, "ts", "1 hour"), 3600.0), "states", close=close)
    return rows.select("service_id", "event_id", "state", F.round("elapsed", 3).alias("elapsed"), "kind")


@query("m5_lockouts", views="login_log", sql="""
WITH runs AS (SELECT *, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM login_log),
n AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt FROM runs WHERE NOT success)
SELECT user_id, date_trunc('millisecond', ts) AS locked_at, CAST(5 AS BIGINT) AS failures FROM n
WHERE attempt = 5""")
def _(t: Tables):
    events, close = _finished_events(t, 600)
    logins = events.filter(F.col("event_type").isin("error", "purchase")).select(
        "event_id", "user_id", "ts", (F.col("event_type") == "purchase").alias("success")
    )
    rows = monitors.run_to_folder(monitors.lockout_monitor(monitors.with_event_time(logins, "ts", "10 minutes")), "lockouts", close=close)
    return rows.select("user_id", F.date_trunc("millisecond", "locked_at").cast("timestamp_ntz").alias("locked_at"), "failures")


@query("m6_sustained_breaches", sql="""
WITH r AS (SELECT event_id, concat('N', CAST(user_id % 12 AS VARCHAR)) AS node_name, event_type AS metric, epoch_us(ts) AS us, value FROM events),
k AS (SELECT *, value > 30 AS breach, value < 20 AS quiet, coalesce(lead(us) OVER o, 9000000000000000000) AS next_us,
  sum(CASE WHEN value > 30 THEN 0 ELSE 1 END) OVER o AS breach_run, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER o AS quiet_run
  FROM r WINDOW o AS (PARTITION BY node_name, metric ORDER BY us, event_id)),
runs AS (SELECT node_name, metric, 'raised' AS event, breach_run AS run, min(us) + 4200000000 AS due, arg_max(next_us, struct_pack(a := us, b := event_id)) AS until
  FROM k WHERE breach GROUP BY node_name, metric, breach_run
  UNION ALL SELECT node_name, metric, 'cleared', quiet_run, min(us) + 30000000, arg_max(next_us, struct_pack(a := us, b := event_id)) FROM k WHERE quiet GROUP BY node_name, metric, quiet_run),
reached AS (SELECT * FROM runs WHERE until > due),
turns AS (SELECT *, lag(event) OVER (PARTITION BY node_name, metric ORDER BY due) AS before FROM reached)
SELECT t.node_name, t.metric, make_timestamp(t.due) AS ts, t.event, round(arg_max(k.value, struct_pack(a := k.us, b := k.event_id)), 4) AS value
FROM turns t JOIN k ON k.node_name = t.node_name AND k.metric = t.metric AND k.us <= t.due
WHERE t.event <> coalesce(t.before, 'cleared') GROUP BY t.node_name, t.metric, t.due, t.event""")
def _(t: Tables):
    events, close = _finished_events(t, 1800 + 4200)
    readings = _readings(events).withColumnRenamed("timestamp", "ts")
    found = monitors.sustained_breach_monitor(readings, limit=30.0, clear=20.0, duration_window=3600.0, raise_delay=600.0)
    rows = monitors.run_to_folder(found, "breaches", close=close)
    return rows.select("node_name", "metric", F.col("ts").cast("timestamp_ntz").alias("ts"), "event", F.round("value", 4).alias("value"))


@query("m7_stream_ingest", sql="SELECT concat('doc', CAST(doc_id AS VARCHAR)) AS filename, md5(text) AS content_hash FROM documents")
def _(t: Tables):
    folder = sinks.scratch_folder(t.spark, "ingest")

    def store(rows: DataFrame, path: str, batch: int) -> None:
        sinks.store_documents(rows, partial(text.fixed_chunked, size=2000, overlap=200), path, batch=batch)

    for _ in range(2):  # the second run finds nothing new
        stream = monitors.file_stream(t.spark, f"{t.folder}/documents.parquet", t.raw("documents").schema)
        incoming = stream.select(
            F.col("doc_id").alias("id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), "text"
        )
        monitors.ingest_stream(incoming, folder, store)
    return t.spark.read.parquet(f"{folder}/documents").select("filename", "content_hash")


_FILES = """
files AS (SELECT source, lang, doc_id // 100 AS part, string_agg(coalesce(text, ''), chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY ALL),
named AS (SELECT concat_ws('-', source, lang, CAST(part AS VARCHAR)) AS filename, part, text FROM files)"""


@query("m7_file_versions", sql=f"""
WITH {_FILES}, up AS (SELECT filename, 1 AS n, text || chr(10) AS body FROM named UNION ALL SELECT filename, 2, CASE WHEN part % 2 = 0 THEN text || ' revised' ELSE text END || chr(10) FROM named)
SELECT filename, sha256(arg_max(body, n)) AS content_hash, count(DISTINCT body) AS n_versions, length(arg_max(body, n)) AS indexed_characters FROM up GROUP BY 1""")
def _(t: Tables):
    folder = sinks.scratch_folder(t.spark, "versions")
    docs = t.raw("documents")
    part = F.floor(F.col("doc_id") / 100)
    lines = F.array_sort(F.collect_list(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))))
    files = docs.groupBy("source", "lang", part.alias("part")).agg(F.array_join(F.transform(lines, lambda r: r["text"]), "\n").alias("text"))
    files = files.select(F.concat_ws("-", "source", "lang", F.col("part").cast("string")).alias("filename"), "part", "text")
    revised = F.when(F.col("part") % 2 == 0, F.concat("text", F.lit(" revised"))).otherwise(F.col("text"))

    def cut(rows: DataFrame) -> DataFrame:
        # windows of 1 000 characters that do not overlap
        n = F.ceil(F.length("text") / 1000).cast("int")
        pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring("text", k * 1000 + 1, F.lit(1000)))
        return rows.select("filename", "content_hash", F.posexplode(pieces).alias("chunk_index", "content"))

    for upload, text_now in (("upload-1", F.col("text")), ("upload-2", revised)):
        sinks.write_files(files.select("filename", text_now.alias("text")), f"{folder}/landing/{upload}")
        incoming = monitors.upload_stream(t.spark, f"{folder}/landing")
        monitors.ingest_versions(incoming, f"{folder}/store", cut)
    counts = monitors.versions(t.spark, f"{folder}/store").groupBy("filename").agg(F.count(F.lit(1)).alias("n_versions"))
    chunks = monitors.active_version_chunks(t.spark, f"{folder}/store").groupBy("filename", "content_hash").agg(
        F.sum(F.length("content")).alias("indexed_characters")
    )
    return chunks.join(counts, "filename").select("filename", "content_hash", "n_versions", "indexed_characters")
