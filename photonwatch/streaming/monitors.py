"""Streams: threshold rules, tumbling means, joins in time, keyed monitors."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from photonwatch.functions.rules import Limit
from photonwatch.operators.anomaly import violations
from photonwatch.session import settings
from photonwatch.sources.sinks import scratch_folder, unchanged_skipped


def file_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files (one file or a folder of them) as a stream of bounded batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path + "*")


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Zone-free times become zoned ones (session zone UTC) and carry the watermark."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_to_folder(stream: DataFrame, purpose: str, mode: str = "append", close: Callable[[], None] | None = None) -> DataFrame:
    """Process everything available, write it to a new shared folder, and read that.

    ``close``, if given, is called when all is processed; the run then goes on
    from its progress with what that has added to the source.
    """
    spark = stream.sparkSession
    folder = scratch_folder(spark, purpose)
    schema = stream.schema
    for before in [None] if close is None else [None, close]:
        if before is not None:
            before()
        query = (
            stream.writeStream.outputMode(mode)
            .format("parquet")
            .option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


def closable(stream: DataFrame, closing: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """``stream`` of a finished source, and a function that adds the batch ``closing`` behind all its rows.

    The row of a closing batch moves the watermark past the last row and the
    longest wait.  It lies later than the watermark that it brings about, so a
    keyed monitor holds it for ever and no result shows it, whatever its key.
    """
    spark = stream.sparkSession
    folder = f"{scratch_folder(spark, 'closing')}/rows"
    spark.createDataFrame([], stream.schema).write.parquet(folder)
    both = stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder))
    return both, lambda: closing.select(*stream.columns).write.mode("append").parquet(folder)


def live_violations(readings: DataFrame, keys: Sequence[str], limits: Sequence[Limit]) -> DataFrame:
    """Broken limits of a stream of readings; stateless."""
    return violations(readings, keys, limits)


RULES = "metric string, kind string, threshold double, version long"


def write_rules(rules: DataFrame, path: str) -> None:
    """Add the rule table (metric, kind: max or min, threshold) that holds from the next batch on.

    Every table is one version, written as one file, so readers see all of it or
    nothing; old versions stay for batches that are tried again.
    """
    spark = rules.sparkSession
    rules.sparkSession.createDataFrame([], RULES).write.mode("append").parquet(path)
    last = spark.read.schema(RULES).parquet(path).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
    rules.select("metric", "kind", "threshold", F.lit(last + 1).cast("bigint").alias("version")).coalesce(1).write.mode("append").parquet(path)


def broken_rules(readings: DataFrame, keys: Sequence[str], rules: DataFrame) -> DataFrame:
    """One row per reading (``keys``, metric, value) and rule of its metric that it breaks."""
    over, under = F.col("value") > F.col("threshold"), F.col("value") < F.col("threshold")
    broken = F.when(F.col("kind") == "max", over).otherwise(under)
    kind = F.when(F.col("kind") == "max", "exceeds").otherwise("below")
    return readings.join(rules, "metric").filter(broken).select(*keys, "metric", "value", "threshold", kind.alias("type"))


def ruled_violations(readings: DataFrame, keys: Sequence[str], rules_path: str, folder: str) -> DataFrame:
    """Readings of a stream that break a rule of the table under ``rules_path``.

    The table is read anew for every batch, so a rule that is changed, added or
    dropped while the stream runs holds from the next batch on.  A batch writes
    down which version it goes by before it begins, so one that is tried again
    gives the same rows, which replace its first ones.
    """
    spark = readings.sparkSession

    def judged(rows: DataFrame, batch: int) -> None:
        noted = f"{folder}/versions/batch={batch}"
        try:
            version = spark.read.schema("version long").parquet(noted).first()["version"]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            version = spark.read.schema(RULES).parquet(rules_path).agg(F.max("version")).first()[0]
            spark.createDataFrame([(version,)], "version long").write.mode("overwrite").parquet(noted)
        rules = spark.read.schema(RULES).parquet(rules_path).filter(F.col("version") == version).drop("version")
        broken_rules(rows, keys, rules).withColumn("version", F.lit(version).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}")

    query = (
        readings.writeStream.foreachBatch(judged)
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


#: Length and step of the windows that a chart of live means offers.
PRESETS = {"1h": ("1 hour", "15 minutes"), "24h": ("24 hours", "1 hour"), "7d": ("7 days", "1 day")}


def preset_means(readings: DataFrame, preset: str, size: str = "15 minutes") -> DataFrame:
    """Means over long sliding windows, made from sums of short ones: preset, start, end, node_name, metric, mean, points.

    Two aggregations in event time follow each other in one append query: rows
    meet in windows of ``size``, whose sums go on to every long window they lie
    in when the watermark closes them.  So a week's window holds sums, not rows,
    and a row is copied to no window but its own short one.  Each preset is a
    stream of its own: a union of such chains over one source loses rows of all but the first.
    """
    length, step = PRESETS[preset]
    short = readings.groupBy(F.window("timestamp", size).alias("w"), "node_name", "metric").agg(
        F.sum("value").alias("total"), F.count("value").alias("points")
    )
    long = short.groupBy(F.window(F.window_time("w"), length, step).alias("w"), "node_name", "metric").agg(
        (F.sum("total") / F.sum("points")).alias("mean"), F.sum("points").alias("points")
    )
    return long.select(F.lit(preset).alias("preset"), "w.start", "w.end", "node_name", "metric", "mean", "points")


def tumbling_means(readings: DataFrame, size: str = "15 minutes", slide: str | None = None) -> DataFrame:
    """Mean per window, node and metric; windows close when the watermark passes their end."""
    window = F.window("timestamp", size, slide) if slide else F.window("timestamp", size)
    return (
        readings.groupBy(window.alias("w"), "node_name", "metric")
        .agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("points"))
        .select("w.start", "w.end", "node_name", "metric", "mean", "points")
    )


def _minute(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 60_000_000)


def near_in_time(node_rows: DataFrame, link_rows: DataFrame) -> DataFrame:
    """Pairs of node and link readings of one node less than 60 seconds apart.

    Joined on (node, minute) with the link side in three minutes, so that the
    state of a busy node is spread over its minutes.  Both inputs carry
    watermarks on ``node_time`` and ``link_time``; state is dropped after them.
    """
    left = node_rows.withColumn("_m", _minute(F.col("node_time"))).withColumnRenamed("node_name", "_n")
    minute = _minute(F.col("link_time"))
    right = link_rows.withColumn("_k", F.explode(F.array(minute - 1, minute, minute + 1)))
    close = F.expr("link_time > node_time - interval 60 seconds and link_time < node_time + interval 60 seconds")
    same = (F.col("_n") == F.col("node_name")) & (F.col("_m") == F.col("_k"))
    return left.join(right, same & close).drop("_n", "_m", "_k")


# -- keyed monitors in event time ------------------------------------------------
#
# Rows are held until the watermark has passed them, so the order in which files
# or batches bring them does not matter, and a timer wakes the key when its next
# held row or deadline is due.  A key's state holds the rows of one watermark
# delay at most, besides those of the batch that brings them.


def _release(parts: Iterator[pd.DataFrame], held: Sequence, columns: Sequence[str], upto: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (microseconds, event_id, columns) up to a moment, in order, and the later ones."""
    rows = list(zip(*held))
    for part in parts:
        micros = part["ts"].astype("datetime64[us]").astype("int64")
        rows += zip(micros.tolist(), part["event_id"].tolist(), *(part[c].tolist() for c in columns))
    rows.sort(key=lambda row: row[:2])
    cut = bisect_right(rows, upto, key=lambda row: row[0])
    return rows[:cut], rows[cut:]


def _columns(rows: list[tuple], width: int) -> list[list]:
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(width)]


def _wake(state: GroupState, moments: list[int]) -> None:
    if moments:
        state.setTimeoutTimestamp(max(min(moments) // 1000, state.getCurrentWatermarkMs() + 1))


def _moment(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros, unit="us")


CHANGES = "service_id bigint, event_id bigint, ts timestamp, state string, elapsed double, kind string"


def state_change_monitor(log: DataFrame, max_wait: float = 60.0) -> DataFrame:
    """Changes of a service's state, and a timeout row if no terminal state came in time.

    ``log``: service_id, event_id, ts (watermarked), state.  The timeout row has
    the state at the deadline.
    """
    wait = int(max_wait * 1e6)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, last, done, *held = state.get if state.exists else (None, None, False, [], [], [])
        passed = state.getCurrentWatermarkMs() * 1000
        due, later = _release(parts, held, ["state"], passed)
        out = []

        def add(event_id: int, at: int, what: str, kind: str) -> None:
            out.append((int(key[0]), event_id, _moment(at), what, (at - begin) / 1e6, kind))

        def expire(before: int) -> bool:
            late = not done and begin is not None and begin + wait < before
            if late:
                add(-1, begin + wait, last, "timeout")
            return done or late

        for at, event_id, new in due:
            done = expire(at)
            begin = at if begin is None else begin
            if new != last:
                add(event_id, at, new, "change")
            last = new
            done = done or (new in ("active", "failed") and at - begin < wait)
        done = expire(passed)
        state.update((begin, last, done, *_columns(later, 3)))
        _wake(state, [row[0] for row in later[:1]] + ([] if begin is None or done else [begin + wait]))
        yield pd.DataFrame(out, columns=["service_id", "event_id", "ts", "state", "elapsed", "kind"])

    return log.groupBy("service_id").applyInPandasWithState(
        step,
        CHANGES,
        "begin long, last string, done boolean, at array<long>, event array<long>, state array<string>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


LOCKS = "user_id bigint, locked_at timestamp, failures bigint"


def lockout_monitor(logins: DataFrame, limit: int = 5) -> DataFrame:
    """A row when a user's failures since the last success reach ``limit``.

    ``logins``: event_id, user_id, ts (watermarked), success.  A user without
    open failures and held rows leaves no state.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, *held = state.get if state.exists else (0, [], [], [])
        due, later = _release(parts, held, ["success"], state.getCurrentWatermarkMs() * 1000)
        out = []
        for at, _, success in due:
            failures = 0 if success else failures + 1
            if failures == limit:
                out.append((int(key[0]), _moment(at), failures))
        if failures or later:
            state.update((failures, *_columns(later, 3)))
            _wake(state, [row[0] for row in later[:1]])
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "locked_at", "failures"])

    return logins.groupBy("user_id").applyInPandasWithState(
        step,
        LOCKS,
        "failures long, at array<long>, event array<long>, success array<boolean>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


BREACHES = "node_name string, metric string, ts timestamp, event string, value double"


def sustained_breach_monitor(
    readings: DataFrame, limit: float, clear: float, duration_window: float, raise_delay: float = 0.0, rising: bool = True, clear_hold: float = 30.0
) -> DataFrame:
    """``raised`` when a breach has lasted for the window plus the delay, ``cleared`` when values
    have kept to the clear condition for ``clear_hold`` seconds.

    ``readings``: event_id, node_name, metric, ts (watermarked), value; times in
    seconds.  Both events come at the very moment, by a timer where no reading
    follows, with the last value up to then.
    """
    hold, quiet_hold = int((duration_window + raise_delay) * 1e6), int(clear_hold * 1e6)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, calm, raised, value, *held = state.get if state.exists else (None, None, False, None, [], [], [])
        passed = state.getCurrentWatermarkMs() * 1000
        due, later = _release(parts, held, ["value"], passed)
        out = []

        def deadline() -> int | None:
            start, length = (calm, quiet_hold) if raised else (since, hold)
            return None if start is None else start + length

        for at, _, new in [*due, (None, None, None)]:
            # what falls due before this reading, or up to the watermark after the last one
            while (moment := deadline()) is not None and (moment < at if at is not None else moment <= passed):
                out.append((*key, _moment(moment), "cleared" if raised else "raised", value))
                raised = not raised
            if at is None:
                break
            value = new
            since = (at if since is None else since) if (new > limit if rising else new < limit) else None
            calm = (at if calm is None else calm) if (new < clear if rising else new > clear) else None
        state.update((since, calm, raised, value, *_columns(later, 3)))
        _wake(state, [row[0] for row in later[:1]] + [m for m in [deadline()] if m is not None])
        yield pd.DataFrame(out, columns=["node_name", "metric", "ts", "event", "value"])

    return readings.groupBy("node_name", "metric").applyInPandasWithState(
        step,
        BREACHES,
        "since long, calm long, raised boolean, last double, at array<long>, event array<long>, value array<double>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def upload_stream(spark: SparkSession, path: str, bytes_per_trigger: int = 256 * 2**20) -> DataFrame:
    """Files of any kind under ``path``/<upload>/filename=<name>/ as a stream: filename, uploaded_at, upload, content.

    A file that changes comes again as part of a later upload.  Only uploads are
    matched by name; their folders, one per file, are listed by tasks.  A batch is
    bounded by what it holds: by their number, small files make very many batches.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxBytesPerTrigger", bytes_per_trigger)
    names = F.split("path", "/")
    return files.option("recursiveFileLookup", True).load(f"{path}/*").select(
        F.regexp_replace(F.element_at(names, -2), "^filename=", "").alias("filename"), F.col("modificationTime").alias("uploaded_at"),
        F.element_at(names, -3).alias("upload"), "content",
    )


def ingest_versions(incoming: DataFrame, path: str, cut: Callable[[DataFrame], DataFrame]) -> None:
    """Store every version of the files of a stream, and the chunks of each.

    ``incoming``: filename, uploaded_at, upload, content.  A version is a (filename,
    content_hash); ``cut`` gives chunks (filename, content_hash, chunk_index,
    content) of a frame with ``text``.  Versions of a batch go to its own folder,
    so one that is tried again replaces itself.  Nothing is looked up in what is
    stored: which version is active follows from the order of uploads, in
    :func:`versions`, so batches never wait for one another.
    """

    def batch(rows: DataFrame, number: int) -> None:
        read = rows.select(
            "filename", "uploaded_at", "upload", F.sha2("content", 256).alias("content_hash"), F.decode("content", "UTF-8").alias("text")
        )
        read.drop("text").write.mode("overwrite").parquet(f"{path}/versions/batch={number}")
        cut(read.dropDuplicates(["filename", "content_hash"])).write.mode("overwrite").parquet(f"{path}/chunks/batch={number}")

    # counted as 4 MB each, small files would be read by thousands of tasks
    with settings(incoming.sparkSession, {"spark.sql.files.openCostInBytes": "64k"}):
        query = (
            incoming.writeStream.foreachBatch(batch)
            .option("checkpointLocation", f"{path}/progress")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def versions(spark: SparkSession, path: str) -> DataFrame:
    """Stored versions with the time they are valid: filename, content_hash, valid_from, valid_to (null: active).

    Uploads of a file count in the order of their times, then of their names; one
    with the content of the one before is no new version.  A content that comes
    back later is a version of its own.
    """
    seen = spark.read.parquet(f"{path}/versions")
    order = Window.partitionBy("filename").orderBy("uploaded_at", "upload")
    changed = seen.withColumn("_before", F.lag("content_hash").over(order)).filter(~F.col("_before").eqNullSafe(F.col("content_hash")))
    return changed.select("filename", "content_hash", F.col("uploaded_at").alias("valid_from"), F.lead("uploaded_at").over(order).alias("valid_to"))


def active_version_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of active versions alone: those of a replaced version have left the index."""
    active = versions(spark, path).filter("valid_to is null").select("filename", "content_hash")
    chunks = spark.read.parquet(f"{path}/chunks").drop("batch").join(active, ["filename", "content_hash"], "left_semi")
    return chunks.dropDuplicates(["filename", "content_hash", "chunk_index"])


def ingest_stream(incoming: DataFrame, path: str, store: Callable[[DataFrame, str, int], None]) -> None:
    """Store new documents of a stream; known (name, content) pairs are skipped.

    ``incoming``: filename, text.  ``store`` gets a batch, ``path`` and the batch's
    number, and writes ``filename`` and ``content_hash`` to the table ``documents``
    under ``path``, in a folder ``batch=<number>``.  Progress is kept under
    ``path``: a restart goes on where it stopped, and a batch that is tried again
    is compared with the other batches only and replaces itself.
    """
    spark = incoming.sparkSession

    def batch(rows: DataFrame, number: int) -> None:
        hashed = rows.withColumn("content_hash", F.md5("text")).dropDuplicates(["filename", "content_hash"])
        try:
            manifest = spark.read.parquet(f"{path}/documents").filter(F.col("batch") != number)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            hashed = unchanged_skipped(hashed, manifest)
        store(hashed, path, number)

    query = (
        incoming.writeStream.foreachBatch(batch)
        .option("checkpointLocation", f"{path}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
