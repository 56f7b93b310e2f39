"""Sinks: telemetry, documents, models, exports; incremental ingest."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonwatch.session import settings, shared_folder


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder every executor can reach."""
    return f"{shared_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a table in the shared folder: smaller than a checkpoint, read by column, and of known size."""
    folder = scratch_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_telemetry(df: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Telemetry partitioned by date, so that look-back windows prune folders.

    Rows are rebalanced by date: a busy day becomes as many files as its size
    asks for, quiet days share a task.
    """
    dated = df.withColumn("date", F.col(ts).cast("date"))
    dated.hint("rebalance", "date").write.mode(mode).partitionBy("date").parquet(path)


def export_rows(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def store_documents(
    documents: DataFrame,
    cut: Callable[..., DataFrame],
    path: str,
    embed: Callable[[DataFrame], DataFrame] | None = None,
    batch: int = 0,
) -> None:
    """Documents and their chunks as two tables under ``path``: documents and document_chunks.

    ``documents``: id, filename, text, content_hash, and display_name and
    metadata (a map) if there are any.  ``cut`` takes a frame and the name of its
    ``key``, and gives its chunks; ``embed`` adds their ``embedding``.  Rows are
    written under the number of the batch, so storing a batch again replaces it.
    """
    chunks = cut(documents.withColumnRenamed("id", "document_id"), key="document_id")
    if embed is not None:
        chunks = embed(chunks)
    place = f"{path}/document_chunks/batch={batch}"
    chunks.write.mode("overwrite").parquet(place)
    own = documents.sparkSession.read.schema(chunks.schema).parquet(place)
    counts = own.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("chunk_count"))
    given = [c for c in ("display_name", "metadata") if c in documents.columns]
    (
        documents.join(counts, "id", "left")
        .select(
            "id", "filename", *given, "content_hash", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit("active").alias("status")
        )
        .write.mode("overwrite")
        .parquet(f"{path}/documents/batch={batch}")
    )


#: What Spark writes as %XX in the name of a partition's folder, and the folder of names that are null or empty.
_ESCAPED = {c: f"%{c:02X}" for c in [*range(1, 32), 127, *map(ord, "\"#%'*/:=?\\{[]^")]}
_NO_NAME = "__HIVE_DEFAULT_PARTITION__"


def write_files(files: DataFrame, path: str) -> None:
    """Each row's ``text`` as a text file ``path``/<filename>/<part>: for landing zones and exports of whole files.

    Spark's writer takes some milliseconds a file on a file system of folders: for each it starts
    programs that set its rights, writes a file of checksums and moves it from the driver.  There tasks
    write the same files themselves; other stores are left to Spark.
    """
    files, spark = files.select("filename", "text"), files.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.getUri().getScheme() != "file":
        files.write.partitionBy("filename").text(path)
        return
    folder = place.toUri().getPath()
    if os.path.exists(folder):
        raise FileExistsError(f"{path} already exists")
    hidden = f"{folder}/_temporary"  # readers of ``path`` skip it
    os.makedirs(hidden)
    # rows of a task that share a name make one file
    name = F.coalesce(F.nullif("filename", F.lit("")), F.lit(_NO_NAME)).alias("filename")
    rows = files.select(name, F.col("text").cast("binary").alias("text")).sortWithinPartitions("filename")
    with settings(spark, {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        rows.mapInArrow(_write_into(hidden), "filename string").write.format("noop").mode("overwrite").save()
    for name in os.listdir(hidden):
        os.rename(f"{hidden}/{name}", f"{folder}/{name}")
    os.rmdir(hidden)
    open(f"{folder}/_SUCCESS", "wb").close()


def _write_into(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = f"part-{TaskContext.get().partitionId():05d}", ((n.as_py(), t.as_py()) for b in batches for n, t in zip(*b.columns))
        for name, same in groupby(rows, key=lambda row: row[0]):
            own = f"{folder}/filename={name.translate(_ESCAPED)}"
            os.makedirs(own, exist_ok=True)
            # written aside, so that a task that runs twice never leaves half a file
            aside = f"{own}/.{part}-{uuid.uuid4().hex}"
            with open(aside, "wb") as out:
                out.writelines((text or b"") + b"\n" for _, text in same)
            os.replace(aside, f"{own}/{part}.txt")
        yield from ()

    return run


def unchanged_skipped(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose (name, content hash) is not in the manifest yet."""
    return incoming.join(manifest.select("filename", "content_hash"), ["filename", "content_hash"], "left_anti")


def save_models(models: DataFrame, path: str, trained_at, keys: Sequence[str] = ("node_name", "metric")) -> None:
    """Model table with its training time, one folder per key: models of the given keys are replaced, others stay.

    Folders are named by copies of the keys, so the keys themselves keep their types (a node ``0012`` stays text).
    """
    dated = models.withColumns({"trained_at": trained_at} | {f"_of_{k}": F.col(k) for k in keys})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*[f"_of_{k}" for k in keys]).parquet(path)


def load_models(spark: SparkSession, path: str) -> DataFrame:
    models = spark.read.parquet(path)
    return models.drop(*[c for c in models.columns if c.startswith("_of_")])
