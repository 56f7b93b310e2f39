"""Registered queries: sources and sinks, each written to a shared folder and read back."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.operators import forecast, text
from photonwatch.plans.fixtures import AS_OF_TELE, Tables, at
from photonwatch.plans.forecasting import SERIES_SQL, SERIES_VIEWS, _long
from photonwatch.plans.monitoring import rounded
from photonwatch.plans.registry import query
from photonwatch.session import cut_lineage
from photonwatch.sources import sinks, tables

_HISTORY = """SELECT node_name AS "Node", timestamp AS "DateTime", round(aggregated_key_rate, 6) AS "qkdKeyRate" FROM node_metrics"""


def _history(t: Tables) -> DataFrame:
    return rounded(
        t.node_metrics.select(
            F.col("node_name").alias("Node"), F.col("timestamp").alias("DateTime"), F.col("aggregated_key_rate").alias("qkdKeyRate")
        ),
        6,
    )


@query("a1_table_scan", sql="SELECT o_orderstatus, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def _(t: Tables):
    rows = tables.parquet_table(t.spark, t.folder, "orders")
    return rows.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a4_a5_csv_history", views="node_metrics", sql=_HISTORY)
def _(t: Tables):
    folder = sinks.scratch_folder(t.spark, "history")
    sinks.export_rows(_history(t), folder)
    return tables.history(t.spark, "csv", csv_path=folder)


@query("g1_merged_history", views="node_metrics", sql=f"""
SELECT "Node", "DateTime", "qkdKeyRate", CAST(NULL AS VARCHAR) AS origin FROM ({_HISTORY}) UNION ALL SELECT "Node", "DateTime", "qkdKeyRate", 'probe' FROM ({_HISTORY})""")
def _(t: Tables):
    stored = tables.history(t.spark, "database", database=_history(t))
    return tables.merged_history([stored, _history(t).withColumn("origin", F.lit("probe"))])


@query("a12_dated_telemetry", views="node_metrics", sql="""
SELECT node_name, timestamp, round(temperature, 6) AS temperature FROM node_metrics WHERE CAST(timestamp AS DATE) >= DATE '2024-01-25'""")
def _(t: Tables):
    folder = sinks.scratch_folder(t.spark, "telemetry")
    sinks.write_telemetry(t.node_metrics, folder)
    recent = t.spark.read.parquet(folder).filter(F.col("date") >= "2024-01-25")
    return rounded(recent.select("node_name", "timestamp", "temperature"), 6)


@query("a11_incremental_ingest", sql="SELECT doc_id, md5(text) AS content_hash FROM documents WHERE doc_id % 4 = 1")
def _(t: Tables):
    incoming = t.raw("documents").select(
        "doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), F.md5("text").alias("content_hash")
    )
    # the manifest knows three of four files; one of those with an older content
    old = F.when(F.col("doc_id") % 4 == 1, F.md5("filename")).otherwise(F.col("content_hash"))
    manifest = incoming.select("filename", old.alias("content_hash"))
    return sinks.unchanged_skipped(incoming, manifest).select("doc_id", "content_hash")


@query("a8_document_store", sql="""
WITH RECURSIVE parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS ss FROM documents),
pack AS (SELECT doc_id, ss, 0 AS i, '' AS held, CAST(NULL AS VARCHAR) AS out FROM parts
 UNION ALL SELECT doc_id, ss, i + 1,
  CASE WHEN length(held || ' ' || ss[i + 1]) <= CASE WHEN held = '' THEN 513 ELSE 512 END THEN CASE WHEN held = '' THEN ss[i + 1] ELSE held || ' ' || ss[i + 1] END
       ELSE CASE WHEN len(list_filter(regexp_split_to_array(held, '\\s+'), lambda w: w <> '')) > 16
            THEN array_to_string(list_slice(list_filter(regexp_split_to_array(held, '\\s+'), lambda w: w <> ''), -16, -1), ' ') || ' ' ELSE '' END || ss[i + 1] END,
  CASE WHEN length(held || ' ' || ss[i + 1]) > CASE WHEN held = '' THEN 513 ELSE 512 END AND length(held) >= 100 THEN held END
 FROM pack WHERE i < len(ss)),
outs AS (SELECT doc_id, i, out FROM pack WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, held FROM pack WHERE i = len(ss) AND length(held) >= 100),
cut AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, out FROM outs),
per AS (SELECT doc_id, count(*) AS n, CAST(sum(length(out)) AS BIGINT) AS chars, count(e.vec_id) AS vectors FROM cut
  LEFT JOIN embeddings e ON chunk_index = 0 AND e.vec_id = doc_id GROUP BY 1)
SELECT d.doc_id AS id, source AS filename, concat('Document ', CAST(d.doc_id AS VARCHAR)) AS display_name, lang AS language, md5(text) AS content_hash,
 coalesce(n, 0) AS chunk_count, coalesce(n, 0) AS stored_chunks, coalesce(chars, 0) AS stored_length, coalesce(vectors, 0) AS stored_vectors
FROM documents d LEFT JOIN per USING (doc_id)""")
def _(t: Tables):
    folder = sinks.scratch_folder(t.spark, "documents")
    number = F.col("doc_id")
    rows = t.raw("documents").select(
        number.alias("id"),
        F.col("source").alias("filename"),
        F.concat(F.lit("Document "), number.cast("string")).alias("display_name"),
        F.create_map(F.lit("language"), F.col("lang")).alias("metadata"),
        "text",
        F.md5("text").alias("content_hash"),
    )
    # the first chunk of a document takes the vector stored under its number
    known = t.raw("embeddings").select(F.col("vec_id").alias("document_id"), F.lit(0).cast("bigint").alias("chunk_index"), "embedding")

    def embed(chunks: DataFrame) -> DataFrame:
        return chunks.join(known, ["document_id", "chunk_index"], "left")

    for _ in range(2):  # storing the batch again replaces it
        sinks.store_documents(rows, partial(text.chunked, chunker=text.sentence_chunks()), folder, embed)
    kept = t.spark.read.parquet(f"{folder}/document_chunks").groupBy(F.col("document_id").alias("id")).agg(
        F.count(F.lit(1)).alias("stored_chunks"), F.sum("chunk_length").alias("stored_length"), F.count("embedding").alias("stored_vectors")
    )
    sums = [F.coalesce(c, F.lit(0)).alias(c) for c in ("stored_chunks", "stored_length", "stored_vectors")]
    return t.spark.read.parquet(f"{folder}/documents").join(kept, "id", "left").select(
        "id", "filename", "display_name", F.col("metadata")["language"].alias("language"), "content_hash", "chunk_count", *sums
    )


@query("a13_model_store", views=SERIES_VIEWS, sql=f"""
WITH {SERIES_SQL} SELECT node_name, metric, count(*) AS points, TIMESTAMP '{AS_OF_TELE}' + CASE WHEN metric = 'qkdQber' THEN INTERVAL '1' DAY ELSE INTERVAL '0' DAY END AS trained_at
FROM long GROUP BY 1, 2 HAVING count(*) >= CASE WHEN metric = 'qkdKeyRate' THEN {forecast.MIN_POINTS_KEY_RATE} ELSE {forecast.MIN_POINTS} END AND max(timestamp) > min(timestamp)""")
def _(t: Tables):
    folder = sinks.scratch_folder(t.spark, "models")
    models = cut_lineage(forecast.fit_models(_long(t)))
    sinks.save_models(models, folder, at(AS_OF_TELE))
    # fitted again a day later for one metric: the others stay
    sinks.save_models(models.filter("metric = 'qkdQber'"), folder, at(AS_OF_TELE) + F.expr("interval 1 day"))
    stored = sinks.load_models(t.spark, folder)
    return stored.select("node_name", "metric", "points", "trained_at")
