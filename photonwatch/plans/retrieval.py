"""Registered queries: keyword, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.operators import hybrid, keyword, vectors
from photonwatch.plans.fixtures import Tables
from photonwatch.plans.registry import query
from photonwatch.sources.sinks import scratch_folder

_VIEWS = "chunks library questions"



def _with(text: str, **values) -> str:
    """Fill named gaps; other braces (patterns) stay."""
    for name, value in values.items():
        text = text.replace("{" + name + "}", str(value))
    return text


_TOKENS = (
    "list_filter(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'), "
    "lambda w: regexp_full_match(w, '[a-z0-9]+') AND (length(w) > 1 OR w IN ('a', 'i')))"
)

_BM25 = f"""
active AS (SELECT c.* FROM chunks c JOIN library y ON y.filename = c.filename AND y.status = 'active'),
toks AS (SELECT id, {_TOKENS.format(c='content')} AS t FROM active),
docs AS (SELECT id, len(t) AS dl FROM toks),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
tf AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest(t) AS token FROM toks) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
raw AS (SELECT token, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, tot),
idf AS (SELECT token, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT query_id, unnest({_TOKENS.format(c='query')}) AS token FROM questions),
scores AS (SELECT q.query_id, tf.id, round(sum(i.idf * tf.tf * 2.5 / (tf.tf + 1.5 * (0.25 + 0.75 * d.dl / tot.avgdl))), 9) AS score
  FROM qt q JOIN tf ON tf.token = q.token JOIN idf i ON i.token = q.token JOIN docs d ON d.id = tf.id, tot GROUP BY 1, 2),
kw AS (SELECT query_id, id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank
  FROM scores WHERE score > 0) WHERE rank <= {{k}})"""

_DIST = "list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_QVEC = "qvec AS (SELECT s.query_id, e.embedding FROM questions s JOIN embeddings e ON e.vec_id = s.query_id)"
_VEC = f"""
{_QVEC},
near AS (SELECT query_id, id, distance, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM
 (SELECT q.query_id, v.id, round({_DIST}, 9) AS distance FROM qvec q, ({{source}}) v)) WHERE rank <= {{k}})"""
_ACTIVE_VECTORS = "SELECT id, embedding FROM active WHERE embedding IS NOT NULL"

_FUSED = f"""
{_with(_BM25, k=150)}, {_with(_VEC, source=_ACTIVE_VECTORS, k=50)},
fused AS (SELECT query_id, id, k.rank AS keyword_rank, n.rank AS vector_rank,
  round(coalesce(1.0::DOUBLE / (k.rank + 60), 0) + coalesce(1.0::DOUBLE / (n.rank + 60), 0), 9) AS rrf_score
  FROM kw k FULL JOIN near n USING (query_id, id)),
hits AS (SELECT query_id, id, filename, chunk_index, content, keyword_rank, vector_rank, rrf_score, rank FROM
 (SELECT f.*, a.filename, a.chunk_index, a.content, CAST(row_number() OVER (PARTITION BY f.query_id ORDER BY f.rrf_score DESC, f.id) AS INTEGER) AS rank
  FROM fused f JOIN active a ON a.id = f.id) WHERE rank <= {{k}})"""


def _active(t: Tables) -> DataFrame:
    return keyword.active_chunks(t.chunks, t.library)


def _index(t: Tables) -> keyword.Index:
    """The keyword index, stored and read back."""
    folder = scratch_folder(t.spark, "keyword-index")
    keyword.write_index(keyword.build_index(_active(t)), folder)
    return keyword.read_index(t.spark, folder)


def _cells(t: Tables, stored: DataFrame):
    """The vector index, stored and read back."""
    folder = scratch_folder(t.spark, "vector-index")
    centres = vectors.fit_cells(stored)
    vectors.write_cells(vectors.in_cells(stored, centres, "id"), centres, folder)
    return vectors.read_cells(t.spark, folder)


def _asked(t: Tables) -> DataFrame:
    """Questions with the vector stored under the same number."""
    stored = t.raw("embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return t.questions.join(stored, "query_id", "left")


def _vectors(t: Tables) -> DataFrame:
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _hits(t: Tables, k: int) -> DataFrame:
    return hybrid.search(_index(t), t.chunks, t.library, _asked(t), k)


@query("a6_active_chunks", views="chunks library", sql="""
SELECT c.id, c.filename, c.chunk_index, length(c.content) AS chunk_length FROM chunks c JOIN library y ON y.filename = c.filename WHERE y.status = 'active'""")
def _(t: Tables):
    return _active(t).select("id", "filename", "chunk_index", F.length("content").cast("bigint").alias("chunk_length"))


@query("a7_decoded_vectors", sql="""
SELECT vec_id AS id, len(embedding) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 5) AS total FROM embeddings WHERE vec_id % 10 <> 3""")
def _(t: Tables):
    # stored as JSON text; every tenth text is cut off in the middle and must be skipped
    text = F.to_json("embedding")
    stored = _vectors(t).select("id", F.when(F.col("id") % 10 == 3, F.substring(text, 1, 40)).otherwise(text).alias("embedding"))
    good = vectors.decoded(stored, "embedding")
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return good.select("id", F.size("embedding").cast("bigint").alias("dims"), F.round(total, 5).alias("total"))


@query("a7_metadata", sql="""
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events""")
def _(t: Tables):
    broken = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    return t.raw("events").select("event_id", F.try_element_at(vectors.decoded_metadata(broken), F.lit("k")).alias("k"))


@query("j1_tokens", views="chunks", sql=f"SELECT id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT id, {_TOKENS.format(c='content')} AS t FROM chunks)")
def _(t: Tables):
    words = t.chunks.select("id", keyword.tokens("content").alias("t"))
    return words.select("id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("j2_term_statistics", views=_VIEWS, sql=f"WITH {_with(_BM25, k=1)} SELECT token, df, round(idf, 9) AS idf FROM idf")
def _(t: Tables):
    return _index(t).terms.select("token", "df", F.round("idf", 9).alias("idf"))


@query("j3_f3_bm25_search", views=_VIEWS, sql=f"WITH {_with(_BM25, k=10)} SELECT query_id, id, round(score, 6) AS score, rank FROM kw")
def _(t: Tables):
    hits = keyword.bm25_search(_index(t), t.questions, 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("j4_nearest_vectors", views="questions", sql=f"""
WITH {_with(_VEC, source='SELECT vec_id AS id, embedding FROM embeddings', k=10)}
SELECT query_id, id, round(1 / (1 + distance), 6) AS similarity, rank FROM near""")
def _(t: Tables):
    asked = _asked(t).filter(F.col("embedding").isNotNull())
    near = vectors.nearest(_vectors(t), asked, 10)
    return near.select("query_id", "id", F.round(vectors.similarity(), 6).alias("similarity"), "rank")


# with at most 32 cells every cell is probed, so the search is exact on the checked data
@query("j5_cell_search", views="questions", sql=f"""
WITH {_with(_VEC, source='SELECT vec_id AS id, embedding FROM embeddings', k=10)}
SELECT query_id, id, round(1 / (1 + distance), 6) AS similarity, rank FROM near""")
def _(t: Tables):
    celled, centres = _cells(t, _vectors(t))
    asked = _asked(t).filter(F.col("embedding").isNotNull())
    near = vectors.nearest_in_cells(celled, centres, asked, 10)
    return near.select("query_id", "id", F.round(vectors.similarity(), 6).alias("similarity"), "rank")


@query("j5_recall_of_few_cells", views="questions", sql="""
SELECT count(*) AS queries, true AS fewer_probes_than_cells, true AS recall_reached FROM questions q JOIN embeddings e ON e.vec_id = q.query_id""")
def _(t: Tables):
    # three of four cells, against all vectors: what of the ten nearest is found
    celled, centres = _cells(t, _vectors(t))
    asked = _asked(t).filter(F.col("embedding").isNotNull())
    probe = max(1, len(centres) * 3 // 4)
    found = vectors.nearest_in_cells(celled, centres, asked, 10, probe).select("query_id", "id", F.lit(1).alias("hit"))
    exact = vectors.nearest(_vectors(t), asked, 10).select("query_id", "id")
    share = exact.join(found, ["query_id", "id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    reached = share.select((F.col("recall") >= 0.9).alias("recall_reached")).scalar()
    return asked.agg(F.count(F.lit(1)).alias("queries")).select(
        "queries", F.lit(probe < len(centres)).alias("fewer_probes_than_cells"), reached.alias("recall_reached")
    )


_COS = """list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda z: z[1] * z[2]))
 / sqrt(list_sum(list_transform(CAST(v.embedding AS DOUBLE[]), lambda z: z * z)) * list_sum(list_transform(CAST(q.embedding AS DOUBLE[]), lambda z: z * z)))"""


@query("j6_c14_cosine_search", views=_VIEWS, sql=f"""
WITH {_QVEC}, pool AS (SELECT c.* FROM chunks c JOIN library y ON y.filename = c.filename AND y.status = 'active'
  WHERE c.filename = 'src4' AND c.embedding IS NOT NULL)
SELECT query_id, id, filename, chunk_index, round(similarity, 6) AS similarity, CAST(rank AS INTEGER) AS rank FROM
(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - similarity, 9), id) AS rank FROM
 (SELECT q.query_id, v.id, v.filename, v.chunk_index, {_COS} AS similarity FROM qvec q, pool v)) WHERE rank <= 5""")
def _(t: Tables):
    pool = keyword.active_chunks(t.chunks, t.library, "src4").filter(F.col("embedding").isNotNull())
    asked = _asked(t).filter(F.col("embedding").isNotNull())
    near = vectors.nearest(pool.select("id", "embedding"), asked, 5, metric="cosine")
    shown = near.join(pool.select("id", "filename", "chunk_index"), "id")
    similarity = F.round(vectors.similarity(metric="cosine"), 6)
    return shown.select("query_id", "id", "filename", "chunk_index", similarity.alias("similarity"), "rank")


@query("j7_g3_candidate_overlap", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=10)} SELECT query_id, count(*) FILTER (WHERE vector_rank IS NULL) AS keyword_only,
 count(*) FILTER (WHERE keyword_rank IS NULL) AS vector_only, count(*) FILTER (WHERE keyword_rank IS NOT NULL AND vector_rank IS NOT NULL) AS both,
 count(*) AS total FROM fused GROUP BY 1""")
def _(t: Tables):
    pool = _active(t).filter(F.col("embedding").isNotNull()).select("id", "embedding")
    return hybrid.overlap(hybrid.candidates(_index(t), pool, _asked(t)))


@query("j7_j8_hybrid_search", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=10)} SELECT query_id, id, filename, chunk_index, keyword_rank, vector_rank, rrf_score, rank FROM hits""")
def _(t: Tables):
    return _hits(t, 10).select("query_id", "id", "filename", "chunk_index", "keyword_rank", "vector_rank", "rrf_score", "rank")


@query("j8_filtered_hybrid_search", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=10)}, few AS (SELECT f.query_id, f.id, f.rrf_score, row_number() OVER (PARTITION BY f.query_id ORDER BY f.rrf_score DESC, f.id) AS r
 FROM fused f JOIN active a ON a.id = f.id AND a.filename = 'src4') SELECT query_id, id, rrf_score, CAST(r AS INTEGER) AS rank FROM few WHERE r <= 5""")
def _(t: Tables):
    hits = hybrid.search(_index(t), t.chunks, t.library, _asked(t), 5, filename="src4")
    return hits.select("query_id", "id", "rrf_score", "rank")


@query("j9_rerank_blend", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=40)}, b AS (SELECT query_id, id, CASE WHEN rank <= 30 THEN round(0.8 * ((id * 37 % 101) / 101.0::DOUBLE) + 0.2 * rrf_score, 9) ELSE rrf_score END AS final_score FROM hits)
SELECT query_id, id, final_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, id) AS INTEGER) AS rank FROM b""")
def _(t: Tables):
    scored = _hits(t, 40).withColumn("given", (F.col("id") * 37 % 101) / 101.0)
    return hybrid.rerank(scored, "given").select("query_id", "id", "final_score", "rank")


@query("j10_header_rerank", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=8)}, b AS (SELECT query_id, id, round(rrf_score * CASE chunk_index % 3 WHEN 0 THEN 1.2 WHEN 1 THEN 0.9 ELSE 1.0 END, 9) AS adjusted_score FROM hits WHERE rank <= 5)
SELECT query_id, id, adjusted_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY adjusted_score DESC, id) AS INTEGER) AS rank FROM b""")
def _(t: Tables):
    place = F.col("chunk_index") % 3
    header = F.when(place == 0, "Rack Mounting").when(place == 1, "General remarks").otherwise("Safety")
    hits = _hits(t, 8).withColumn("section_header", header)
    return hybrid.header_rerank(hits, "rrf_score", "section_header").select("query_id", "id", "adjusted_score", "rank")


@query("d37_confidence", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=10)} SELECT q.query_id, round(least(0.95, greatest(0.1, coalesce(avg(h.rrf_score), 0.1))), 6) AS confidence
FROM questions q LEFT JOIN hits h ON h.query_id = q.query_id GROUP BY 1""")
def _(t: Tables):
    return hybrid.confidence(_hits(t, 10).select("query_id", "rrf_score"), t.questions)


@query("j11_context", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=3)} SELECT query_id, string_agg(printf('**Context Section %d:**' || chr(10) || '- Source: %s' || chr(10) || '- Chunk: #%d' || chr(10)
 || '- RRF Score: %.3f' || chr(10) || '- Content: %s' || chr(10), rank, filename, chunk_index, rrf_score, trim(content)), chr(10) ORDER BY rank) AS context
FROM hits GROUP BY 1""")
def _(t: Tables):
    return hybrid.context(_hits(t, 3))


@query("j12_citations", views=_VIEWS, sql=f"""
WITH {_with(_FUSED, k=20)}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, filename ORDER BY rank) AS i, count(*) OVER (PARTITION BY query_id, filename) AS n FROM hits)
SELECT query_id, replace(replace(filename, '.pdf', ''), '_', ' ') AS document,
 CASE WHEN max(n) = 1 THEN 'Chunk ' ELSE 'Chunks ' END || string_agg('#' || CAST(chunk_index AS VARCHAR), ', ' ORDER BY rank) FILTER (WHERE i <= 3)
 || CASE WHEN max(n) > 3 THEN ' (+' || CAST(max(n) - 3 AS VARCHAR) || ' more)' ELSE '' END AS chunks_cited
FROM r GROUP BY query_id, filename""")
def _(t: Tables):
    return hybrid.citations(_hits(t, 20))


@query("j13_index_report", views=_VIEWS, sql=f"""
WITH {_with(_BM25, k=1)} SELECT (SELECT n FROM tot) AS indexed_chunks, (SELECT count(*) FROM df) AS terms, (SELECT count(*) FROM tf) AS postings,
 (SELECT count(*) FROM active WHERE embedding IS NOT NULL) AS indexed_vectors""")
def _(t: Tables):
    stored = _active(t).filter(F.col("embedding").isNotNull()).select("id", "embedding")
    celled, _ = _cells(t, stored)
    return hybrid.index_report(_index(t), celled).drop("cells")
