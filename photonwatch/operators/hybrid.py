"""Fusion of keyword and vector results, reranking, context and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.operators import keyword, vectors
from photonwatch.sources.sinks import stored

RRF = 60  # fixed value: reciprocal rank constant
KEYWORD_CANDIDATES, VECTOR_CANDIDATES, RERANKED = 150, 50, 30
DIGITS = 9

# Words that mark a procedure question, and headers that move a score.
PROCEDURE_WORDS = [
    "install", "installation", "mounting", "procedure", "steps", "instructions",
    "how to", "configure", "setup", "connect", "troubleshoot", "repair", "fix",
]
TECHNICAL_HEADERS = ["install", "procedure", "mounting", "configuration"]
GENERAL_HEADERS = ["introduction", "overview", "general", "about"]
TECHNICAL_FACTOR, GENERAL_FACTOR = 1.2, 0.9


def fuse(keyword_hits: DataFrame, vector_hits: DataFrame, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion: query_id, id, keyword_rank, vector_rank, rrf_score."""
    left = keyword_hits.select("query_id", "id", F.col("rank").alias("keyword_rank"))
    right = vector_hits.select("query_id", "id", F.col("rank").alias("vector_rank"))

    def share(rank: str) -> Column:
        return F.coalesce(1 / (F.col(rank) + constant), F.lit(0.0))

    return left.join(right, ["query_id", "id"], "full_outer").withColumn(
        "rrf_score", F.round(share("keyword_rank") + share("vector_rank"), DIGITS)
    )


def overlap(fused: DataFrame) -> DataFrame:
    """Candidates from keywords only, vectors only, both, and all, per query."""
    by_keyword, by_vector = F.col("keyword_rank").isNotNull(), F.col("vector_rank").isNotNull()
    return fused.groupBy("query_id").agg(
        F.count_if(by_keyword & ~by_vector).alias("keyword_only"),
        F.count_if(by_vector & ~by_keyword).alias("vector_only"),
        F.count_if(by_keyword & by_vector).alias("both"),
        F.count(F.lit(1)).alias("total"),
    )


def candidates(index: keyword.Index, chunk_vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """Fused keyword and vector candidates; ``queries``: query_id, query, embedding."""
    by_keyword = keyword.bm25_search(index, queries, KEYWORD_CANDIDATES)
    asked = queries.filter(F.col("embedding").isNotNull())
    by_vector = vectors.nearest(chunk_vectors, asked, VECTOR_CANDIDATES)
    return fuse(by_keyword, by_vector)


def search(
    index: keyword.Index,
    chunks: DataFrame,
    library: DataFrame,
    queries: DataFrame,
    k: int,
    filename: str = "all",
    prefilter: bool = False,
) -> DataFrame:
    """Hybrid search: fuse the candidates, fetch active chunks, keep the best ``k``.

    The file filter comes after the candidate cut, so a filtered search may
    return fewer than ``k`` rows.  ``prefilter=True`` restricts the vectors
    before the cut; pass an index built over the same chunks.
    """
    wanted = keyword.active_chunks(chunks, library, filename)
    pool = wanted if prefilter else keyword.active_chunks(chunks, library)
    chunk_vectors = pool.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    # a table of known size, so that few candidates travel to the texts and not all texts to them
    fused = stored(candidates(index, chunk_vectors, queries), "candidates")
    loaded = fused.join(wanted.select("id", "filename", "chunk_index", "content"), "id")
    return scale.top_k(loaded, ["query_id"], [F.col("rrf_score").desc(), F.col("id")], k)


def rerank(results: DataFrame, score: str, top: int = RERANKED) -> DataFrame:
    """Blend a given score into the best ``top`` results; the others keep their fused score."""
    blended = F.round(0.8 * F.col(score) + 0.2 * F.col("rrf_score"), DIGITS)
    final = F.when(F.col("rank") <= top, blended).otherwise(F.col("rrf_score"))
    judged = results.withColumn("final_score", final).drop("rank")
    return scale.top_k(judged, ["query_id"], [F.col("final_score").desc(), F.col("id")], 2**31 - 1)


def is_procedure_question(query: str | Column) -> Column:
    text = F.lower(F.col(query) if isinstance(query, str) else query)
    hit = F.lit(False)
    for word in PROCEDURE_WORDS:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def header_factor(header: str | Column) -> Column:
    text = F.lower(F.coalesce(F.col(header) if isinstance(header, str) else header, F.lit("")))
    return (
        F.when(text.rlike("|".join(TECHNICAL_HEADERS)), TECHNICAL_FACTOR)
        .when(text.rlike("|".join(GENERAL_HEADERS)), GENERAL_FACTOR)
        .otherwise(1.0)
    )


def header_rerank(results: DataFrame, score: str, header: str, top: int = 5, skip_procedures: bool = False) -> DataFrame:
    """Adjust the scores of the best ``top`` by their section header and order them anew.

    ``skip_procedures`` leaves the order of procedure questions as it is.
    """
    adjusted = F.col(score) * header_factor(header)
    if skip_procedures:
        adjusted = F.when(is_procedure_question("query"), F.col(score)).otherwise(adjusted)
    best = results.filter(F.col("rank") <= top).drop("rank").withColumn("adjusted_score", F.round(adjusted, DIGITS))
    return scale.top_k(best, ["query_id"], [F.col("adjusted_score").desc(), F.col("id")], top)


def best_score(columns: list[str]) -> Column:
    """First score that is there: final, fused, similarity, else one half."""
    order = [c for c in ("final_score", "rrf_score", "similarity") if c in columns]
    return F.coalesce(*[F.col(c) for c in order], F.lit(0.5))


def confidence(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean best score per query within [0.1, 0.95]; 0.1 without any result."""
    means = results.groupBy("query_id").agg(F.avg(best_score(results.columns)).alias("_mean"))
    value = F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.coalesce("_mean", F.lit(0.1))))
    return queries.select("query_id").join(means, "query_id", "left").select(
        "query_id", F.round(value, 6).alias("confidence")
    )


def context(results: DataFrame) -> DataFrame:
    """Numbered context text per query from its top-k results."""
    section = F.format_string(
        "**Context Section %d:**\n- Source: %s\n- Chunk: #%d\n- RRF Score: %.3f\n- Content: %s\n",
        F.col("rank"),
        F.col("filename"),
        F.col("chunk_index"),
        F.col("rrf_score"),
        F.trim("content"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", section.alias("section"))))
    return results.groupBy("query_id").agg(F.array_join(ordered["section"], "\n").alias("context"))


def citations(results: DataFrame, best: int = 3) -> DataFrame:
    """Per query and document: its best chunks, and how many more there are."""
    source = F.replace(F.replace(F.col("filename"), F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" "))
    rows = results.select("query_id", source.alias("document"), "chunk_index", "rank")
    counts = rows.groupBy("query_id", "document").agg(F.count(F.lit(1)).alias("_n"))
    kept = scale.top_k(rows.withColumnRenamed("rank", "_place"), ["query_id", "document"], [F.col("_place")], best)
    labels = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_index"))),
        lambda c: F.concat(F.lit("#"), c["chunk_index"].cast("string")),
    )
    shown = kept.groupBy("query_id", "document").agg(F.array_join(labels, ", ").alias("_labels"))
    more = F.when(F.col("_n") > best, F.format_string(" (+%d more)", F.col("_n") - best)).otherwise("")
    text = F.when(F.col("_n") == 1, F.concat(F.lit("Chunk "), "_labels")).otherwise(
        F.concat(F.lit("Chunks "), F.col("_labels"), more)
    )
    return shown.join(counts, ["query_id", "document"]).select("query_id", "document", text.alias("chunks_cited"))


def index_report(index: keyword.Index, celled: DataFrame) -> DataFrame:
    """Sizes after a rebuild of both indexes."""
    vectors_now = celled.agg(F.count(F.lit(1)).alias("v"), F.count_distinct("cell").alias("c"))
    return index.totals.select(
        F.col("chunks").alias("indexed_chunks"),
        index.terms.agg(F.count(F.lit(1)).alias("n")).scalar().alias("terms"),
        index.terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).scalar().alias("postings"),
        vectors_now.select("v").scalar().alias("indexed_vectors"),
        vectors_now.select("c").scalar().alias("cells"),
    )
