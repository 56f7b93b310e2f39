"""Keyword search: tokens, index tables and Okapi BM25 for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.session import cut_lineage
from photonwatch.sources.sinks import stored

K1, B, EPSILON = 1.5, 0.75, 0.25  # fixed values: Okapi defaults
SCORE_DIGITS = 9


def active_chunks(chunks: DataFrame, library: DataFrame, filename: str = "all") -> DataFrame:
    """Chunks whose document is active, optionally of one file (``all`` = any)."""
    kept = library.filter(F.col("status") == "active").select("filename")
    if filename != "all":
        kept = kept.filter(F.col("filename") == filename)
    return chunks.join(kept, "filename", "left_semi")


# a run of a-z and 0-9, at least two long or ``a`` or ``i``, with no other word character beside it
_TOKEN = r"(?<![\p{L}\p{N}_])(?:[a-z0-9]{2,}|[ai])(?![\p{L}\p{N}_])"


def tokens(text: str | Column) -> Column:
    """Whole words of a-z and 0-9, lower case; single characters only ``a`` and ``i``.

    A run with any other letter, digit or underscore is one word and dropped as a whole.
    """
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(_TOKEN), F.lit(0))


class Index(NamedTuple):
    """Keyword index as tables."""

    blocks: DataFrame  # token, block (from 0, the highest impacts first; numbers may be left out), ids, impacts
    forward: DataFrame  # id, impacts (map by token)
    terms: DataFrame  # token, df, idf, blocks, steps (first block and highest impact from there on)
    totals: DataFrame  # chunks, avg_length


#: Postings of a block, and of a part of a word that one task orders, about.
BLOCK, PART = 128, 16_384
#: Postings that a task sorts by word before they are shuffled, about.
LISTED = 1_000_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's distinct words and how often it has them."""
    for batch in batches:
        lists = batch.column("tokens")
        words = lists.flatten().dictionary_encode()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        rows, size = np.repeat(np.arange(len(lists)), lengths), max(1, len(words.dictionary))
        found, counts = np.unique(rows * size + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
        offsets = pa.array(np.searchsorted(found, np.arange(len(lists) + 1) * size), pa.int32())
        tokens = pa.ListArray.from_arrays(offsets, words.dictionary.take(pa.array(found % size)))
        tfs = pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists.value_lengths(), tokens, tfs], ["id", "length", "tokens", "tfs"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of many chunks as one list per word."""

    def lists(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        tokens, impacts = (table.column(c).combine_chunks() for c in ("tokens", "impacts"))
        words = tokens.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        order = pa.array(np.argsort(codes, kind="stable"))
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(words.dictionary)))]), pa.int32())
        ids = table.column("id").combine_chunks().take(pc.list_parent_indices(tokens)).take(order)
        columns = [words.dictionary, pa.ListArray.from_arrays(offsets, ids), pa.ListArray.from_arrays(offsets, impacts.flatten().take(order))]
        return pa.RecordBatch.from_arrays(columns, ["token", "ids", "impacts"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("tokens").flatten())
        if size >= LISTED:
            yield lists(held)
            held, size = [], 0
    if size:
        yield lists(held)


def _impact_blocks(chunks: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks of postings by falling impact, and per token its number of blocks and what later blocks may hold.

    ``chunks``: id, tokens, impacts.  Tasks send one list per word.  A common word
    is dealt to parts of about ``PART`` postings, so no task orders it whole; the
    n-th blocks of all parts stand side by side.
    """
    kind = chunks.schema["id"].dataType.simpleString()
    lists = chunks.mapInArrow(_listed, f"token string, ids array<{kind}>, impacts array<double>")
    common = stored(terms.filter(F.col("df") > PART).select("token", F.ceil(F.col("df") / PART).cast("int").alias("parts")), "common-words")
    parts = F.coalesce("parts", F.lit(1))
    dealt = lists.join(common, "token", "left").select("token", parts.alias("parts"), F.pmod(F.xxhash64("ids"), parts).cast("int").alias("part"), "ids", "impacts")
    whole = dealt.groupBy("token", "parts", "part").agg(F.flatten(F.collect_list("impacts")).alias("impacts"), F.flatten(F.collect_list("ids")).alias("ids"))
    # the generator keeps the optimiser from sorting once per use of the rows
    rows = whole.select("token", "parts", "part", F.explode(F.array(F.sort_array(F.arrays_zip("impacts", "ids"), False))).alias("rows"))
    places = F.sequence(F.lit(0), F.ceil(F.size("rows") / BLOCK).cast("int") - 1)
    cut = rows.select("token", "parts", "part", F.posexplode(F.transform(places, lambda n: F.slice("rows", n * BLOCK + 1, BLOCK))).alias("n", "rows"))
    blocks = stored(
        cut.select("token", (F.col("n") * F.col("parts") + F.col("part")).alias("block"), F.col("rows.ids").alias("ids"), F.col("rows.impacts").alias("impacts")),
        "blocks",
    )
    first = F.when(F.col("block") > 0, F.expr("shiftleft(1, CAST(floor(log2(block)) AS INT))")).otherwise(0).alias("first")
    tops = blocks.groupBy("token", first).agg(F.max("block").alias("last"), F.max(F.col("impacts")[0]).alias("top"))
    steps = F.array_sort(F.collect_list(F.struct("first", "top"))).alias("steps")
    seen = tops.groupBy("token").agg((F.max("last") + 1).alias("blocks"), steps)

    def onward(s: Column) -> Column:
        later = F.filter("steps", lambda x: x["first"] >= s["first"])
        return F.struct(s["first"].alias("first"), F.array_max(F.transform(later, lambda x: x["top"])).alias("top"))

    return blocks, seen.select("token", "blocks", F.transform("steps", onward).alias("steps"))


def build_index(chunks: DataFrame, k1: float = K1, b: float = B, epsilon: float = EPSILON) -> Index:
    """Index tables of ``chunks`` (id, content), each written once and then read.

    Words are counted where their chunk is read; rows of one id and length count
    as one chunk.  The impact of a posting is its BM25 term weight without the
    idf, so that a score is a plain weighted sum.
    """
    kind = chunks.schema["id"].dataType.simpleString()
    schema = f"id {kind}, length int, tokens array<string>, tfs array<bigint>"
    read = stored(chunks.select("id", tokens("content").alias("tokens")).mapInArrow(_counted, schema), "chunk-words")
    totals = cut_lineage(read.agg(F.count(F.lit(1)).alias("chunks"), (F.coalesce(F.sum("length"), F.lit(0)) / F.count(F.lit(1))).alias("avg_length")))
    worded = read.filter("length > 0")
    again = stored(worded.groupBy("id", "length").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n").toDF("_id", "_length"), "repeated-chunks")
    repeats = F.col("id").eqNullSafe(F.col("_id")) & (F.col("length") == F.col("_length"))
    merged = (
        worded.join(again, repeats, "left_semi")
        .select("id", "length", F.explode(F.arrays_zip("tokens", "tfs")).alias("w"))
        .groupBy("id", "length", F.col("w.tokens").alias("token"))
        .agg(F.sum("w.tfs").alias("tf"))
        .groupBy("id", "length")
        .agg(F.array_sort(F.collect_list(F.struct("token", "tf"))).alias("rows"))
        .select("id", "length", F.col("rows.token").alias("tokens"), F.col("rows.tf").alias("tfs"))
    )
    counted = worded.join(again, repeats, "left_anti").unionByName(merged)
    n, average = totals.select("chunks").scalar(), totals.select("avg_length").scalar()
    rows = counted.withColumn("_norm", k1 * (1 - b + b * F.col("length") / average))
    impacts = F.transform("tfs", lambda tf: tf * (k1 + 1) / (tf + F.col("_norm")))
    weighed = rows.select("id", "tokens", impacts.alias("impacts"))
    per_term = counted.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    raw = stored(per_term.withColumn("_raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "terms")
    floor = raw.agg(F.avg("_raw") * epsilon).scalar()
    terms = raw.select("token", "df", F.when(F.col("_raw") < 0, floor).otherwise(F.col("_raw")).alias("idf"))
    blocks, steps = _impact_blocks(weighed, terms)
    forward = weighed.select("id", F.map_from_arrays("tokens", "impacts").alias("impacts"))
    return Index(blocks, forward, cut_lineage(terms.join(steps, "token")), totals)


#: Blocks are stored in so many folders, by a hash of the token.
TOKEN_FOLDERS = 64


def write_index(index: Index, path: str) -> None:
    """The index as tables under ``path``; writing again replaces them.

    Blocks lie in folders by a hash of their token, each rebalanced to files of
    even size, so a search reads only the folders of its words.
    """
    folder = F.pmod(F.xxhash64("token"), F.lit(TOKEN_FOLDERS)).cast("int")
    placed = index.blocks.withColumn("folder", folder).hint("rebalance", "folder")
    placed.write.mode("overwrite").partitionBy("folder").parquet(f"{path}/blocks")
    index.terms.withColumn("folder", folder).write.mode("overwrite").parquet(f"{path}/terms")
    index.forward.write.mode("overwrite").parquet(f"{path}/forward")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])


def query_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Known terms per query with their weight and, where ``terms`` has them, blocks; a repeated term counts each time."""
    asked = (
        queries.select("query_id", F.explode(tokens("query")).alias("token"))
        .groupBy("query_id", "token")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    more = [c for c in terms.columns if c in ("folder", "blocks", "steps")]
    return asked.join(terms, "token").select("query_id", "token", *more, (F.col("times") * F.col("idf")).alias("weight"))


#: Blocks of a term that a search reads first, and by how much that grows.
FIRST_BLOCKS, GROWTH = 2, 4
_MARGIN = 2 * 10.0**-SCORE_DIGITS


class Found(NamedTuple):
    """What a search read: candidates with the weight seen so far, the bar each query's k-th has set, blocks per term."""

    candidates: DataFrame  # query_id, id, seen
    bars: DataFrame  # query_id, bar, rest (most that an unseen posting can add up to)
    terms: DataFrame  # query_id, token, weight, blocks, upto (blocks read)


def _next_top(upto: str) -> Column:
    """Highest impact that the blocks from ``upto`` on may hold."""
    known = F.filter("steps", lambda s: s["first"] <= F.col(upto))
    return F.when(F.col(upto) < F.col("blocks"), F.element_at(known, -1)["top"]).otherwise(0.0)


def candidates(index: Index, queries: DataFrame, k: int) -> Found:
    """Postings that may belong to the ``k`` best of a query, read block by block in rounds.

    Every term of a query starts with its blocks of highest impact.  A query is
    done when ``k`` chunks have more for certain than all its unread blocks could
    give together; until then the terms that hold more than an even share of that
    bar are read on, ``GROWTH`` times as far.  So common words of low weight are
    hardly read, and no posting is copied but to the queries that ask for it.
    Terms of negative weight are never read: they cannot lift a chunk.
    """
    asked = query_terms(queries, index.terms)
    keys = [c for c in ("folder", "token", "block") if c in index.blocks.columns]
    lowest = F.sum(F.when(F.col("weight") < 0, F.col("weight") * F.col("steps")[0]["top"]).otherwise(0.0)).alias("lowest")
    reading = F.when(F.col("weight") > 0, F.least(F.lit(FIRST_BLOCKS), F.col("blocks"))).otherwise(0)
    terms = cut_lineage(asked.withColumns({"at": F.lit(0), "upto": reading, "done": F.lit(False)}))
    losses = cut_lineage(terms.groupBy("query_id").agg(lowest))
    seen, finished = None, None
    while True:
        block = F.explode(F.sequence(F.col("at"), F.col("upto") - 1)).alias("block")
        wanted = terms.filter("upto > at").select("query_id", *keys[:-1], "weight", block)
        read = wanted.join(index.blocks, keys).select("query_id", "weight", F.explode(F.arrays_zip("ids", "impacts")).alias("p"))
        new = read.select("query_id", F.col("p.ids").alias("id"), (F.col("weight") * F.col("p.impacts")).alias("seen"))
        seen = cut_lineage((new if seen is None else seen.unionByName(new)).groupBy("query_id", "id").agg(F.sum("seen").alias("seen")))
        best = scale.top_k(seen, ["query_id"], [F.desc("seen"), F.asc("id")], k)
        kth = best.filter(F.col("rank") == k).select("query_id", F.col("seen").alias("kth"))
        bound = F.greatest(F.lit(0.0), F.col("weight")) * _next_top("upto")
        rests = terms.groupBy("query_id").agg(F.sum(bound).alias("rest"), F.count_if(bound > 0).alias("open"))
        bars = rests.join(losses, "query_id").join(kth, "query_id", "left")
        bars = bars.select("query_id", "rest", "open", (F.col("kth") + F.col("lowest")).alias("bar"))
        share = F.greatest(F.coalesce("bar", F.lit(0.0)) - _MARGIN, F.lit(0.0)) / F.greatest(F.col("open"), F.lit(1))
        going = ~F.col("done") & (F.col("rest") > 0) & (F.col("bar").isNull() | (F.col("rest") >= F.col("bar") - _MARGIN))
        further = F.when(F.col("going") & (bound >= F.col("share")) & (bound > 0), F.least(F.col("upto") * GROWTH, F.col("blocks"))).otherwise(F.col("upto"))
        state = terms.join(bars.select("query_id", "bar", "rest", share.alias("share")), "query_id").withColumn("going", going)
        terms = cut_lineage(state.select(*[c for c in terms.columns if c not in ("at", "upto", "done")], F.col("upto").alias("at"), further.alias("upto"), (~F.col("going")).alias("done"), "bar", "rest"))
        finished = terms.groupBy("query_id").agg(F.first("bar").alias("bar"), F.first("rest").alias("rest"))
        if terms.filter("not done").isEmpty():
            return Found(seen, cut_lineage(finished), terms.select("query_id", "token", "weight", "blocks", "upto"))
        terms = terms.drop("bar", "rest")


#: Queries of more known terms are met with all chunks; what a task meets at once, and cells of a table of impacts.
FEW_TERMS, CHUNKS_PER_GROUP, QUERIES_PER_GROUP, CELLS = 8, 8_192, 250, 4_000_000


def _best_of_all(forward: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The chunks that may be among the ``k`` best of each query, scored whole: query_id, id, score.

    ``terms``: query_id, token, weight.  Long queries share words with most
    chunks, so there is no posting to leave unread.  Chunks and queries are dealt
    to a grid of bounded groups; a group multiplies its tables of impacts and
    weights and keeps about k rows per query, so pairs are not shuffled.
    """

    def search(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if chunks.num_rows and asked.num_rows:
            words = pa.array(sorted(set(asked.column("token").to_pylist())), pa.string())
            codes = pc.index_in(asked.column("token"), value_set=words).to_numpy()
            query_ids, query = np.unique(asked.column("query_id").to_numpy(), return_inverse=True)
            weights = np.zeros((len(words), len(query_ids)))
            weights[codes, query] = asked.column("weight").to_numpy()
            lists = chunks.column("tokens").combine_chunks()
            word = pc.index_in(lists.flatten(), value_set=words)
            known = pc.is_valid(word).to_numpy(zero_copy_only=False)
            code = pc.fill_null(word, 0).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[known].astype(np.int64)
            impact = chunks.column("impacts").combine_chunks().flatten().to_numpy(zero_copy_only=False)[known]
            order = np.argsort(row * len(words) + code)
            row, code, impact = row[order], code[order], impact[order]
            ids, keys = chunks.column("id").to_numpy(), np.append(row * len(words) + code, -1)
            near, step = np.empty((len(query_ids), len(ids))), max(1, CELLS // len(words))
            for at in range(0, len(ids), step):
                lo, hi = np.searchsorted(row, [at, at + step])
                table = np.zeros((min(step, len(ids) - at), len(words)))
                table[row[lo:hi] - at, code[lo:hi]] = impact[lo:hi]
                near[:, at : at + step] = (table @ weights).T
            for q, query_id in enumerate(query_ids):
                bar = np.partition(near[q], -k)[-k] if len(ids) > k else 0.0
                some = np.flatnonzero(near[q] >= max(bar - 10 * _MARGIN, _MARGIN / 10))
                score = np.zeros(len(some))
                for c in np.sort(codes[query == q]):  # added word by word, so equal chunks score alike in any group
                    wanted = some * len(words) + c
                    place = np.searchsorted(keys[:-1], wanted)
                    score += weights[c, q] * np.where(keys[place] == wanted, np.append(impact, 0.0)[place], 0.0)
                order = np.lexsort((ids[some], -score))
                some, score = some[order], score[order]
                # of equal scores no more than k can be asked for; scores within the margin may round alike
                alike = np.arange(len(score)) - np.searchsorted(-score, -score)
                kept = alike < k
                if len(score) > k:
                    kept &= score >= score[k - 1] - _MARGIN
                out.append((np.full(kept.sum(), query_id), ids[some[kept]], score[kept]))
        found = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        kinds = (asked.schema.field("query_id").type, chunks.schema.field("id").type, pa.float64())
        return pa.table({name: pa.array(c, kind) for name, c, kind in zip(("query_id", "id", "score"), found, kinds)})

    def groups(df: DataFrame, key: str, size: int) -> Column:
        return df.agg(F.greatest(F.ceil(F.count_distinct(key) / size), F.lit(1)).cast("bigint")).scalar()

    rows, columns = groups(forward, "id", CHUNKS_PER_GROUP), groups(terms, "query_id", QUERIES_PER_GROUP)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    chunks = forward.select(
        "id", F.map_keys("impacts").alias("tokens"), F.map_values("impacts").alias("impacts"),
        F.pmod(F.xxhash64("id"), rows).alias("_c"), F.explode(F.sequence(zero, columns - one)).alias("_q"),
    )
    asked = terms.select("query_id", "token", "weight", F.pmod(F.xxhash64("query_id"), columns).alias("_q"), F.explode(F.sequence(zero, rows - one)).alias("_c"))
    kinds = [df.schema[c].dataType.simpleString() for df, c in ((terms, "query_id"), (forward, "id"))]
    keys = ["_c", "_q"]
    return (
        scale.workers(chunks, *keys)
        .groupBy(*keys)
        .cogroup(scale.workers(asked, *keys).groupBy(*keys))
        .applyInArrow(search, f"query_id {kinds[0]}, id {kinds[1]}, score double")
    )


def _best_of_read(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """As :func:`_best_of_all` for short queries: what :func:`candidates` leaves is scored whole."""
    found = candidates(index, queries, k)
    might = found.candidates.join(found.bars, "query_id").filter(F.col("bar").isNull() | (F.col("seen") + F.col("rest") >= F.col("bar") - _MARGIN))
    asked = found.terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("token", "weight"))).alias("words"))
    whole = might.select("query_id", "id").join(asked, "query_id").join(index.forward, "id")
    impact = lambda w: F.coalesce(F.try_element_at("impacts", w["token"]), F.lit(0.0))
    score = F.aggregate("words", F.lit(0.0), lambda total, w: total + w["weight"] * impact(w))
    return whole.select("query_id", "id", score.alias("score"))


def bm25_search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The ``k`` best chunks per query with a positive score: query_id, id, score, rank.

    Queries of up to ``FEW_TERMS`` known terms read postings block by block;
    longer ones are met with all chunks.  Both score a chunk by all its impacts.
    Equal scores (to ``SCORE_DIGITS``) are ordered by id.
    """
    terms = cut_lineage(query_terms(queries, index.terms.select("token", "idf")).filter(F.col("query_id").isNotNull()))
    sizes = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    long, short = (sizes.filter(c).select("query_id") for c in (F.col("n") > FEW_TERMS, F.col("n") <= FEW_TERMS))
    found = _best_of_all(index.forward.filter(F.col("id").isNotNull()), terms.join(long, "query_id", "left_semi"), k)
    if not short.isEmpty():
        found = found.unionByName(_best_of_read(index, queries.join(short, "query_id", "left_semi"), k))
    scored = found.select("query_id", "id", F.round("score", SCORE_DIGITS).alias("score")).filter("score > 0")
    return scale.top_k(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k)
