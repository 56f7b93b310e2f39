import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from photonwatch.operators import hybrid, keyword, vectors

TEXTS = [
    "the laser of the node", "The fiber, the LASER and the fiber", "a key rate of 12 bits", "the node is a node x y",
    "naïve café key_rate détecteur", "", "the the the the", "rate the key at the node a",
]


def plain_tokens(text):
    return [t for t in re.findall(r"\b[a-z0-9]+\b", text.lower()) if len(t) > 1 or t in "ai"]


def plain_bm25(texts, query, k1=1.5, b=0.75, eps=0.25):
    docs = [plain_tokens(t) for t in texts]
    mean = sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    out = []
    for d in docs:
        s = 0.0
        for t in plain_tokens(query):
            tf = d.count(t)
            s += idf.get(t, 0) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(d) / mean))
        out.append(s)
    return out


def test_tokens_follow_the_word_rule(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(keyword.tokens("t")).collect()]
    assert got == [plain_tokens(t) for t in TEXTS]


@pytest.mark.parametrize("size", [128, 1])
def test_bm25_equals_the_formula(spark, monkeypatch, size):
    monkeypatch.setattr(keyword, "BLOCK", size)
    asked = ["the laser node", "key rate rate", "nothing here", "the a"]
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = keyword.bm25_search(keyword.build_index(chunks), queries, 3).collect()
    for q, text in enumerate(asked):
        want = sorted(((-round(s, 9), i) for i, s in enumerate(plain_bm25(TEXTS, text)) if s > 0))[:3]
        assert [(r.id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [
            (i, round(-s, 6)) for s, i in want
        ]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(300, 8)).astype("float32")
    points[7] = points[3]  # a tie
    points[9] = 0
    asked = points[:12] + rng.normal(scale=0.1, size=(12, 8)).astype("float32")
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(asked)], "query_id long, embedding array<float>")
    return points.astype(float), asked.astype(float), v, q


def ranked(df):
    return [(r.query_id, r["rank"], r.id) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_nearest_equals_brute_force_either_way(cloud, monkeypatch, metric):
    points, asked, v, q = cloud
    if metric == "l2":
        far = ((asked[:, None, :] - points[None, :, :]) ** 2).sum(-1)
    else:
        norms = np.linalg.norm(asked, axis=1)[:, None] * np.linalg.norm(points, axis=1)[None, :]
        far = 1 - np.divide(asked @ points.T, norms, out=np.zeros_like(norms), where=norms > 0)
    far = far.round(9)
    want = [(i, n + 1, int(j)) for i in range(len(asked)) for n, j in enumerate(np.lexsort((np.arange(len(points)), far[i]))[:5])]
    assert ranked(vectors.nearest(v, q, 5, metric)) == want
    monkeypatch.setattr(vectors, "VECTORS_PER_GROUP", 40)
    monkeypatch.setattr(vectors, "QUERIES_PER_GROUP", 5)
    assert ranked(vectors.nearest(v, q, 5, metric)) == want


def test_cells_equal_exact_when_all_are_probed(cloud, monkeypatch):
    _, _, v, q = cloud
    exact = ranked(vectors.nearest(v, q, 5))
    centres = vectors.fit_cells(v)
    assert len(centres) == 17
    celled = vectors.in_cells(v, centres, "id").cache()
    assert celled.count() == 300
    monkeypatch.setattr(vectors, "VECTORS_PER_GROUP", 10)
    assert ranked(vectors.nearest_in_cells(celled, centres, q, 5)) == exact
    few = ranked(vectors.nearest_in_cells(celled, centres, q, 5, probe=2))
    assert len(set(few) & set(exact)) > len(exact) / 2


def test_cells_beyond_the_probes_keep_most_neighbours(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(60, 8)) * 3
    points = np.concatenate([c + rng.normal(size=(40, 8)) for c in centre])
    v = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embedding array<float>")
    q = v.filter("id % 97 = 0").select(F.col("id").alias("query_id"), "embedding")
    centres = vectors.fit_cells(v)
    assert len(centres) == 48  # more than are probed by default
    found = ranked(vectors.nearest_in_cells(vectors.in_cells(v, centres, "id"), centres, q, 10))
    exact = ranked(vectors.nearest(v, q, 10))
    assert len(set(found) & set(exact)) >= 0.9 * len(exact)
    assert len(vectors.fit_cells(v, cells=7)) == 7


def test_bad_vectors_are_skipped(spark):
    df = spark.createDataFrame([(1, "[1.0, 2.0]"), (2, "[1.0, "), (3, None)], "id long, embedding string")
    assert [r.id for r in vectors.decoded(df, "embedding").collect()] == [1]


def test_fusion_and_rerank(spark):
    left = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, id long, rank int")
    right = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id long, id long, rank int")
    fused = {r.id: r.rrf_score for r in hybrid.fuse(left, right).collect()}
    assert fused == {10: round(1 / 61, 9), 11: round(1 / 62 + 1 / 61, 9), 12: round(1 / 62, 9)}
    rows = spark.createDataFrame([(1, i, i, 0.01, 1.0 if i == 3 else 0.0) for i in range(1, 6)], "query_id long, id long, rank int, rrf_score double, ce double")
    got = hybrid.rerank(rows, "ce", top=3).orderBy("rank").collect()
    assert [(r.id, r.final_score) for r in got] == [(3, 0.802), (4, 0.01), (5, 0.01), (1, 0.002), (2, 0.002)]


def test_headers_and_procedures(spark):
    df = spark.createDataFrame([("Rack Mounting",), ("General overview",), (None,), ("Installation overview",)], "h string")
    assert [r[0] for r in df.select(hybrid.header_factor("h")).collect()] == [1.2, 0.9, 1.0, 1.2]
    asked = spark.createDataFrame([("How to fix it",), ("What is QBER",)], "q string")
    assert [r[0] for r in asked.select(hybrid.is_procedure_question("q")).collect()] == [True, False]


def test_citations_and_confidence(spark):
    rows = [(1, f"user_guide.pdf", i, i + 1, 0.3) for i in range(5)] + [(1, "b.pdf", 9, 6, 0.3)]
    df = spark.createDataFrame(rows, "query_id long, filename string, chunk_index long, rank int, rrf_score double")
    got = {r.document: r.chunks_cited for r in hybrid.citations(df).collect()}
    assert got == {"user guide": "Chunks #0, #1, #2 (+2 more)", "b": "Chunk #9"}
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert {r.query_id: r.confidence for r in hybrid.confidence(df, asked).collect()} == {1: 0.3, 2: 0.1}


def test_a_stored_index_answers_alike(spark, tmp_path):
    chunks = spark.createDataFrame(list(enumerate(TEXTS)), "id long, content string")
    queries = spark.createDataFrame([(1, TEXTS[0]), (2, "nothing of the kind")], "query_id long, query string")
    built = keyword.build_index(chunks)
    for _ in range(2):  # writing again replaces
        keyword.write_index(built, str(tmp_path))
    stored = keyword.read_index(spark, str(tmp_path))

    def rows(index):
        return sorted((r.query_id, r["rank"], r.id, r.score) for r in keyword.bm25_search(index, queries, 3).collect())

    assert rows(stored) == rows(built)
    assert "folder" in stored.blocks.columns


def test_common_words_are_hardly_read(spark, monkeypatch):
    """Blocks of a common word beyond the bar of a query's best chunks stay unread, and results do not change."""
    monkeypatch.setattr(keyword, "BLOCK", 16)
    rng = np.random.default_rng(1)
    vocabulary = np.array([f"w{n}" for n in range(300)])
    share = 1 / np.arange(1, 301)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(5, 60), p=share / share.sum())) for _ in range(1500)]
    asked = ["w0 w150 w90", "w1 w200", "w0 w1", "w2 w0 w299 w299"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, content string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = keyword.build_index(chunks)
    got = keyword.bm25_search(index, queries, 5).collect()
    for q, text in enumerate(asked):
        want = sorted(((-round(s, 9), i) for i, s in enumerate(plain_bm25(texts, text)) if s > 0))[:5]
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for _, i in want]
    read = {(r.query_id, r.token): (r.upto, r.blocks) for r in keyword.candidates(index, queries, 5).terms.collect()}
    assert all(read[q, "w0"][0] < read[q, "w0"][1] / 2 for q in (0, 3)) and read[1, "w1"][0] < read[1, "w1"][1] / 2
    sizes = index.blocks.select(F.size("ids").alias("n"), F.array_min("impacts").alias("low"), "token", "block").collect()
    assert sum(r.n for r in sizes) == len({(i, w) for i, t in enumerate(texts) for w in t.split()})


@pytest.mark.parametrize("group", [10_000, 7])
def test_long_queries_are_met_with_all_chunks(spark, monkeypatch, group):
    """Queries of many words share some with most chunks: scored in bounded groups, with no rounds over postings."""
    for name, value in (("CHUNKS_PER_GROUP", group * 5), ("QUERIES_PER_GROUP", group), ("CELLS", group * 90), ("PART", group * 3), ("LISTED", group * 9), ("BLOCK", 16)):
        monkeypatch.setattr(keyword, name, value)
    monkeypatch.setattr(keyword, "candidates", None)
    rng = np.random.default_rng(4)
    vocabulary = np.array([f"w{n}" for n in range(80)])
    share = 1 / np.arange(1, 81)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 50), p=share / share.sum())) for _ in range(300)]
    texts += [texts[5]] * 20 + ["", "café"]  # equal scores go by id
    asked = [" ".join(rng.choice(vocabulary, 40)) for _ in range(8)] + [texts[5] + " w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(4)
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    index = keyword.build_index(chunks)
    got = keyword.bm25_search(index, queries, 10).collect()
    for q, text in enumerate(asked):
        want = sorted(((-round(s, 9), i) for i, s in enumerate(plain_bm25(texts, text)) if s > 0))[:10]
        found = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [(r.id, round(r.score, 6)) for r in found] == [(i, round(-s, 6)) for s, i in want]


def test_index_counts_rows_of_one_id_as_one_chunk(spark):
    chunks = spark.createDataFrame([(1, "fiber node fiber"), (1, "fiber node fiber"), (2, "fiber"), (3, None)], "id long, content string")
    index = keyword.build_index(chunks)
    assert {(r.token, r.df) for r in index.terms.collect()} == {("fiber", 2), ("node", 1)}
    assert index.totals.head().chunks == 4
    impact = {(i, r.token): v for r in index.blocks.collect() for i, v in zip(r.ids, r.impacts)}
    mean = 7 / 4
    assert impact[1, "fiber"] == pytest.approx(4 * 2.5 / (4 + 1.5 * (0.25 + 0.75 * 3 / mean))) and len(impact) == 3


def test_index_sends_one_list_per_word_and_task(spark):
    """Postings used to be shuffled one row each, several times."""
    chunks = spark.createDataFrame([(i, f"fiber node w{i % 3}") for i in range(60)], "id long, content string").coalesce(1)
    words = chunks.select("id", F.array(F.lit("fiber"), F.lit("node")).alias("tokens"), F.array(F.lit(1.0), F.lit(2.0)).alias("impacts"))
    lists = words.mapInArrow(keyword._listed, "token string, ids array<bigint>, impacts array<double>").collect()
    assert sorted((r.token, len(r.ids), set(r.impacts)) for r in lists) == [("fiber", 60, {1.0}), ("node", 60, {2.0})]


def test_few_candidates_travel_to_the_texts(spark):
    """The texts are not shuffled to meet the candidates of a search."""
    chunks = spark.createDataFrame([(i, "f", i, f"fiber node w{i}", [float(i), 1.0]) for i in range(40)], "id long, filename string, chunk_index long, content string, embedding array<float>")
    library = spark.createDataFrame([("f", "active")], "filename string, status string")
    queries = spark.createDataFrame([(1, "node w3", [3.0, 1.0])], "query_id long, query string, embedding array<float>")
    found = hybrid.search(keyword.build_index(chunks), chunks, library, queries, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan  # candidates are a stored table of known size, not a shuffle still to come
    assert found.orderBy("rank").first().id == 3
