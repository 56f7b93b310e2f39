"""Nearest vectors by counting collisions in sorted projections."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photonwatch.llm.common import spread_count

#: Projections of each vector, and the share of them that must fall into a query's windows.
PROJECTIONS = 64
COLLISIONS = 0.54
#: Windows reach one radius to either side; radii grow by this factor.
GROWTH = 1.2
#: Rows of the index, and queries, that meet in one task.
INDEX_ROWS = 8192
QUERY_ROWS = 1024


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vector (doubles) and dim of the rows with an id and a finite vector that is not all zeros."""
    rows = vectors.select(
        F.col(id_column).cast("bigint").alias("id"), F.col(vector_column).cast("array<double>").alias("vector")
    ).filter("id is not null and vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def _directions(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, PROJECTIONS))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _build(seed: int, k: int):
    """One row per block: ids, vectors, every projection sorted, and the radius to begin with."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        vectors = np.array(frame["vector"].tolist(), float)
        unit = _unit(vectors)
        projected = (unit @ _directions(unit.shape[1], seed)).T
        order = np.argsort(projected, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(projected, order, axis=1)
        # median distance of some vectors to their k-th neighbour here: only where windows begin depends on it
        some = unit[:: max(1, len(unit) // 32)]
        distance = np.sqrt(np.maximum(0, 2 - 2 * np.sort(some @ unit.T, axis=1)))
        radius = float(np.median(distance[:, ::-1][:, min(k, len(unit) - 1)]))
        row = {
            "dim": frame["dim"].iloc[0], "block": frame["block"].iloc[0], "ids": frame["id"].to_numpy(np.int64).tobytes(), "vectors": vectors.tobytes(),
            "places": order.tobytes(), "projected": values.tobytes(), "radius": max(radius, 1e-3),
        }
        return pd.DataFrame([row])

    return run


def build_index(vectors: DataFrame, k: int = 5, seed: int = 13) -> DataFrame:
    """All rows of ``usable`` in blocks of bounded size: dim, block, ids, vectors, places, projected, radius."""
    blocks = max(1, math.ceil(vectors.count() / INDEX_ROWS))
    placed = vectors.withColumn("block", F.pmod(F.xxhash64("id", "vector"), F.lit(blocks)).cast("int"))
    schema = "dim int, block int, ids binary, vectors binary, places binary, projected binary, radius double"
    return placed.groupBy("dim", "block").applyInPandas(_build(seed, k), schema)


def _search_one(q: np.ndarray, unit: np.ndarray, places: np.ndarray, projected: np.ndarray, centre: np.ndarray, radius: float, k: int, skip: np.ndarray) -> np.ndarray:
    """Positions of the verified vectors of one query.

    All windows grow together around the query's projections; what they take in
    is added to the collisions; vectors over the threshold are verified.  It ends
    when the k-th distance found is within the radius: anything nearer has most
    likely collided by then.
    """
    n = unit.shape[0]
    counts = np.zeros(n, np.int32)
    need = math.ceil(COLLISIONS * PROJECTIONS)
    left = np.empty(PROJECTIONS, np.int64)
    for p in range(PROJECTIONS):
        left[p] = np.searchsorted(projected[p], centre[p])
    right = left.copy()
    k = min(k, n - int(skip.sum()))
    while True:
        taken = []
        for p in range(PROJECTIONS):
            lo = np.searchsorted(projected[p], centre[p] - radius, "left")
            hi = np.searchsorted(projected[p], centre[p] + radius, "right")
            lo, hi = min(lo, left[p]), max(hi, right[p])
            taken += [places[p, lo : left[p]], places[p, right[p] : hi]]
            left[p], right[p] = lo, hi
        counts += np.bincount(np.concatenate(taken), minlength=n).astype(np.int32)
        found = np.flatnonzero((counts >= need) & ~skip)
        if len(found) >= k:
            near = unit[found] @ q
            kth = np.partition(near, len(near) - k)[len(near) - k] if k else 1.0
            if 2 - 2 * kth <= radius * radius or len(found) == n - skip.sum():
                return found
        radius *= GROWTH


def _search(seed: int, k: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        for row in frame.itertuples():
            ids, qids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.qids, np.int64)
            n = len(ids)
            vectors = np.frombuffer(row.vectors).reshape(n, -1)
            queries = np.frombuffer(row.qvectors).reshape(len(qids), -1)
            unit, qunit = _unit(vectors), _unit(queries)
            places = np.frombuffer(row.places, np.int32).reshape(PROJECTIONS, n)
            projected = np.frombuffer(row.projected).reshape(PROJECTIONS, n)
            centres = qunit @ _directions(unit.shape[1], seed)
            for i, query_id in enumerate(qids):
                skip = ids == query_id
                if skip.all():
                    continue
                found = _search_one(qunit[i], unit, places, projected, centres[i], row.radius, k, skip)
                # row by row, so that equal vectors get equal scores
                scores = np.clip((unit[found] * qunit[i]).sum(axis=1), -1, 1)
                best = np.lexsort((ids[found], -scores))[:k]
                out += [(query_id, ids[found[b]], scores[b]) for b in best]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": float})

    return run


def _query_block(frame: pd.DataFrame) -> pd.DataFrame:
    vectors = np.array(frame["vector"].tolist(), float)
    row = {"dim": frame["dim"].iloc[0], "qblock": frame["qblock"].iloc[0], "qids": frame["id"].to_numpy(np.int64).tobytes(), "qvectors": vectors.tobytes()}
    return pd.DataFrame([row])


def search(index: DataFrame, queries: DataFrame, k: int = 5, seed: int = 13) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` vectors of largest cosine found.

    ``index`` as of :func:`build_index`, ``queries`` as of :func:`usable`.  Every
    block of the index meets every block of queries of its dimension and hands on
    k rows per query; the best of these are kept, ties to the smaller id.  A
    vector with the query's own id is no candidate; fewer candidates than k give
    fewer rows; a query id that repeats is searched as its first row.
    """
    distinct = queries.groupBy("id").agg(F.min(F.struct("dim", "vector")).alias("q")).select("id", "q.dim", "q.vector")
    blocks = max(1, math.ceil(distinct.count() / QUERY_ROWS))
    placed = distinct.withColumn("qblock", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = placed.groupBy("dim", "qblock").applyInPandas(_query_block, "dim int, qblock int, qids binary, qvectors binary")
    # the blocks of queries are laid beside each block of the index by number; every meeting is a group of its own
    spread = index.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = ["dim", "block", "qblock"]
    grid = spread.join(asked, ["dim", "qblock"]).repartition(spread_count(index.sparkSession), *cells)
    best = grid.groupBy(*cells).applyInPandas(_search(seed, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
