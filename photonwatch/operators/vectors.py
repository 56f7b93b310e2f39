"""Vector search: exact, by cells, and by cosine, for a batch of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonwatch import scale

DIGITS = 9
VECTORS_PER_GROUP = 20_000
QUERIES_PER_GROUP = 1_000
FOUND = "query_id bigint, id bigint, distance double"


def decoded(raw: DataFrame, text: str, schema: str = "array<float>") -> DataFrame:
    """JSON column to values; rows that do not parse are left out."""
    return raw.withColumn(text, F.from_json(text, schema, {"mode": "PERMISSIVE"})).filter(F.col(text).isNotNull())


def decoded_metadata(text: str | Column) -> Column:
    """JSON object as a map; unreadable text gives an empty map."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def _stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.empty((0, 0))


def _distances(queries: np.ndarray, points: np.ndarray, metric: str) -> np.ndarray:
    """Squared L2, or one minus the cosine (a zero vector is at distance 1)."""
    if metric == "cosine":
        norms = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(points, axis=1))
        dots = queries @ points.T
        return 1.0 - np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    squares = (queries**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2.0 * queries @ points.T
    return np.maximum(squares, 0.0)


class _Best:
    """The k nearest points per query seen so far; ties go to the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
        self.query_ids, self.queries, self.k, self.metric = query_ids, queries, k, metric
        self.found: pd.DataFrame | None = None

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        if len(ids) == 0 or len(self.query_ids) == 0:
            return
        far = np.round(_distances(self.queries, points, self.metric), DIGITS)
        order = np.lexsort((np.broadcast_to(ids, far.shape), far), axis=1)[:, : self.k]
        part = pd.DataFrame(
            {
                "query_id": np.repeat(self.query_ids, order.shape[1]),
                "id": ids[order].ravel(),
                "distance": np.take_along_axis(far, order, axis=1).ravel(),
            }
        )
        both = part if self.found is None else pd.concat([self.found, part])
        self.found = both.sort_values(["query_id", "distance", "id"]).groupby("query_id").head(self.k)

    def rows(self) -> pd.DataFrame:
        if self.found is None:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []}).astype({"query_id": "int64", "id": "int64"})
        return self.found


def nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The ``k`` nearest vectors of every query, exactly: query_id, id, distance, rank.

    ``vectors``: id, embedding.  ``queries``: query_id, embedding.  Both are dealt
    to a grid of bounded groups, each of which keeps k rows per query, so pairs
    are computed but never shuffled.
    """
    near = _nearest_grid(vectors, queries, k, metric)
    return scale.top_k(near, ["query_id"], [F.col("distance"), F.col("id")], k)


def _group_count(df: DataFrame, size: int) -> Column:
    return df.agg(F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("bigint")).scalar()


def _meet(vectors: DataFrame, queries: DataFrame, keys: list[str], k: int, metric: str) -> DataFrame:
    """Vectors and queries with equal keys, k rows per query kept per group."""

    def search(key: tuple, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = _Best(asked["query_id"].to_numpy(), _stack(asked["embedding"]), k, metric)
        best.add(points["id"].to_numpy(), _stack(points["embedding"]))
        return best.rows()

    return (
        scale.workers(vectors, *keys)
        .groupBy(*keys)
        .cogroup(scale.workers(queries, *keys).groupBy(*keys))
        .applyInPandas(search, FOUND)
    )


def _nearest_grid(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    rows, columns = _group_count(vectors, VECTORS_PER_GROUP), _group_count(queries, QUERIES_PER_GROUP)
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    left = vectors.select(
        "id", "embedding", F.pmod(F.xxhash64("id"), rows).alias("_v"), F.explode(F.sequence(zero, columns - one)).alias("_q")
    )
    right = queries.select(
        "query_id",
        "embedding",
        F.pmod(F.xxhash64("query_id"), columns).alias("_q"),
        F.explode(F.sequence(zero, rows - one)).alias("_v"),
    )
    return _meet(left, right, ["_v", "_q"], k, metric)


def similarity(distance: str = "distance", metric: str = "l2") -> Column:
    return F.round(1 - F.col(distance) if metric == "cosine" else 1 / (1 + F.col(distance)), DIGITS)


def fit_cells(vectors: DataFrame, cells: int | None = None, seed: int = 42) -> np.ndarray:
    """Centres by k-means over all vectors; as many ``cells`` as the root of their number unless given.

    Only the centres reach the driver.
    """
    points = vectors.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    wanted = cells or max(1, int(np.floor(np.sqrt(vectors.count()))))
    return np.array(KMeans(k=wanted, seed=seed, maxIter=10).fit(points).clusterCenters())


def in_cells(vectors: DataFrame, centres: np.ndarray, key: str, probe: int = 1) -> DataFrame:
    """The ``probe`` nearest cells of every vector, one row each."""
    probe = min(probe, len(centres))

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            far = _distances(_stack(part["embedding"]), centres, "l2")
            cells = np.argsort(far, axis=1, kind="stable")[:, :probe]
            out = part.loc[part.index.repeat(probe)]
            yield out.assign(cell=cells.ravel().astype("int32"))

    schema = f"{key} bigint, embedding array<float>, cell int"
    return vectors.select(F.col(key).cast("bigint"), F.col("embedding").cast("array<float>")).mapInPandas(assign, schema)


def write_cells(celled: DataFrame, centres: np.ndarray, path: str) -> None:
    """Vectors in one folder per cell, rebalanced to files of even size, and the centres beside them."""
    celled.hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    celled.sparkSession.createDataFrame(rows, "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")


def read_cells(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    """What :func:`write_cells` wrote; a search by cells reads only the folders of probed cells."""
    centres = spark.read.parquet(f"{path}/centres").orderBy("cell").toPandas()["centre"]
    return spark.read.parquet(f"{path}/vectors"), np.array(centres.tolist())


def nearest_in_cells(
    celled: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probe: int = 32
) -> DataFrame:
    """As :func:`nearest`, but looking only into each query's nearest cells.

    Cells that no query probes are left behind before anything is shuffled.  A
    crowded cell is split into groups of about ``VECTORS_PER_GROUP``; the
    queries that probe the cell visit each of its groups.
    """
    asked = in_cells(queries, centres, "query_id", probe)
    celled = celled.join(asked.select("cell").distinct(), "cell", "left_semi")
    sizes = celled.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VECTORS_PER_GROUP).cast("bigint").alias("_parts"))
    left = celled.join(sizes, "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts"))).drop("_parts")
    right = (
        asked.join(sizes, "cell")
        .withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
        .withColumn("_slice", F.pmod(F.xxhash64("query_id"), _group_count(queries, QUERIES_PER_GROUP)))
        .drop("_parts")
    )
    slices = _group_count(queries, QUERIES_PER_GROUP) - F.lit(1).cast("bigint")
    left = left.withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), slices)))
    near = _meet(left, right, ["cell", "_part", "_slice"], k, "l2")
    return scale.top_k(near, ["query_id"], [F.col("distance"), F.col("id")], k)
