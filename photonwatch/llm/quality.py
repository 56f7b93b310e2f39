"""Quality scores: ridge regression on random Fourier features of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.llm.common import text_or_empty, word_bounds, word_hashes

#: Size of the model whatever the corpus.
FEATURES = 256
RIDGE = 1e-3
BINS = 1000

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "long_words", "upper", "digits", "marks", "symbols", "pipes", "beyond_ascii", "spaces",
    "stops_per_word", "distinct_words", "commonest_word", "repeated_neighbours", "distinct_pairs", "log_line_words", "distinct_lines",
    "byte_entropy", "capital_words",
)


def _class(codes) -> np.ndarray:
    out = np.zeros(256)
    out[list(codes)] = 1
    return out


_CLASSES = {
    "upper": _class(range(65, 91)),
    "digits": _class(range(48, 58)),
    "marks": _class(map(ord, ".,;:!?'\"()-")),
    "symbols": _class(map(ord, "#$%&*+/<=>@[\\]^_`{}~")),
    "pipes": _class([ord("|")]),
    "beyond_ascii": _class(range(128, 256)),
    "spaces": _class([*range(9, 14), 32]),
}


def statistics(text: str | None) -> list[float]:
    """Shares, rates and logarithms of the whole text; all 0 for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, np.uint8)
    counts = np.bincount(data, minlength=256)
    share = counts / len(data)
    start, end = word_bounds(data)
    n = max(1, len(start))
    h = word_hashes(text)
    _, times = np.unique(h, return_counts=True)
    pairs = h[:-1] * np.uint64(3) + h[1:]
    lines = raw.split(b"\n")
    present = share[share > 0]
    return [
        np.log1p(len(data)),
        np.log1p(len(start)),
        (end - start).sum() / n,
        ((end - start) > 14).sum() / n,
        *[float(share @ mask) for mask in _CLASSES.values()],
        (counts[46] + counts[33] + counts[63]) / n,
        len(times) / n,
        times.max(initial=0) / n,
        (h[1:] == h[:-1]).sum() / n,
        len(np.unique(pairs)) / n,
        np.log1p(len(start) / len(lines)),
        len(set(lines)) / len(lines),
        float(-(present * np.log(present)).sum()),
        ((data[start] >= 65) & (data[start] <= 90)).sum() / n if len(start) else 0.0,
    ]


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the array ``stats`` of every row; null text counts as empty."""

    @F.pandas_udf("array<double>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in text])

    return docs.select("doc_id", run(text_or_empty()).alias("stats"))


@dataclass
class Model:
    """Scaling, projection, ridge weights and the steps of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    raw: np.ndarray
    calibrated: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines whose products average to a Gaussian kernel of the scaled statistics."""
        scaled = np.clip((stats - self.mean) / self.scale, -5, 5)
        waves = np.cos(scaled @ self.projection + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([waves, np.ones((len(stats), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        raw = self.features(stats) @ self.weight
        level = np.interp(raw, self.raw, self.calibrated)
        # a trace of the raw score keeps texts apart that share a step
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _partial_sums(model: Model):
    """One row per row of the normal equations and partition: sums of products, and with the label."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = FEATURES + 1
        products = np.zeros((size, size + 1))
        for frame in batches:
            f = model.features(_stacked(frame["stats"]))
            products += f.T @ np.column_stack([f, frame["label"].to_numpy(float)])
        yield pd.DataFrame({"row": np.arange(size), "sums": list(products)})

    return run


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": frame["row"].iloc[:1], "sums": [_stacked(frame["sums"]).sum(axis=0)]})


def isotonic(x: np.ndarray, mean: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours until means rise; centre and mean of every pool."""
    pools: list[list[float]] = []
    for value, m, c in zip(x, mean, count):
        pools.append([value * c, m * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    table = np.array(pools)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 5) -> Model:
    """``stats`` as of :func:`document_statistics`; ``labels``: doc_id and the 0/1 column ``label``.

    All labelled rows are fitted; only sums of the model's size reach the driver.
    A doc_id with several labels counts as their mean; without labelled rows every score is near 0.5.
    """
    width = len(STATISTICS)
    moments = stats.agg(
        *[F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(width)], *[F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(width)]
    ).first()
    mean = np.array([moments[f"m{k}"] or 0.0 for k in range(width)])
    scale = np.array([moments[f"s{k}"] or 1.0 for k in range(width)])
    rng = np.random.default_rng(seed)
    model = Model(
        mean, scale, rng.normal(size=(width, FEATURES)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, FEATURES),
        np.zeros(FEATURES + 1), np.zeros(1), np.full(1, 0.5),
    )
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.avg(F.col(label).cast("double")).alias("label"))
    )
    rows = stats.join(known, "doc_id").select("stats", "label")
    summed = rows.mapInPandas(_partial_sums(model), "row int, sums array<double>")
    table = summed.groupBy("row").applyInPandas(_add_up, "row int, sums array<double>").toPandas().sort_values("row")
    if not len(table):
        return model
    sums = _stacked(table["sums"])
    total = sums[-1, FEATURES]
    if not total:
        return model
    penalty = RIDGE * total * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model.weight = np.linalg.lstsq(sums[:, :-1] + penalty, sums[:, -1], rcond=None)[0]

    @F.pandas_udf("double")
    def raw_score(s: pd.Series) -> pd.Series:
        return pd.Series(model.features(_stacked(s)) @ model.weight)

    place = F.floor(F.least(F.greatest(F.col("raw") * (BINS // 2) + BINS // 4, F.lit(0.0)), F.lit(BINS - 1.0)))
    binned = (
        rows.select("label", raw_score("stats").alias("raw"))
        .groupBy(place.alias("bin"))
        .agg(F.avg("raw").alias("raw"), F.avg("label").alias("mean"), F.count(F.lit(1)).alias("n"))
        .toPandas()
        .sort_values("bin")
    )
    model.raw, model.calibrated = isotonic(*(binned[c].to_numpy(float) for c in ("raw", "mean", "n")))
    return model


def score(stats: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``stats`` with ``score`` and ``predicted``, one row per row; empty texts score like any point of the space."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model.scores(_stacked(s)))

    return stats.withColumn("score", run("stats")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
