"""Toxicity scores by follow-the-regularised-leader logistic regression over hashed n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.llm.common import id_crc32, mix64, modest_batches, text_or_empty, unit_interval, word_hashes

#: Log2 of the number of coordinates: bounds the model whatever the corpus.
BITS = 20
#: Labelled rows that are fitted, in expectation; the sample is taken by a hash of doc_id.
MAX_LABELLED = 24_000
#: The sample is fitted in shards of about this many rows; their weights are averaged.
SHARD_ROWS = 6_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 10.0, 1.0, 5.0, 0.1
#: Coordinates seen in fewer texts of a shard get no weight.
LEAST_TEXTS = 4

_BREAKS = np.zeros(256, bool)
_BREAKS[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True


@dataclass
class Model:
    """Non-zero weights only, and the log-odds of a text without known features."""

    index: np.ndarray
    weight: np.ndarray
    bias: float


def coordinates(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed words, pairs of neighbours, and pairs with one word between, of the whole text."""
    h = word_hashes(text, _BREAKS)
    pairs = mix64(h[:-1] * np.uint64(3) + h[1:])
    skips = mix64(h[:-2] * np.uint64(5) + h[2:])
    return (np.concatenate([h, pairs, skips]) & np.uint64(2**bits - 1)).astype(np.int64)


def _weights(z: np.ndarray, n: np.ndarray, l1: float) -> np.ndarray:
    """Per-coordinate rates fall with the gradients seen; |z| up to ``l1`` gives no weight."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _fit_shard(bias: float, l1: float, least_texts: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("order", kind="stable")
        z, n = np.zeros(2**BITS), np.zeros(2**BITS)
        rows = [(np.unique(coordinates(t)), y) for t, y in zip(frame["text"], frame["label"])]
        seen = np.zeros(2**BITS, np.int32)
        for at, _ in rows:
            seen[at] += 1
        rows = [(at[seen[at] >= least_texts], y) for at, y in rows]
        for _ in range(EPOCHS):
            for at, y in rows:
                w = _weights(z[at], n[at], l1)
                g = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + w.sum())))) - y
                grown = n[at] + g * g
                z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
                n[at] = grown
        w = _weights(z, n, l1)
        kept = np.flatnonzero(w)
        return pd.DataFrame({"at": kept, "w": w[kept]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_labelled: int = MAX_LABELLED, l1: float = L1, least_texts: int = LEAST_TEXTS) -> Model:
    """``labels``: doc_id and the 0/1 column ``label``; rows without either are left out.

    A doc_id with several labels counts as 1 if one of them is.  Without labelled
    rows the model knows a low prior only.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("double")).alias("label"))
    )
    total = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    bias = math.log((total["ones"] + 1) / (total["n"] - total["ones"] + 19))
    sampled = known.filter(unit_interval(F.xxhash64(F.lit(3), "doc_id")) < max_labelled / max(1, total["n"]))
    # bounded by max_labelled, so it may go to every task
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sampled), "doc_id")
    order = F.xxhash64(F.lit(4), "doc_id", "text")
    shards = math.ceil(min(max_labelled, max(1, total["n"])) / SHARD_ROWS)
    sharded = texts.select("text", "label", order.alias("order"), F.pmod(order, F.lit(shards)).alias("shard"))
    fitted = sharded.groupBy("shard").applyInPandas(_fit_shard(bias, l1, least_texts), "at long, w double")
    # at most 2 ** BITS rows
    found = fitted.groupBy("at").agg((F.sum("w") / shards).alias("w")).toPandas().sort_values("at")
    return Model(found["at"].to_numpy(np.int64), found["w"].to_numpy(float), bias)


def scorer(model: Model):
    """A column function from text to the probability of label 1."""

    @F.pandas_udf("double")
    def run(text: pd.Series) -> pd.Series:
        dense = np.zeros(2**BITS)
        dense[model.index] = model.weight
        out = np.empty(len(text))
        for k, t in enumerate(text):
            at = coordinates(t)
            at = np.unique(at[dense[at] != 0])
            out[k] = model.bias + dense[at].sum()
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, which replace columns of these names.

    Null and empty texts have no features and get the model's prior; very long
    ones are scored whole; equal texts score alike.
    """
    modest_batches(docs.sparkSession)
    scored = docs.withColumn("score", scorer(model)(text_or_empty()))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def training_labels(labels: DataFrame, parts: int, held_out: int) -> DataFrame:
    """Labels of the rows that are not held out."""
    return labels.filter(id_crc32() % parts != held_out)
