"""Words in a row that an earlier document holds too, wherever in a line or sentence they begin and end."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from photonwatch.llm.common import mix64, modest_batches, stored, text_or_empty, word_hashes

#: Words are runs of letters and digits, compared in lower case.
WORD = re.compile(r"[^\W_]+")
_BREAKS = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def _words(text: str) -> np.ndarray:
    """Hashes of the words, as many as ``WORD`` finds."""
    if not text.isascii():
        for c in sorted(set(text)):
            if not c.isascii() and not c.isalnum():
                text = text.replace(c, " ")
        text = text.lower()
    return word_hashes(text, _BREAKS)


_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _in_a_row(words: np.ndarray, *widths: int) -> list[np.ndarray]:
    """For each width the digests of so many words in a row, from prefix sums of word times power."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, len(words)), out=sums[1:])
    inverse = _powers(_INVERSE, len(words) + 1)
    counts = [max(0, len(words) - w + 1) for w in widths]
    return [mix64((sums[len(sums) - n :] - sums[:n]) * inverse[:n]) for n in counts]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` in a row."""
    have = 1
    while have < width:
        step = min(have, width - have)
        h, have = np.minimum(h[:-step], h[step:]), have + step
    return h


def _runs(text: str | None, width: int) -> tuple[np.ndarray, ...]:
    """Digests of all ``width`` words in a row, and the runs of these that have one mark: mark, first, number, digest of the run.

    The mark is the least hash of half as many words within, so it changes once in
    about ``width`` / 4 words, and equal words have equal marks wherever they stand.
    """
    words = _words(text or "")
    half = (width + 1) // 2
    rows, halves = _in_a_row(words, width, half)
    if not len(rows):
        return rows, rows, *[np.zeros(0, np.int32)] * 2, rows
    marks = _least(halves, width - half + 1)
    first = np.flatnonzero(np.concatenate([[True], marks[1:] != marks[:-1]]))
    n = np.diff(first, append=len(rows))
    sums = np.zeros(len(rows) + 1, np.uint64)
    # a word of the run's place in it goes into its digest
    np.cumsum(mix64(rows + (np.arange(len(rows)) - np.repeat(first, n)).astype(np.uint64)), out=sums[1:])
    return rows, marks[first], first.astype(np.int32), n.astype(np.int32), sums[first + n] - sums[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _each_run(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_runs(text, width)[1:] for text in batch["text"].to_pylist()]
            row = pa.array(np.repeat(np.arange(len(found)), [len(f[0]) for f in found]))
            mark, at, n, run = (np.concatenate([f[k] for f in found]) for k in range(4)) if found else [np.zeros(0, np.uint64)] * 4
            if len(row):
                columns = [batch["doc_id"].take(row), batch["_h"].take(row), _signed(mark), pa.array(at), pa.array(n), _signed(run)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_h", "mark", "at", "n", "run"])

    return run


def _each_row(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digests of all words in a row that begin in the listed runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (text, wanted) in enumerate(zip(batch["text"].to_pylist(), batch["at"].to_pylist())):
                rows, mark, first, n, _ = _runs(text, width)
                listed = np.isin(first, wanted)
                at = np.flatnonzero(np.repeat(listed, n)).astype(np.int32)
                same = pa.array(np.full(len(at), k))
                columns = [batch["doc_id"].take(same), batch["_h"].take(same), _signed(np.repeat(mark, n)[at]), pa.array(at), _signed(rows[at])]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_h", "mark", "at", "row"])

    return run


def _again(rows: DataFrame, *key: str) -> DataFrame:
    """Rows of keys that an earlier document holds too.

    Keys are counted per task before they travel and those of two documents or more
    are stored, so that rows meet them in a join of which Spark can split a hot key.
    """
    place, doc = F.struct("doc_id", "_h"), F.xxhash64("doc_id", "_h")
    found = rows.groupBy(*key).agg(F.min(place).alias("_first"), F.min(doc).alias("a"), F.max(doc).alias("b")).filter("a != b").drop("a", "b")
    return rows.join(stored(found), list(key)).filter(~place.eqNullSafe(F.col("_first"))).drop("_first")


def shared_words(docs: DataFrame, more_than: int = 50) -> DataFrame:
    """doc_id, _h (hash of the text) and ``shared``: (first, last) word of passages that an earlier document holds too.

    A passage is more than ``more_than`` words in a row; ``shared`` is sorted and may
    overlap.  Earlier: a smaller doc_id (null first), then the text's hash.  What
    repeats within one document alone is not listed.  Words in a row are compared by
    two digests, only where their mark is in two documents, and first as runs of one
    mark, so that a copy is a row a run; only runs that share a mark and differ are
    compared in all their words.
    """
    modest_batches(docs.sparkSession)
    width = more_than + 1
    texts = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("_h"), text_or_empty().alias("text"))
    own = [texts.schema["doc_id"], StructField("_h", LongType()), StructField("mark", LongType()), StructField("at", IntegerType())]
    runs = texts.mapInArrow(_each_run(width), StructType([*own, StructField("n", IntegerType()), StructField("run", LongType())]))

    place, doc = F.struct("doc_id", "_h"), F.xxhash64("doc_id", "_h")
    marks = runs.groupBy("mark").agg(F.min(doc).alias("a"), F.max(doc).alias("b")).filter("a != b").select("mark")
    met = stored(runs.join(stored(marks), "mark"))
    firsts = stored(met.groupBy("mark", "run").agg(F.min(place).alias("_first")))
    judged = stored(met.join(firsts, ["mark", "run"]).withColumn("again", ~place.eqNullSafe(F.col("_first"))).drop("_first", "run"))
    whole = judged.filter("again").select("doc_id", "_h", F.col("at").alias("first"), (F.col("at") + F.col("n") + F.lit(more_than - 1)).alias("last"))

    several = stored(firsts.groupBy("mark").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("mark"))
    wanted = judged.filter("NOT again").join(several, "mark").groupBy(F.col("doc_id").alias("_id"), F.col("_h").alias("_t"))
    wanted = stored(wanted.agg(F.collect_set("at").alias("at")))
    listed = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_id"]) & (texts["_h"] == wanted["_t"])).select("doc_id", "_h", "text", "at")
    rows = stored(listed.mapInArrow(_each_row(width), StructType([*own, StructField("row", LongType())])))
    part = _again(rows, "mark", "row").select("doc_id", "_h", F.col("at").alias("first"), (F.col("at") + F.lit(more_than)).alias("last"))

    return stored(whole.union(part).groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("shared")))
