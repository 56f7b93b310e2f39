"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import string
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photonwatch.session import shared_folder


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; ``lower`` does the same where a text is all ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def id_crc32(name: str = "doc_id") -> Column:
    """CRC-32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def unit_interval(hash64: Column) -> Column:
    """A 64-bit hash as a double from 0 up to, not including, 1."""
    return F.shiftrightunsigned(hash64, 11).cast("double") / F.lit(float(2**53))


def spread_count(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def modest_batches(spark: SparkSession) -> None:
    """Rows go to Python in batches of a few MB, so that a worker never holds ten thousand long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def stored(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    folder = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def in_order(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` sorted over all tasks and stored, with ``pos``, a number that rises with the order.

    Rows are dealt by ranges of the whole order, so a key that holds a third of
    them is spread like any other.  ``pos`` has no gaps within a task; its bits
    from 33 on name the task.
    """
    dealt = df.repartitionByRange(spread_count(df.sparkSession), *order).sortWithinPartitions(*order)
    return stored(dealt.withColumn("pos", F.monotonically_increasing_id()))


def released(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that are done.

    Spark deletes them when the driver collects the frames that made them, which
    may be long after; what the next steps read is stored by then.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


# -- hashes of words, whole texts at a time ------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers; those for texts of up to 64 KB are kept."""
    return _kept_powers(base, 2 ** max(12, (n - 1).bit_length()))[:n] if n <= 2**16 else _new_powers(base, n)


def _new_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_kept_powers = lru_cache(maxsize=32)(_new_powers)


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_bounds(data: np.ndarray, breaks: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every run of bytes that are not breaks."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~breaks[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(text: str | None, breaks: np.ndarray = _SPACES) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, in order.

    Prefix sums of byte times power give every word's polynomial without a loop
    over words; dividing by the power at its start makes it independent of place.
    """
    if not text:
        return np.zeros(0, np.uint64)
    data = _LOWER[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    start, end = word_bounds(data, breaks)
    if not len(start):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    poly = (sums[end] - sums[start]) * _powers(_INVERSE, len(data))[start]
    return mix64(poly + (end - start).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``width`` words; fewer words make one run, none make none."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = mix64(out + words[k : n + k])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]
