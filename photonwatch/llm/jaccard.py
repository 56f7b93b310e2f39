"""Documents whose shingle sets overlap: an exact Jaccard self-join that never lists all pairs of a group."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from photonwatch.llm.common import mix64, modest_batches, released, shingle_hashes, spread_count, stored, text_or_empty, word_hashes
from photonwatch.llm.components import components

#: A segment that more sets than this share is worth skipping.
CROWDED = 30
#: Bits of the sketch by which far pairs are told apart before their sets are fetched.
SKETCH_LONGS = 64
#: The same where many rows carry it.
FOLDED_LONGS = 8
#: Buckets of a set, about, that go along to tell in which of several common buckets a pair counts.
MARKS = 16
#: Buckets that a task holds, about, before it deals them out.
PACKED = 2**18
#: Sizes grow by this factor from band to band.
BAND = 1.5
#: Low bits of a bucket: the band, and whether its segment has one-deletion neighbours.
_BAND_BITS = 7


@dataclass(frozen=True)
class Band:
    """How sets of ``low`` to ``high`` shingles, and larger partners of theirs, are cut into segments.

    The first ``deletions`` of the segments allow one difference, the others
    none.  A pair within the threshold differs in ``slack`` fewer places than
    segments and allowances together, plus one, so each set may skip ``slack``
    segments that allow none.
    """

    number: int
    low: int
    high: int
    largest: int
    segments: int
    deletions: int
    slack: int


def _most_differences(percent: int, a: int, b: int) -> int:
    """Largest symmetric difference of sets of these sizes whose Jaccard similarity reaches the threshold."""
    return (a + b) * (100 - percent) // (100 + percent)


def _allocate(number: int, low: int, high: int, percent: int) -> Band:
    """Cheapest split of the allowance: more exact segments, or fewer with one-deletion neighbours.

    The cost of a set is the rows it emits plus what thin segments find by chance,
    which falls by half for every further shingle in a segment; sketches make
    such finds cheap.
    """
    largest = high * 100 // percent
    need = _most_differences(percent, high, largest) + 1
    size = (low + high) / 2
    best = None
    for deletions in {0, 1, need // 8, need // 4, need // 2}:
        segments = max(1, need - deletions, deletions)
        slack = 0
        for _ in range(4):  # the expected empty segments depend on the number of segments
            empty = segments * (1 - 1 / segments) ** size if segments > 1 else 0.0
            slack = (math.ceil(empty + 3 * math.sqrt(empty)) if empty > 0.01 else 0) + need // 12
            segments = max(1, need + slack - deletions, deletions)
        load = size / segments
        chance = 4 * 0.5**load
        cost = (segments - deletions) * (1 + chance) + deletions * (1 + load + 4 * chance)
        if best is None or cost < best[0]:
            best = (cost, segments, deletions, segments + deletions - need)
    _, segments, deletions, slack = best
    return Band(number, low, high, largest, segments, deletions, slack)


@lru_cache(maxsize=4)
def bands(percent: int) -> tuple[Band, ...]:
    out, low, step = [], 1, max(BAND, 100 / percent)
    while len(out) < 2**_BAND_BITS and low < 2**48:
        high = max(low, int(low * step) - 1)
        out.append(_allocate(len(out), low, high, percent))
        low = high + 1
    return tuple(out)


def _bands_of(size: int, percent: int) -> list[Band]:
    """The bands in which a set of ``size`` shingles takes part."""
    every = bands(percent)
    last = bisect_right(every, size, key=lambda b: b.low)
    first = last
    while first and every[first - 1].largest >= size:
        first -= 1
    return list(every[first:last])


@lru_cache(maxsize=32)
def _names(band: Band) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each segment's number, and the low bits of its buckets."""
    tag = np.full(band.segments, band.number * 2, np.uint64)
    tag[: band.deletions] += np.uint64(1)
    return mix64(np.arange(band.segments, dtype=np.uint64) + np.uint64(band.number + 1) * np.uint64(2**32)), tag


def buckets(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a set in every band it takes part in, and whether a shingle was deleted for it.

    A bucket is a hash of band, segment and the segment's shingles.
    """
    found, deleted = [], []
    mixed = mix64(shingles + np.uint64(1))
    for band in _bands_of(len(shingles), percent):
        names, tag = _names(band)
        place = (shingles >> np.uint64(20)) % np.uint64(band.segments)
        place = place.astype(np.uint16 if band.segments < 2**16 else np.int64)  # short numbers are sorted in fewer steps
        order = np.argsort(place, kind="stable")
        dealt = place[order]
        starts = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1]))
        sums = np.zeros(band.segments, np.uint64)
        sums[dealt[starts]] = np.add.reduceat(mixed[order], starts)
        mask = np.uint64(2 ** (_BAND_BITS + 1) - 1)
        found.append((mix64(sums + names) & ~mask) | tag)
        deleted.append(np.zeros(band.segments, bool))
        near = np.flatnonzero(place < band.deletions)
        if len(near):
            at = place[near]
            less = sums[at] - mixed[near]
            found.append((mix64(less + names[at]) & ~mask) | tag[at])
            deleted.append(np.ones(len(near), bool))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(found), np.concatenate(deleted)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Whether each of the sketch's bits got an odd number of shingles: two sketches differ in no more bits than the sets in shingles."""
    bits = np.bincount((shingles & np.uint64(64 * SKETCH_LONGS - 1)).astype(np.int64), minlength=64 * SKETCH_LONGS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


_SKETCH = "struct<" + ",".join(f"k{k}:bigint" for k in range(SKETCH_LONGS)) + ">"


def _fingerprint(shingles: np.ndarray) -> int:
    """64 bits that depend on all shingles of the set; 0 for the empty one."""
    if not len(shingles):
        return 0
    first = np.bitwise_xor.reduce(mix64(shingles + np.uint64(11)), keepdims=True)
    second = np.add.reduce(mix64(shingles + np.uint64(29)), keepdims=True)
    return int(mix64(first * np.uint64(3) + second + np.uint64(len(shingles))).view(np.int64)[0])


def _describe(width: int):
    """Per text: size, fingerprint and sketch of its set."""
    longs = pa.struct([(f"k{k}", pa.int64()) for k in range(SKETCH_LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = (shingle_hashes(word_hashes(t.as_py()), width) for t in batch.column(2))
            sizes, ids, sketches = zip(*((len(s), _fingerprint(s), sketch(s)) for s in sets))
            bits = [pa.array(c, pa.int64()) for c in np.array(sketches).T]
            columns = [pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.StructArray.from_arrays(bits, fields=list(longs))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_hash", "n_shingles", "id", "sketch"])

    return run


def _signatures(width: int, percent: int, parts: int):
    """Buckets and sets that have them, dealt to ``parts`` by bucket: one row a part for some texts, not one for each of millions of buckets.

    A row holds its buckets and ids as packed arrays, those for which no shingle was deleted (``whole`` of them) first.
    """

    def packed(found: list, deleted: list, ids: list) -> pa.RecordBatch:
        sets = np.repeat(np.array(ids, np.int64), [len(f) for f in found])
        bucket, less = np.concatenate(found), np.concatenate(deleted)
        place = (_part(bucket, parts) * 2 + less).astype(np.uint32)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(2 * parts + 1))
        used = np.flatnonzero(edges[2::2] > edges[:-2:2])
        ends = np.append(edges[2 * used], len(order)) * 8
        if len(used) and edges[-1] * 8 > 2**31 - 1:
            raise ValueError("a text has too many shingles")
        offsets = pa.py_buffer(ends.astype(np.int32))
        columns = [pa.Array.from_buffers(pa.binary(), len(used), [None, offsets, pa.py_buffer(v[order])]) for v in (bucket, sets)]
        whole = edges[2 * used + 1] - edges[2 * used]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(whole, pa.int64()), *columns], names=["part", "whole", "buckets", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, deleted, ids, known, held = [], [], [], set(), 0
        for batch in batches:
            for text in batch.column(0):
                s = shingle_hashes(word_hashes(text.as_py()), width)
                own = _fingerprint(s)
                if own in known or not len(s):  # equal sets give equal rows
                    continue
                known.add(own)
                bucket, less = buckets(s, percent)
                found.append(bucket)
                deleted.append(less)
                ids.append(own)
                held += len(bucket)
                if held >= PACKED:  # bounds what a task holds
                    yield packed(found, deleted, ids)
                    found, deleted, ids, held = [], [], [], 0
                    if len(known) > 100_000:
                        known = set()
        if held:
            yield packed(found, deleted, ids)

    return run


def _part(bucket: np.ndarray, parts: int) -> np.ndarray:
    """Number of the part of each bucket, by bits that do not name its band."""
    return (bucket >> np.uint64(_BAND_BITS + 1)) % np.uint64(parts)


_SHARED = "bucket long, id long, deleted boolean, centre long, crowd long"


def _met(rows: pa.Table) -> pa.Table:
    """Of the packed rows of a part, the buckets of two sets or more that one has whole, as :meth:`_Join.shared` gives them."""
    chunks = [[np.frombuffer(v.as_buffer(), kind) for v in rows.column(c)] for c, kind in (("buckets", np.uint64), ("ids", np.int64))]
    bucket, sets = (np.concatenate(c) for c in chunks)
    deleted = np.concatenate([np.arange(len(b)) >= n for b, n in zip(chunks[0], rows.column("whole").to_pylist())])
    order = np.argsort(bucket)
    bucket = bucket[order]
    same = bucket[1:] == bucket[:-1]
    alone = ~(np.append(same, False) | np.append(False, same))
    bucket, order = bucket[~alone], order[~alone]
    sets, deleted = sets[order], deleted[order]
    # a set that comes twice counts once
    order = np.lexsort((sets, deleted, bucket))
    bucket, sets, deleted = bucket[order], sets[order], deleted[order]
    new = np.ones(len(bucket), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (deleted[1:] != deleted[:-1]) | (sets[1:] != sets[:-1])
    bucket, sets, deleted = bucket[new], sets[new], deleted[new]
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(bucket)))
    if len(first):
        low, high = np.minimum.reduceat(sets, first), np.maximum.reduceat(sets, first)
        crowd = np.add.reduceat((~deleted).astype(np.int64), first)
        # in order, so that the first row of a bucket that some set has whole is the smallest such id
        keep = (low != high) & (crowd > 0)
    else:
        crowd, keep = np.zeros(0, np.int64), np.zeros(0, bool)
    every = np.repeat(keep, size)
    centre, crowd = np.repeat(sets[first], size)[every], np.repeat(crowd, size)[every]
    columns = [bucket[every].view(np.int64), sets[every], deleted[every], centre, crowd]
    return pa.table(columns, names=["bucket", "id", "deleted", "centre", "crowd"])


def _shingle_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_hashes(word_hashes(t), width).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run


def _verify(percent: int):
    """Pairs whose sets, compared shingle by shingle, reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            kept = batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            if kept.num_rows:
                yield kept

    return run


def _may_link(percent: int, longs: int) -> Column:
    """What linked pairs (x.n, x.sketch, y.n, y.sketch) always meet: close sizes, and sketches that differ in few bits."""
    x, y = F.col("x.n"), F.col("y.n")
    close = F.least(x, y) * 100 >= F.greatest(x, y) * percent
    apart = sum((F.bit_count(F.col(f"x.sketch.k{k}").bitwiseXOR(F.col(f"y.sketch.k{k}"))) for k in range(longs)), F.lit(0))
    return close & (apart * (100 + percent) <= (x + y) * (100 - percent))


def _folded(longs: int) -> Column:
    """The sketch in fewer bits: places that fall together add up, odd or even."""
    parts = []
    for k in range(longs):
        part = F.col(f"sketch.k{k}")
        for j in range(k + longs, SKETCH_LONGS, longs):
            part = part.bitwiseXOR(F.col(f"sketch.k{j}"))
        parts.append(part.alias(f"k{k}"))
    return F.struct(*parts)


def _marked(bucket: Column, level: Column) -> Column:
    """One bucket in 2 ** level is marked, by bits that are the same in all sets; a higher level marks some of those of a lower one."""
    return F.shiftright(bucket, _BAND_BITS + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), level) - 1) == 0


def _marks(buckets: DataFrame) -> DataFrame:
    """Of every id a level, and its own buckets marked at that level: about ``MARKS`` of them, all if it has fewer."""
    own = F.collect_set(F.when(~F.col("deleted"), F.col("bucket")))
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.size("own"), F.lit(1)) / MARKS)).cast("int"))
    levels = buckets.groupBy("id").agg(own.alias("own")).withColumn("level", level)
    return levels.select("id", "level", F.filter("own", lambda b: _marked(b, F.col("level"))).alias("marks"))


def _met_once() -> Column:
    """Similar sets share many buckets: a pair counts in the least of its common marked ones, and in every bucket only if it has none."""
    level = F.greatest("x.level", "y.level")
    # marks of the higher level are among those of the lower one, if both sets have the bucket
    common = F.array_intersect("x.marks", "y.marks")
    whole = ~F.col("x.deleted") & ~F.col("y.deleted") & _marked(F.col("x.bucket"), level)
    return F.when(whole, F.col("x.bucket") == F.array_min(common)).otherwise(F.size(common) == 0)


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (a, b) whose components differ."""
    a, b = (found.select(F.col("id").alias(c), F.col("component").alias(f"_{c}")) for c in "ab")
    known = pairs.join(a, "a", "left").join(b, "b", "left")
    return stored(known.filter(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b"))


#: Up to so many sets their keys are broadcast, some 50 bytes each, to fetch texts without a shuffle.
BROADCAST_SETS = 200_000


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        modest_batches(docs.sparkSession)
        self.docs, self.width, self.percent = docs.select("doc_id", text_or_empty().alias("text")), width, percent
        hashed = self.docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
        kind = docs.schema["doc_id"].dataType.simpleString()
        self.rows = stored(hashed.mapInArrow(_describe(width), f"doc_id {kind}, text_hash long, n_shingles long, id long, sketch {_SKETCH}"))
        # of rows with equal sets any one will do; null doc_ids sort first
        place = F.struct("doc_id", "text_hash")
        shown = F.struct("doc_id", "text_hash", "n_shingles", "sketch")
        classes = self.rows.filter("n_shingles > 0").groupBy("id").agg(F.min_by(shown, place).alias("c"))
        self.classes = stored(classes.select("id", "c.*"))

    def shared(self) -> DataFrame:
        """Buckets with two sets or more: bucket, id, deleted, centre (smallest id with the bucket itself) and crowd.

        Sets that can afford it skip their crowded segments.
        """
        parts = 8 * spread_count(self.docs.sparkSession, 8)
        emitted = self.docs.select("text").mapInArrow(_signatures(self.width, self.percent, parts), "part int, whole long, buckets binary, ids binary")
        met = stored(emitted.groupBy("part").applyInArrow(_met, _SHARED))
        band = F.col("bucket").bitwiseAND(F.lit(2 ** (_BAND_BITS + 1) - 1))
        skippable = (F.col("crowd") > CROWDED) & (band % 2 == 0)
        slack = F.element_at(F.array(*[F.lit(b.slack) for b in bands(self.percent)]), (F.floor(band / 2) + 1).cast("int"))
        own = Window.partitionBy("id", F.floor(band / 2))
        spared = met.withColumn("_skip", skippable & (F.count_if(skippable).over(own) <= slack))
        return spared.filter(~F.col("_skip")).drop("_skip")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of class ids that are linked."""
        wanted = pairs.select("a").union(pairs.select("b")).distinct().select(F.col("a").alias("id"))
        place = stored(self.classes.select("id", "doc_id", "text_hash").join(wanted, "id", "left_semi"))
        if place.count() <= BROADCAST_SETS:
            place = F.broadcast(place)
        hashed = self.docs.withColumn("text_hash", F.xxhash64("text"))
        same = hashed["doc_id"].eqNullSafe(place["doc_id"]) & (hashed["text_hash"] == place["text_hash"])
        texts = hashed.join(place, same).select("id", "text")
        # rows that repeat give the same id twice
        sets = texts.mapInArrow(_shingle_bytes(self.width), "id long, shingles binary").dropDuplicates(["id"])
        left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
        both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
        return both.mapInArrow(_verify(self.percent), "a long, b long")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of class ids whose sketches allow a link."""
        known = self.classes.select("id", F.col("n_shingles").alias("n"), "sketch")
        met = pairs.distinct().join(known.alias("x"), F.col("a") == F.col("x.id")).join(known.alias("y"), F.col("b") == F.col("y.id"))
        return stored(met.filter(_may_link(self.percent, SKETCH_LONGS)).select("a", "b"))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links that connect every component, and class id and component of all linked classes."""
        shared = stored(self.shared())
        released(shared.sparkSession)
        star = self.likely(shared.filter("id != centre").select(F.col("id").alias("a"), F.col("centre").alias("b")))
        # one centre for each set first: that joins most of a group; then the centres of other components
        first = stored(self.verified(stored(star.groupBy("a").agg(F.min("b").alias("b")))))
        found = components(first)
        first = first.union(stored(self.verified(_apart(star, found))))
        found = components(first)
        released(shared.sparkSession)
        # what the centres left apart: pairs in different components that share a bucket
        known = self.classes.select("id", F.col("n_shingles").alias("n"), _folded(FOLDED_LONGS).alias("sketch"))
        label = shared.join(found, "id", "left").join(known, "id")
        label = label.select("bucket", "id", "deleted", "n", "sketch", F.coalesce("component", "id").alias("component"))
        apart = Window.partitionBy("bucket")
        mixed = stored(label.withColumns({"_low": F.min("component").over(apart), "_high": F.max("component").over(apart)}).filter("_low != _high"))
        both = F.expr("x.bucket = y.bucket and x.id > y.id and x.component != y.component and not (x.deleted and y.deleted)")
        listed = mixed.join(_marks(mixed), "id")
        met = listed.alias("x").join(listed.alias("y"), both & _may_link(self.percent, FOLDED_LONGS) & _met_once())
        second = stored(self.verified(self.likely(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))))
        edges = first.union(second)
        if second.isEmpty():
            return edges, found
        return edges, components(edges)


def similar_documents(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    A text's set holds its distinct runs of ``width`` words (A-Z lower-cased, cut
    at white space); a text of fewer words is one run, one without words has an
    empty set and is linked with nothing.  Two rows are linked if 100 times the
    common shingles reach ``percent`` times all of theirs.

    Rows with equal sets form a class.  Class sets are cut into segments by a
    hash, as many as the differences that the threshold allows call for, so
    linked sets share a whole segment (or, where that is cheaper, one up to a
    deleted shingle).  In each shared bucket all sets are first compared with its
    smallest; components are formed; then pairs that share a bucket but no
    component are compared.  Pairs whose sketches differ in more bits than linked
    sets in shingles are left out before any set is fetched.  So no link between components is lost, and a large
    group of near copies costs one comparison per set and bucket, not one per pair.

    Null and empty texts count as empty; null doc_ids sort last and are never a
    component's smallest unless it has no other; repeated rows are kept.
    Shingles are compared as 64-bit hashes, and a class is known by 64 bits of its set.
    """
    work = _Join(docs, width, percent)
    _, found = work.links()
    named = work.rows.select("doc_id", "n_shingles", "id").join(found, "id", "left")
    named = named.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).alias("component"))
    smallest = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    # stored, so that the join is one of which Spark can split a large component
    out = named.join(stored(smallest), "component", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all columns, of each component one row: the least by doc_id (null last), then by a hash of the text.

    Texts without words all stay.  Rows are told apart by doc_id and text, so
    other texts of a doc_id stay; of rows that repeat both, one stays.
    """
    work = _Join(docs, width, percent)
    _, found = work.links()
    named = work.rows.filter("n_shingles > 0").select("doc_id", "text_hash", "id").join(found, "id", "left")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    named = named.select(F.coalesce("component", "id").alias("component"), place.alias("place"))
    first = stored(named.groupBy("component").agg(F.min("place").alias("first")))
    listed = named.join(first, "component").groupBy("place").agg(F.first("first").alias("first"), F.count(F.lit(1)).alias("copies"))
    known = stored(listed.filter("place != first or copies > 1").select("place.doc_id", "place.text_hash", (F.col("place") == F.col("first")).alias("stays")))
    hashed = docs.withColumn("_pw_hash", F.xxhash64(text_or_empty()))

    def met(which: DataFrame, how: str) -> DataFrame:
        own = which.select(F.col("doc_id").alias("_pw_id"), F.col("text_hash").alias("_pw_of"))
        own = F.broadcast(own) if own.count() <= BROADCAST_SETS else own
        return hashed.join(own, hashed["doc_id"].eqNullSafe(own["_pw_id"]) & (hashed["_pw_hash"] == own["_pw_of"]), how)

    out, repeated = met(known, "left_anti"), known.filter("stays")
    if not repeated.isEmpty():
        out = out.unionByName(met(repeated, "left_semi").dropDuplicates(["doc_id", "_pw_hash"]))
    return out.drop("_pw_hash")
