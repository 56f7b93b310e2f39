"""The trie of all conversations' turns, found by peeling off last turns."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photonwatch.llm.common import in_order, spread_count, stored
from photonwatch.session import shared_folder

#: Turns of a conversation that are hashed together; their sums alone are carried on.
CHUNK = 256
#: Levels of a path that a node carries before it fetches the next ones.
BAND = 32
#: Hash of no conversations.
NOTHING = hashlib.sha256(b"").hexdigest()

_BEFORE = (Window.unboundedPreceding, -1)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), t1, t2 (hashes of role and text), words, n_turns: every row in its conversation's order.

    By turn, null first; rows of one turn by the hashes.  Null role and text are
    empty; rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        *[F.xxhash64(F.lit(k), role, text).alias(f"t{k}") for k in (1, 2)],
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    part = F.shiftrightunsigned("pos", 33).alias("part")
    placed = in_order(stored(narrow), "conv_id", "turn", "t1", "t2").select("*", part)
    # one row per conversation and task says how many rows stand before
    sizes = placed.groupBy("conv_id", "part").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy("conv_id")
    sizes = sizes.select(
        "conv_id", "part", "_first",
        F.coalesce(F.sum("_n").over(over.orderBy("part").rowsBetween(*_BEFORE)), F.lit(0)).alias("_before"), F.sum("_n").over(over).alias("n_turns"),
    )
    known = placed.join(sizes, ["conv_id", "part"])
    return known.select("conv_id", (F.col("pos") - F.col("_first") + F.col("_before") + 1).alias("place"), "t1", "t2", "words", "n_turns")


def rebuilt(rows: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their group: all ids, and (conv_id, depth, t1, t2, words) of their turns.

    ``rows`` as of ``turns``.  The first h turns of conversation c - c % group (all
    if it has fewer) take the place of c's own first h, h = crc32 of the decimal c,
    modulo ``most`` + 1.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h")
    ids = stored(rows.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns")))
    heads = stored(rows.filter((F.col("place") <= most) & (F.col("conv_id") % group == 0)))
    roots = ids.select(F.col("conv_id").alias("root"), F.col("n_turns").alias("n_root"))
    root = (F.col("conv_id") - F.col("conv_id") % group).alias("root")
    asked = ids.select("conv_id", root, h).join(roots, "root", "left")
    taken = asked.select("conv_id", "root", "h", F.least(F.col("h"), F.coalesce("n_root", F.lit(0))).alias("taken"))
    # at most ``group`` conversations meet at most ``most`` turns each
    first = taken.join(heads.drop("n_turns").withColumnRenamed("conv_id", "root"), "root").filter(F.col("place") <= F.col("h"))
    first = first.select("conv_id", F.col("place").alias("depth"), "t1", "t2", "words")
    own = rows.select("*", h).filter(F.col("place") > F.col("h"))
    # only conversations that got fewer turns than they gave up move
    short = taken.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("up"))
    own = own.join(short, "conv_id", "left").select(
        "conv_id", (F.col("place") - F.coalesce("up", F.lit(0))).alias("depth"), "t1", "t2", "words"
    )
    return ids.select("conv_id"), first.unionByName(own)


def paths(listed: DataFrame) -> DataFrame:
    """``listed`` (conv_id, depth, t1, t2, words) with x1, x2, which name the first ``depth`` turns, p1, p2, which name those before, and ``upto``, all words so far.

    A name is the exclusive or of hashes of every turn with its depth, so chunks
    of a long conversation are summed apart and put together by one row each.
    """
    hashed = listed.select(
        "conv_id", "depth", "words", F.floor((F.col("depth") - 1) / CHUNK).alias("chunk"),
        *[F.xxhash64(F.lit(k), "depth", f"t{k}").alias(f"e{k}") for k in (1, 2)],
    )
    inside = Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = hashed.withColumns({"r1": F.bit_xor("e1").over(inside), "r2": F.bit_xor("e2").over(inside), "rw": F.sum("words").over(inside)})
    whole = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("e1").alias("e1"), F.bit_xor("e2").alias("e2"), F.sum("words").alias("w"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(*_BEFORE)
    carried = whole.select("conv_id", "chunk", *[F.coalesce(f(c).over(before), F.lit(0)).alias(n) for f, c, n in ((F.bit_xor, "e1", "c1"), (F.bit_xor, "e2", "c2"), (F.sum, "w", "cw"))])
    x1, x2 = (F.col(f"r{k}").bitwiseXOR(F.col(f"c{k}")) for k in (1, 2))
    return rows.join(carried, ["conv_id", "chunk"]).select(
        "conv_id", "depth", "words", x1.alias("x1"), x2.alias("x2"), x1.bitwiseXOR(F.col("e1")).alias("p1"), x2.bitwiseXOR(F.col("e2")).alias("p2"),
        (F.col("rw") + F.col("cw")).alias("upto"),
    )


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by sequence and conv_id: of each sequence the smallest conv_id, their count and the hash of their list.

    Ids run through the hash as they come; nothing of a sequence is held.
    """
    key, row, digest = None, None, None
    for frame in batches:
        out = []
        for values in zip(*(frame[c].tolist() for c in ("depth", "x1", "x2", "upto", "conv_id"))):
            if values[:3] != key:
                if row:
                    out.append((*row, digest.hexdigest()))
                key, row, digest = values[:3], [*values, 0], hashlib.sha256(str(values[4]).encode())
            else:
                digest.update(b",%d" % values[4])
            row[5] += 1
        yield pd.DataFrame(out, columns=["depth", "x1", "x2", "upto", "conv_id", "n", "ends"])
    if row:
        yield pd.DataFrame([(*row, digest.hexdigest())], columns=["depth", "x1", "x2", "upto", "conv_id", "n", "ends"])


def sequences(ids: DataFrame, path: DataFrame) -> DataFrame:
    """Distinct whole sequences: depth (their length), x1, x2, upto (words), conv_id (smallest), n, ends (hash of their conv_ids)."""
    last = path.groupBy("conv_id").agg(F.max_by(F.struct("depth", "x1", "x2", "upto"), "depth").alias("l"))
    named = ids.join(last, "conv_id", "left")
    none = F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("depth", "x1", "x2", "upto")])
    named = named.withColumn("l", F.coalesce("l", none)).select("conv_id", "l.*")
    dealt = named.repartition(spread_count(ids.sparkSession), "depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "conv_id")
    return dealt.mapInPandas(_ended, "depth long, x1 long, x2 long, upto long, conv_id long, n long, ends string")


def _at(d: int) -> int:
    """Band of depth ``d``."""
    return (d - 1) // BAND


def _merged(items: DataFrame, d: int) -> DataFrame:
    """Nodes of depth ``d`` from what came down to it: ended sequences and stripped nodes of the level below."""
    met = items.groupBy("x1", "x2").agg(
        F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.min_by("path", "conv_id").alias("path"),
    )
    here: Column | None = F.col("path")[(d - 1) % BAND] if d else None
    own = (F.col("n") - 1) * here["words"] if d else F.lit(0)
    return met.select(
        F.lit(d).cast("bigint").alias("depth"), "x1", "x2", "conv_id", "n", "children",
        F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")).cast("bigint").alias("leaves"), (F.col("saved") + own).cast("bigint").alias("saved"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends"), (here["p1"] if d else F.lit(None).cast("bigint")).alias("p1"),
        (here["p2"] if d else F.lit(None).cast("bigint")).alias("p2"), "path",
    )


def prefix_trie(ids: DataFrame, listed: DataFrame) -> DataFrame:
    """All nodes of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``ids`` holds every conversation, ``listed`` their turns (conv_id, depth from 1
    without gaps, t1, t2, words).  Equal conversations are one sequence from the
    start.  Below the deepest level that two different sequences share, a
    sequence stands alone and its nodes follow from it.  From there one round per
    level goes up to the root: sequences that end at the level join the nodes that
    came up, equal prefixes are merged and give a node, and each node loses its
    last turn.  Each round is one grouped sum with partial sums in the tasks, and
    is stored; so its cost is the number of nodes, not of conversations, and there
    are as many rounds as the longest prefix shared by different sequences has turns.

    A conversation without turns is a member of the root alone; no conversations
    make no nodes.  Turns are compared by 128 bits of hash.
    """
    spark = ids.sparkSession
    path = stored(paths(listed))
    ended = stored(sequences(ids, path))
    own = stored(path.join(ended.select("conv_id", F.col("depth").alias("length"), F.col("upto").alias("all"), "n", "ends"), "conv_id"))
    shared = own.groupBy("depth", "x1", "x2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.max("depth").alias("d")).first()["d"] or 0
    top = shared + 1
    tail = own.filter(F.col("depth") > top).select(
        "conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("depth") < F.col("length")).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"),
        ((F.col("n") - 1) * (F.col("all") - F.col("upto") + F.col("words"))).alias("saved_tokens"),
        F.when(F.col("depth") == F.col("length"), F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )
    step = F.struct("depth", "words", "p1", "p2")
    bands = own.filter(F.col("depth") <= top).groupBy("conv_id", F.floor((F.col("depth") - 1) / BAND).alias("band"))
    bands = stored(bands.agg(F.array_sort(F.collect_list(step)).alias("path")))
    # where a sequence comes in, what it is called there, and what of it lies below
    at = F.least(F.col("depth"), F.lit(top))
    cut = own.filter(F.col("depth") == top).select("conv_id", F.col("x1").alias("c1"), F.col("x2").alias("c2"), F.col("upto").alias("cw"))
    deep = F.col("depth") > top
    entry = ended.join(cut, "conv_id", "left").select(
        at.alias("at"), F.when(deep, F.col("c1")).otherwise(F.col("x1")).alias("x1"), F.when(deep, F.col("c2")).otherwise(F.col("x2")).alias("x2"),
        "conv_id", "n", deep.cast("bigint").alias("children"), deep.cast("bigint").alias("leaves"),
        F.when(deep, (F.col("n") - 1) * (F.col("upto") - F.col("cw"))).otherwise(0).alias("saved"), F.when(~deep, F.col("ends")).alias("ends"),
        F.floor((at - 1) / BAND).alias("band"),
    )
    entry = stored(entry.join(bands, ["conv_id", "band"], "left").drop("band").sortWithinPartitions("at"))
    columns = ["x1", "x2", "conv_id", "n", "children", "leaves", "saved", "ends", "path"]
    base, nodes = f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}", None
    for d in range(top, -1, -1):
        items = entry.filter(F.col("at") == d).select(*columns)
        if nodes is not None:
            stripped = nodes.select(
                F.col("p1").alias("x1"), F.col("p2").alias("x2"), "conv_id", "n", F.lit(1).cast("bigint").alias("children"), "leaves", "saved",
                F.lit(None).cast("string").alias("ends"), "path",
            )
            if d and _at(d) != _at(d + 1):
                stripped = stripped.drop("path").join(bands.filter(F.col("band") == _at(d)).drop("band"), "conv_id")
            items = items.unionByName(stripped)
        level = _merged(items, d)
        level.write.parquet(f"{base}/{d}")
        nodes = spark.read.schema(level.schema).parquet(f"{base}/{d}")
    found = spark.read.schema(nodes.schema).parquet(*[f"{base}/{d}" for d in range(top + 1)])
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    peeled = found.join(above, ["depth", "p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return peeled.unionByName(tail)
