"""Documents that hold passages of benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch.llm.common import ascii_lower, text_or_empty

# a word is a run of ASCII letters, digits and characters beyond ASCII
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECES = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x60\x7B-\x7F]+$"
#: Windows up to this count are broadcast, some 200 bytes each; more are joined by shuffles.
BROADCAST_WINDOWS = 200_000


def padded_words(text: Column) -> Column:
    """An empty string, the words, and one more empty string if the text ends in a separator."""
    return F.split(F.concat(F.lit(" "), ascii_lower(text)), SEPARATORS)


def _word_count(words: Column) -> Column:
    return F.size(words) - 1 - F.when(F.element_at(words, -1) == "", 1).otherwise(0)


def item_windows(items: DataFrame, width: int = 13) -> DataFrame:
    """Distinct windows of the items: window (array of words), anchor, at, items (sorted ids).

    The anchor is the window's longest word, ``at`` its place: long words are rare,
    so few words of a document have to be compared with whole windows.
    """
    words = items.select("item_id", F.filter(padded_words(text_or_empty()), lambda x: x != "").alias("w"))
    words = words.filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    windows = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, width))).alias("window"))
    windows = windows.groupBy("window").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    longest = F.array_max(
        F.transform(
            F.array_distinct("window"),
            lambda w: F.struct(F.octet_length(w).alias("n"), w.alias("word")),
        )
    )
    anchored = windows.withColumn("anchor", longest["word"])
    return anchored.withColumn("at", F.array_position("window", F.col("anchor")).cast("int"))


def find_hits(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """Per document: doc_id, _h1, _h2 (hashes of the text), copies, n_words, hits (array of first word, last word, items).

    Rows of equal (doc_id, text) are one document, ``copies`` of them.  Words count
    from 1.  One pass: every document's words are exploded and met with the
    anchors, each with no more of its text than a window can reach; the empty string before its first word meets an empty anchor and
    brings along documents without hits.
    """
    windows = item_windows(items, width)
    sentinel = docs.sparkSession.range(1).select(
        F.lit("").alias("anchor"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("array<string>").alias("window"),
        F.lit(None).cast("array<string>").alias("items"),
    )
    anchors = windows.select("anchor", "at", "window", "items").unionByName(sentinel)
    few = windows.count() <= BROADCAST_WINDOWS
    text = text_or_empty()
    words = docs.select("doc_id", *[F.xxhash64(F.lit(k), text).alias(f"_h{k}") for k in (1, 2)], padded_words(text).alias("words"))
    keys = ["doc_id", "_h1", "_h2", "n_words", "pos", "word"]
    placed = words.select("doc_id", "_h1", "_h2", _word_count(F.col("words")).alias("n_words"), "words", F.posexplode("words").alias("pos", "word"))
    # what a window around a word can reach: bounded, where the whole text would make a shuffled row grow with it
    begin = F.greatest(F.col("pos") + 2 - width, F.lit(1))
    near = F.slice("words", begin, 2 * width - 1)
    if few:
        met = placed.join(F.broadcast(anchors), placed["word"] == anchors["anchor"]).withColumn("near", near)
    else:
        placed = placed.select(*keys, near.alias("near"))
        met = placed.join(anchors, placed["word"] == anchors["anchor"])
    first = F.col("pos") - F.col("at") + 1
    here = F.slice("near", F.greatest(first + 2 - begin, F.lit(1)), F.size("window")) == F.col("window")
    opening = (F.col("word") == "") & (F.col("pos") == 0)
    met = met.filter(opening | ((F.col("word") != "") & (first > 0) & here))
    hit = F.when(
        F.col("at").isNotNull(),
        F.struct(first.alias("first"), (first + F.size("window") - 1).alias("last"), F.col("items")),
    )
    return (
        met.select("doc_id", "_h1", "_h2", opening.alias("opening"), F.when(opening, F.col("n_words")).alias("n_words"), hit.alias("hit"))
        .groupBy("doc_id", "_h1", "_h2")
        .agg(
            F.count_if("opening").alias("copies"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set("hit")).alias("hits"),
        )
    )


def _covered(hits: Column) -> Column:
    """Words inside any hit; hits are sorted by first word."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("n"))
    return F.aggregate(
        hits,
        start,
        lambda s, h: F.struct(
            F.greatest(s["upto"], h["last"]).alias("upto"),
            (s["n"] + F.greatest(F.lit(0), h["last"] - F.greatest(s["upto"], h["first"] - 1))).alias("n"),
        ),
        lambda s: s["n"],
    )


def _judged(docs: DataFrame, items: DataFrame, width: int, share: int) -> DataFrame:
    found = find_hits(docs.select("doc_id", "text"), items.select("item_id", "text"), width)
    item_ids = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))))
    out = found.select(
        "doc_id",
        "_h1",
        "_h2",
        "copies",
        F.col("n_words").cast("bigint").alias("n_words"),
        _covered(F.col("hits")).cast("bigint").alias("n_hit"),
        item_ids.alias("item_ids"),
        F.transform("hits", lambda h: F.struct(h["first"].alias("first"), h["last"].alias("last"))).alias("spans"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))


def judge(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids, spans and contaminated, one row per row of ``docs``.

    A document is contaminated if a word is hit and one in ``share`` words or more
    are.  ``spans`` holds first and last hit word of every hit, from 1.  Null text
    has no words; items without words have no windows; equal rows are judged
    alike; a table without rows gives none, and without items nothing is hit.
    Other columns than doc_id, text and item_id are not looked at.
    """
    out = _judged(docs, items, width, share).drop("_h1", "_h2")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("_copy", "copies")


def _same_document(docs: DataFrame, found: DataFrame) -> Column:
    """``found`` has _pw_id, _pw_h1 and _pw_h2; the hashes alone make the shuffle even."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    same = [F.xxhash64(F.lit(k), text) == found[f"_pw_h{k}"] for k in (1, 2)]
    return docs["doc_id"].eqNullSafe(found["_pw_id"]) & same[0] & same[1]


def _key() -> list[Column]:
    return [F.col("doc_id").alias("_pw_id"), F.col("_h1").alias("_pw_h1"), F.col("_h2").alias("_pw_h2")]


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    found = _judged(docs, items, width, share).filter("contaminated").select(*_key())
    return docs.join(found, _same_document(docs, found), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, width: int = 13) -> DataFrame:
    """doc_id and text without hit words and the separators before them; other texts, also null, unchanged."""
    found = _judged(docs, items, width, 1).filter("n_hit > 0").select(*_key(), "spans")
    slim = docs.select("doc_id", "text")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(f"({PIECES})"), F.lit(1))
    left = F.filter(pieces, lambda p, i: ~F.exists("spans", lambda s: (i + 1 >= s["first"]) & (i + 1 <= s["last"])))
    joined = slim.join(found, _same_document(slim, found), "left")
    return joined.select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(left, "")).alias("text"))
