"""Passages that repeat across the corpus, found by digests of lines and sentences."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch.llm import shared_passages
from photonwatch.llm.common import modest_batches, released, stored, text_or_empty

#: A unit ends after line ends and sentence ends; units side by side make up the whole text.
UNITS = r"[^.!?\n]+[.!?\n]*|[.!?\n]+"
#: Shorter units are no evidence: headings and single words repeat without being copies.
MIN_WORDS = 3
#: Units that repeat side by side go if together they hold more words than this.
RUN_WORDS = 40
#: Where a script has no spaces, so many letters count as a word.
WORD_LETTERS = 8


def _normal(unit: Column) -> Column:
    """Lower case, every run of characters other than letters and digits one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(unit), r"[^\p{L}\p{N}]+", " "))


def _size(normal: Column) -> Column:
    """Words of a normalised unit."""
    words = F.when(normal == "", 0).otherwise(F.size(F.split(normal, " ", -1)))
    return F.greatest(words, F.floor(F.char_length(normal) / WORD_LETTERS).cast("int"))


def units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, _h (hash of the text) and every unit of ``min_words`` or more: ord (its place among these), unit (among all), n_words, digest d1, d2."""
    text = text_or_empty()
    cut = F.transform(F.regexp_extract_all(text, F.lit(UNITS), F.lit(0)), lambda u, k: F.struct(k.alias("unit"), _normal(u).alias("normal")))
    sized = F.transform(cut, lambda u: F.struct(u["unit"].alias("unit"), u["normal"].alias("normal"), _size(u["normal"]).alias("n_words")))
    listed = docs.select("doc_id", F.xxhash64(text).alias("_h"), F.posexplode(F.filter(sized, lambda u: u["n_words"] >= min_words)).alias("ord", "u"))
    return listed.select("doc_id", "_h", "ord", "u.unit", "u.n_words", *[F.xxhash64(F.lit(k), "u.normal").alias(f"d{k}") for k in (1, 2)])


def repeated_units(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, _h and the sorted array ``drop`` (ord, unit, n_words) of units that stand earlier elsewhere.

    Earlier: a smaller doc_id (null first), then the text's hash, then the place in the text.
    Digests are counted with sums per task before they travel, so a unit that a
    third of the documents holds is one row per task; the repeated digests are
    stored, so that the rows meet them in a join of which Spark can split a hot digest.
    """
    rows = units(docs, min_words)
    place = F.struct("doc_id", "_h", "ord")
    found = rows.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    same = rows.join(stored(found), ["d1", "d2"]).filter(~place.eqNullSafe(F.col("first")))
    # equal rows of one doc_id give every unit twice
    return same.groupBy("doc_id", "_h").agg(F.array_sort(F.collect_set(F.struct("ord", "unit", "n_words"))).alias("drop"))


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, run_words: int = RUN_WORDS, shared_words: int | None = None) -> DataFrame:
    """``docs`` with all columns, each text without its repeated passages, and the spans taken out.

    A unit is a line, or a sentence of one, with what ends it; units are compared
    in lower case without punctuation, and of equal ones the earliest stays.  Units
    under ``min_words`` words are neither counted nor do they part others.  Repeated
    units side by side are a passage; it goes if they hold more than ``run_words``
    words, so common short lines and sentences alone never go.  With
    ``shared_words``, passages of more than so many words in a row that an earlier
    document holds go too, wherever they begin and end.  ``removed`` holds
    (start, end) of every passage taken out, in characters of the original text;
    ``kept`` holds what stays between, so that texts can be traced back.  Null
    texts stay null and have no spans; a text that repeats as a whole becomes
    empty; equal rows of one doc_id are one document and are treated alike.
    Columns ``removed`` and ``kept`` of the input are replaced.
    """
    modest_batches(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "removed", "kept")]
    shared = None
    if shared_words is not None:
        shared = shared_passages.shared_words(docs, shared_words)
        released(docs.sparkSession)
    found = repeated_units(docs, min_words).filter(F.aggregate("drop", F.lit(0), lambda s, u: s + u["n_words"]) > run_words)
    if shared is None:
        found = found.withColumn("shared", F.lit(None).cast("array<struct<first:int,last:int>>"))
    else:
        both = found.unionByName(shared, allowMissingColumns=True).groupBy("doc_id", "_h")
        found = both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("drop", "shared")])
    found = found.select(F.col("doc_id").alias("_pw_id"), F.col("_h").alias("_pw_h"), F.col("drop").alias("_pw_drop"), F.col("shared").alias("_pw_shared"))
    keyed = docs.withColumn("_pw_t", F.xxhash64(text_or_empty()))
    joined = keyed.join(found, keyed["doc_id"].eqNullSafe(found["_pw_id"]) & (F.col("_pw_t") == F.col("_pw_h")), "left")
    rebuilt = joined.withColumn("_pw_new", _rebuild(run_words)(F.col("text").cast("string"), "_pw_drop", "_pw_shared"))
    return rebuilt.select(*columns, *[F.col(f"_pw_new.{c}").alias(c) for c in ("text", "removed", "kept")])


def _passages(drop: list, run_words: int) -> list[tuple[int, int]]:
    """First and last unit of every run of repeated units that is long enough."""
    runs: list[list] = []
    for u in drop:
        if runs and u["ord"] == runs[-1][-1]["ord"] + 1:
            runs[-1].append(u)
        else:
            runs.append([u])
    return [(r[0]["unit"], r[-1]["unit"]) for r in runs if sum(u["n_words"] for u in r) > run_words]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _rebuild(run_words: int):
    spans = "array<struct<start:int,end:int>>"

    @F.pandas_udf(f"text string, removed {spans}, kept {spans}")
    def run(text: pd.Series, drop: pd.Series, shared: pd.Series) -> pd.DataFrame:
        rows = []
        for whole, gone, words in zip(text, drop, shared):
            passages = [] if whole is None or gone is None else _passages(list(gone), run_words)
            bounds = [m.span() for m in re.finditer(UNITS, whole)] if passages else []
            removed = [(bounds[a][0], bounds[b][1]) for a, b in passages]
            if whole is not None and words is not None:
                bounds = [m.span() for m in shared_passages.WORD.finditer(whole)]
                removed = _merged(removed + [(bounds[w["first"]][0], bounds[w["last"]][1]) for w in words])
            edges = [0, *[x for span in removed for x in span], len(whole or "")]
            kept = [(a, b) for a, b in zip(edges[::2], edges[1::2]) if a < b]
            rest = whole if whole is None or not removed else "".join(whole[a:b] for a, b in kept)
            rows.append((rest, *[[{"start": a, "end": b} for a, b in s] for s in (removed, kept)]))
        return pd.DataFrame(rows, columns=["text", "removed", "kept"])

    return run
