"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch.llm.common import text_or_empty
from photonwatch.scale import top_k

#: n-grams kept of every language and looked at of every document, the most frequent first.
PROFILE_GRAMS = 400
#: Languages are compared in blocks of so many, which bounds what a task holds.
LANGUAGE_BLOCK = 64
#: Characters of one text whose n-grams are held at a time.
PIECE = 1 << 18
#: Distinct n-grams a task gathers before it hands them on.
HELD_GRAMS = 1 << 19
#: Prediction for texts without a letter.
UNKNOWN = "und"

_SPACE, _BITS = np.uint32(32), np.uint64(21)


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case, with all that stands between words as a space, and whether it is a letter."""
    lower, letter = np.full(0x110000, _SPACE, np.uint32), np.zeros(0x110000, bool)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LM":  # marks belong to the letter before them
            small = chr(code).lower()
            lower[code], letter[code] = ord(small) if len(small) == 1 else code, kind == "L"
    return lower, letter


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, place = np.unique(codes, return_inverse=True)
    return own, np.bincount(place, weights=counts).astype(np.int64)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes and counts of the text's runs of one to three characters within words, a space before and after each word.

    A code holds its characters in 21 bits each, so codes are exact.  Texts without a letter have none.
    """
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    lower, letter = _characters()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[points].any():
        return none
    points = np.concatenate(([_SPACE], lower[points], [_SPACE]))
    points = points[np.concatenate(([True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)))]
    found = []
    for at in range(0, len(points), PIECE):  # an n-gram belongs to the piece in which it begins
        part = points[at : at + PIECE + 2].astype(np.uint64)
        blank = part == _SPACE
        own = min(PIECE, len(points) - at)
        two = (part[:-1] << _BITS) | part[1:]
        three = (two[:-1] << _BITS) | part[2:]
        codes = [part[:own][~blank[:own]], two[:own], three[:own][~blank[1:-1][:own]]]
        found.append(np.unique(np.concatenate(codes), return_counts=True))
    return found[0] if len(found) == 1 else _merged(*(np.concatenate(c) for c in zip(*found)))


def _leading(codes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most frequent codes, ties by code, and their ranks; equal counts share their mean rank."""
    order = np.lexsort((codes, -counts))
    codes, counts = codes[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], counts[1:] != counts[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(counts)])))
    # of a long tie only what is within the k first counts
    sizes = np.minimum(sizes, np.maximum(k - starts, 1))
    mean = starts + (sizes - 1) / 2
    ranks = np.repeat(mean, np.diff(np.concatenate((starts, [len(counts)]))))
    return codes[:k], ranks[:k]


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts by language, summed in the task as far as it can hold them."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def handed() -> Iterator[pd.DataFrame]:
        for lang, parts in held.items():
            codes, counts = _merged(*(np.concatenate(c) for c in zip(*parts)))
            yield pd.DataFrame({"lang": lang, "gram": codes.view(np.int64), "n": counts})
        held.clear()

    size = 0
    for frame in batches:
        for lang, text in zip(frame["lang"], frame["text"]):
            own = grams(text)
            held.setdefault(lang, []).append(own)
            size += len(own[0])
            if size > 4 * HELD_GRAMS:
                held = {k: [_merged(*(np.concatenate(c) for c in zip(*v)))] for k, v in held.items()}
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD_GRAMS:
                    yield from handed()
                    size = 0
    yield from handed()


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and of each its most frequent n-grams, most frequent first."""

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]


def fit(docs: DataFrame, k: int = PROFILE_GRAMS) -> Profiles:
    """Profiles of the languages of ``docs`` (text, lang): the ``k`` n-grams most frequent in all their texts.

    Rows without language or without a letter teach nothing.  Counts are summed
    in each task before they travel, and of each language and task only ``k``
    are ranked; the driver gets k rows a language.  Equal counts are ordered by code.
    """
    known = docs.filter(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    counted = known.mapInPandas(_count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = top_k(counted, ["lang"], [F.desc("n"), F.asc("gram")], k).select("lang", "rank", "gram").toPandas()
    by = {lang: own.sort_values("rank")["gram"].to_numpy(np.int64).view(np.uint64) for lang, own in first.groupby("lang")}
    return Profiles(tuple(sorted(by)), tuple(by[lang] for lang in sorted(by)))


def _nearest(profiles: Profiles, k: int):
    """Column function: the language of least out-of-place distance, and that distance as a share of the largest one."""

    @F.pandas_udf("far double, lang string")
    def run(text: pd.Series) -> pd.DataFrame:
        table = np.unique(np.concatenate(profiles.grams))
        # rank of every n-gram in every language; k where the language lacks it
        ranks = np.full((len(table) + 1, len(profiles.languages)), -1.0)
        for column, own in enumerate(profiles.grams):
            ranks[np.searchsorted(table, own), column] = np.arange(len(own))
        far, lang = np.ones(len(text)), [None] * len(text)
        for row, t in enumerate(text):
            codes, own = _leading(*grams(t), k)
            if not len(codes):
                continue
            at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
            theirs = ranks[np.where(table[at] == codes, at, len(table))]
            out = np.where(theirs < 0, float(k), np.minimum(np.abs(theirs - own[:, None]), k)).sum(axis=0)
            best = int(np.argmin(out))
            far[row], lang[row] = out[best] / (k * len(codes)), profiles.languages[best]
        return pd.DataFrame({"far": far, "lang": lang})

    return run


def identify(docs: DataFrame, profiles: Profiles, k: int = PROFILE_GRAMS) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, which replace columns of these names.

    A text's ``k`` most frequent n-grams are held against every profile: the
    distance is the sum of how far each stands from its rank there, ``k`` where
    the profile lacks it.  The least distance wins, ties go to the language that
    sorts first; the score is one less that distance as a share of the largest
    possible one.  Null texts and texts without a letter are ``und`` with score 0,
    and so is every text if no language was learned.  Whole texts are read,
    however long; equal texts are judged alike; other columns stay as they are.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")]
    blocks = [
        Profiles(profiles.languages[at : at + LANGUAGE_BLOCK], profiles.grams[at : at + LANGUAGE_BLOCK])
        for at in range(0, len(profiles.languages), LANGUAGE_BLOCK)
    ]
    if not blocks:
        return docs.select(*kept, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    found = [_nearest(block, k)(text_or_empty()) for block in blocks]
    named = docs.withColumns({f"_pw_b{n}": f for n, f in enumerate(found)})
    best = named["_pw_b0"]
    for n in range(1, len(found)):  # texts without n-grams have no language in any block
        best = F.least(best, named[f"_pw_b{n}"])
    chosen = F.when(best["lang"].isNotNull(), best["lang"]).otherwise(UNKNOWN)
    return named.select(*kept, chosen.alias("lang_pred"), F.when(best["lang"].isNotNull(), 1 - best["far"]).otherwise(0.0).alias("score"))
