"""Which URLs to crawl: rules first, then naive Bayes over the words of host and path."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch.llm.common import ascii_lower, stored

# fixed values: words that mark a host or path as unwanted; pages with one are the examples that naive Bayes learns from
SEED_WORDS = ("adult", "ads", "bet", "bets", "casino", "gambling", "loans", "lottery", "pills", "poker", "porn", "spam", "viagra", "xxx")


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for the host up to the first slash, its subdomains, and paths that start with the rest."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1] if "/" in self.pattern else ""


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    known = F.coalesce(url.cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(known, pattern, 1)), F.regexp_extract(known, pattern, 2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Pattern and verdict of the longest rule that fits, else null; ``rules`` is a short list, it becomes one expression."""
    pattern = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        pattern, verdict = F.when(fits, rule.pattern).otherwise(pattern), F.when(fits, rule.verdict).otherwise(verdict)
    return pattern, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word and n over the visible text of ``column``: runs of letters of any script and length; tags, scripts and styles are left out."""
    visible = F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), r"(?is)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    words = texts.select(F.explode(F.split(F.lower(visible), r"[^\p{L}]+")).alias("word")).filter("word != ''")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _viterbi(total: float, longest: int):
    """The likeliest split of each label into known words; an unknown one costs ten times more per letter."""

    @F.pandas_udf("array<string>")
    def run(label: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for name, found in zip(label, known):
            count = {} if found is None else {f["word"]: f["n"] for f in found}
            best: list[tuple[float, int]] = [(0.0, 0)]
            for end in range(1, len(name) + 1):
                options = []
                for start in range(max(0, end - longest), end):
                    n = count.get(name[start:end])
                    score = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
                    options.append((best[start][0] + score, start))
                best.append(max(options))
            words, end = [], len(name)
            while end:
                start = best[end][1]
                words.append(name[start:end])
                end = start
            out.append(words[::-1])
        return pd.Series(out)

    return run


def split_hosts(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """host and ``words`` of every distinct host: each part between dots is split by unigram probabilities.

    Only the counts of substrings that occur in hosts are brought to them, so the
    word list may be of any size; no substring is longer than its longest word.
    """
    distinct = hosts.select("host").distinct()
    labels = distinct.select("host", F.posexplode(F.split("host", r"[^\p{L}\p{N}]+")).alias("at", "label")).filter("label != ''")
    names = labels.select("label").distinct()
    known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max(F.length("word")), F.lit(1)).alias("longest")).first()
    total, longest = float(known["n"] or 1), known["longest"]
    starts = F.sequence(F.lit(1), F.length("label"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.length("label") - F.col("start") + 1))
    cut = (
        names.select("label", F.explode(starts).alias("start"))
        .select("label", F.explode(F.transform(lengths, lambda k: F.substring("label", F.col("start"), k))).alias("word"))
        .distinct()
    )
    known = cut.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    split = names.join(known, "label", "left").select("label", _viterbi(total, longest)("label", "known").alias("words"))
    joined = labels.join(split, "label").groupBy("host").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("w"))
    return joined.select("host", F.flatten("w.words").alias("words"))


def tokens(pages: DataFrame, host_words: DataFrame) -> DataFrame:
    """Distinct (host, path) with the array ``tokens``: words of the host, words of the path; a run of digits is one token."""
    pairs = pages.select("host", "path").distinct().join(host_words, "host", "left")
    pieces = F.filter(F.split(F.regexp_replace(F.lower("path"), "[0-9]+", " 0 "), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    named = F.concat(
        F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("host "), w)),
        F.transform(pieces, lambda w: F.concat(F.lit("path "), w)),
    )
    return pairs.select("host", "path", named.alias("tokens"))


def with_words(counts: DataFrame, words: tuple[str, ...], one_in: int = 10_000) -> DataFrame:
    """``counts`` (word, n) in which each of ``words`` makes up at least one in ``one_in``."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    added = counts.sparkSession.createDataFrame([(w, max(1, total // one_in)) for w in words], "word string, n long")
    return counts.union(added).groupBy("word").agg(F.max("n").alias("n"))


def classify(pages: DataFrame, counts: DataFrame, rules: list[Rule], seeds: tuple[str, ...] = SEED_WORDS, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``score`` (log-odds of block), which replace columns of these names.

    The longest rule that fits decides.  Elsewhere multinomial naive Bayes does:
    pages of which host or path hold a seed word are its examples of block, all
    others those of allow, and it judges by every word of host and path.
    ``counts`` (word, n) are the unigrams by which hosts are split.  A page
    without words scores the prior.  A null url, or one without ``://``, has an
    empty host and path and no rule.  Equal urls get equal verdicts.
    """
    host, path = parts(F.col(f"`{url}`"))
    columns = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "score")]
    read = pages.select(*columns, host.alias("host"), path.alias("path"))
    pattern, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    listed = stored(tokens(read, split_hosts(read, with_words(counts, seeds))))
    # pages are counted by (host, path) before anything is exploded
    times = read.groupBy("host", "path").agg(F.count(F.lit(1)).alias("times"))
    words = F.transform("tokens", lambda t: F.element_at(F.split(t, " "), 2))
    marked = F.arrays_overlap(words, F.array(*[F.lit(w) for w in seeds]))
    seen = times.join(listed, ["host", "path"]).select("times", "tokens", marked.cast("int").alias("marked"))
    pages_by = seen.agg(F.sum(F.col("times") * F.col("marked")).alias("block"), F.sum("times").alias("all")).first()
    prior = math.log(((pages_by["block"] or 0) + 1) / ((pages_by["all"] or 0) - (pages_by["block"] or 0) + 2))
    # stored, so that Spark can split a common token where the pages meet it
    table = stored(
        seen.select("times", "marked", F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.sum(F.col("times") * F.col("marked")).alias("block"), F.sum(F.col("times") * (1 - F.col("marked"))).alias("allow"))
    )
    sums = table.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count(F.lit(1)).alias("n")).first()
    block, allow, size = sums["block"] or 0, sums["allow"] or 0, sums["n"]
    odds = F.log((F.col("block") + 1) / F.lit(block + size + 1.0)) - F.log((F.col("allow") + 1) / F.lit(allow + size + 1.0))
    scored = (
        listed.select("host", "path", F.explode("tokens").alias("token"))
        .join(table.select("token", odds.alias("odds")), "token")
        .groupBy("host", "path")
        .agg(F.round(F.sum("odds") + prior, 9).alias("score"))
    )
    joined = read.join(scored, ["host", "path"], "left").withColumn("score", F.coalesce("score", F.lit(prior)))
    chosen = F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow"))
    return joined.select(*columns, "host", "path", pattern.alias("rule"), chosen.alias("verdict"), "score")
