"""Trained operators: held-out accuracy, odd rows; URL rules, licences and nearest vectors against brute force."""

import math
import random
import re
import textwrap
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from photonwatch.llm import licences, neighbours, quality, toxicity, urls
from photonwatch.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.01"


def _auc(rows):
    ones, zeros = ([s for s, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + 0.5 * (a == b) for a in ones for b in zeros) / (len(ones) * len(zeros))


@pytest.mark.parametrize("name,label,least", [("op1_quality_classifier", "quality", 0.8), ("op2_toxicity", "toxic", 0.85)])
def test_held_out(spark, name, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    out = QUERIES[name](spark, SF)
    rows = out.join(labels, "doc_id").filter("held_out").select("score", label).collect()
    assert _auc(rows) > least
    assert out.count() == 1000 and out.filter("score is null or score < 0 or score > 1").isEmpty()


def _odd_docs(spark):
    rows = [(1, "a bad text", "x"), (2, None, "x"), (None, "", "x"), (3, "nice " * 20_000, "x"), (3, "nice", "x"), (4, "\n\t", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, score string")


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.fit(_odd_docs(spark), labels, l1=0.01, least_texts=1)
    out = {(r.doc_id, r.text): r for r in toxicity.score(_odd_docs(spark), model).collect()}
    assert len(out) == 6 and all(0 <= r.score <= 1 for r in out.values())
    assert out[(1, "a bad text")].score > out[(3, "nice")].score
    nothing = toxicity.fit(_odd_docs(spark), labels.limit(0))
    assert {r.predicted for r in toxicity.score(_odd_docs(spark), nothing).collect()} == {0}
    assert toxicity.score(_odd_docs(spark).limit(0), model).count() == 0


def test_quality_odd_rows(spark):
    stats = quality.document_statistics(_odd_docs(spark))
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (4, None)], "doc_id long, quality int")
    for known in (labels, labels.limit(0)):
        rows = quality.score(stats, quality.fit(stats, known)).collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(stats.limit(0), labels).scores(np.zeros((1, len(quality.STATISTICS))))[0] == pytest.approx(0.5, abs=0.01)


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    width = len(quality.STATISTICS)
    rows = rng.normal(size=(40, width)) * 0.5
    model = quality.Model(
        np.zeros(width), np.ones(width), np.random.default_rng(5).normal(size=(width, 4096)) / np.sqrt(width), rng.uniform(0, 2 * np.pi, 4096), None, None, None
    )
    f = model.features(rows)[:, :-1]
    distance = ((rows[:, None] - rows[None]) ** 2).sum(axis=2)
    assert np.abs(f @ f.T - np.exp(-distance / (2 * width))).max() < 0.1


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(2)
    mean, count = rng.random(50), rng.integers(1, 9, 50).astype(float)
    x, y = quality.isotonic(np.arange(50.0), mean, count)
    assert (np.diff(y) > 0).all() and (np.diff(x) > 0).all()
    at = np.searchsorted((x[1:] + x[:-1]) / 2, np.arange(50.0))
    assert len(set(at)) <= 50
    flat = quality.isotonic(np.arange(3.0), np.array([3.0, 2.0, 1.0]), np.ones(3))
    assert flat[1].tolist() == [2.0]


def _expected(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r.pattern for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=len, default=None)


def test_urls(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://Example.ORG", "http://example.org/", "http://a.Example.org/es/1?x=/#y", "x://example.org/en/19#",
           "http://com/de/", "http://b.com/de", "http://notexample.org/es/", "ftp://É.com/fr/\n?q", "http://a://b.org/x", "http://h?x=/a", "http://org#/", "http://bestcasino.example.net/a",
           "http://" + "thecat" * 3000 + ".net/x"]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(odd + odd[:3])], "page_id long, url string, path string")
    counts = spark.createDataFrame([("the", 50), ("cat", 20), ("best", 9), ("thec", 1)], "word string, n long")
    got = {r.page_id: r for r in urls.classify(pages, counts, RULES).collect()}
    assert len(got) == len(odd) + 3
    for i, u in enumerate(odd + odd[:3]):
        assert (got[i].host, got[i].path, got[i].rule) == _expected(u), u
        if got[i].rule:
            assert got[i].verdict == {r.pattern: r.verdict for r in RULES}[got[i].rule]
    assert got[15].verdict == "block" and got[0].verdict == "allow"
    split = {r.host: r.words for r in urls.split_hosts(spark.createDataFrame([("thecat.the-xq.",), ("",)], "host string"), counts).collect()}
    assert split["thecat.the-xq."] == ["the", "cat", "the", "xq"]
    assert urls.classify(pages.limit(0), counts.limit(0), RULES).count() == 0


def test_url_words_and_score_against_plain_counts(spark):
    """Every split of a label tried, and naive Bayes from plain counters."""
    rng = random.Random(12)
    texts = ["der überraschungsgast und die donaudampfschifffahrtsgesellschaft", "the cat sat", "été à la plage", "cats and casino"] * 3
    counts = urls.word_counts(spark.createDataFrame([(f"<p>{t}</p><script>no words</script>",) for t in texts], "html string"), "html")
    plain = Counter(w for t in texts for w in t.split())
    assert {r.word: r.n for r in counts.collect()} == plain
    known = Counter(plain)
    total = sum(plain.values())
    for w in urls.SEED_WORDS:
        known[w] = max(known[w], 1, total // 10_000)
    total = sum(known.values())

    def split(label):
        best = None
        for cuts in range(2 ** (len(label) - 1)):
            words, at = [], 0
            for k in range(1, len(label) + 1):
                if k == len(label) or cuts >> (k - 1) & 1:
                    words.append(label[at:k])
                    at = k
            score = sum(math.log(known[w] / total) if known[w] else math.log(10 / total) - len(w) * math.log(10) for w in words)
            if best is None or score > best[0] + 1e-12:
                best = (score, words)
        return best[1]

    labels = ["thecat", "catsat", "pokercats", "überraschungsgast"[:9], "zzcat", "plageété", "undcasino"]
    rows = [(k, f"http://{rng.choice(labels)}.{rng.choice(['de', 'la'])}/{rng.choice(['sat', 'x1', 'été/9', ''])}") for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: r.score for r in urls.classify(pages, counts, []).collect()}
    listed = {}
    for k, u in rows:
        host, path = u[7:].split("/", 1)
        tokens = [f"host {w}" for part in host.split(".") for w in split(part)]
        tokens += [f"path {w}" for w in re.split(r"[^\w]+", re.sub("[0-9]+", " 0 ", path.lower())) if w]
        listed[k] = tokens, any(t.split(" ")[1] in urls.SEED_WORDS for t in tokens)
    block, allow = Counter(), Counter()
    for tokens, bad in listed.values():
        (block if bad else allow).update(tokens)
    size, n_bad = len(set(block) | set(allow)), sum(bad for _, bad in listed.values())
    prior = math.log((n_bad + 1) / (len(rows) - n_bad + 2))
    for k, (tokens, _) in listed.items():
        odds = sum(math.log((block[t] + 1) / (sum(block.values()) + size + 1)) - math.log((allow[t] + 1) / (sum(allow.values()) + size + 1)) for t in tokens)
        assert got[k] == pytest.approx(prior + odds, abs=1e-8), rows[k]


def test_licences(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/file", "plain text\n\nmore of it"), ("a/b/LICENSE", "Licensed under CC BY-NC 4.0.\nsome more words"),
        ("a/x/own", "# Licensed under the Apache License, Version 2.0\ncode"), ("a/x/none", None), ("top", ""), (None, "Released under the MIT License."),
        ("z/both", "Released under the MIT License.\nThis work is licensed under the GNU General Public License, version 3."), ("z/q", "the version of the license of this work"),
        ("a/x/none", "again"),
    ]
    files = spark.createDataFrame([(*r, 1.0) for r in rows], "path string, text string, score double")
    got = {r.path: r for r in licences.scan(files, F.col("path").endswith("LICENSE")).collect()}
    assert {k: (v.own, v.inherited, v.from_directory, v.licence) for k, v in got.items()} == {
        "a/LICENSE": ("MIT", "MIT", "a", "MIT"),
        "a/b/c/file": (None, "CC-BY-NC-4.0", "a/b", "CC-BY-NC-4.0"),
        "a/b/LICENSE": ("CC-BY-NC-4.0", "CC-BY-NC-4.0", "a/b", "CC-BY-NC-4.0"),
        "a/x/own": ("Apache-2.0", "MIT", "a", "Apache-2.0"),
        "a/x/none": (None, "MIT", "a", "MIT"),
        "top": (None, None, None, None),
        "z/both": ("MIT", None, None, "MIT"),
        "z/q": (None, None, None, None),
    }
    assert licences.scan(files.limit(0), F.lit(True)).count() == 0


def _header_files(times):
    """So many times one hundred lines, one of them a licence line with common words before the licence's name."""
    fill = [f"it is the case that line {k % 10} of this text is plain" for k in range(99)]
    return [(f"f{t}", "\n".join([*fill, "It is released under the MIT License."])) for t in range(times)]


@pytest.mark.parametrize("times", [1, 40])
def test_licence_line_weights_are_document_frequencies(spark, times):
    files = _header_files(times)
    got = licences.line_licences(spark.createDataFrame(files, "path string, text string"), {"MIT": ["Released under the MIT License."]}).collect()
    lines = [re.findall(r"\w+", line.lower()) for _, text in files for line in text.split("\n")]
    seen = Counter(w for line in lines for w in set(line))
    weight = {w: math.log(1 + len(lines) / (1 + n)) for w, n in seen.items()}
    line, template = "it is released under the mit license".split(), "released under the mit license".split()
    dot = sum(weight[w] ** 2 for w in template)
    want = dot / math.sqrt(dot * sum(weight[w] ** 2 for w in line))
    assert {(r.path, r.line, r.licence, round(r.score, 6)) for r in got} == {(path, 99, "MIT", round(want, 6)) for path, _ in files}
    assert want > 0.95  # whatever the size of the table


def test_whole_licence_files_and_headers(spark):
    texts = {p.stem: p.read_text() for p in sorted((Path(licences.__file__).parent / "licence_texts").glob("*.txt"))}
    mit = texts["MIT"].replace("<year>", "2020").replace("<copyright holders>", "Ann Other")
    notice = textwrap.wrap(licences.NOTICES["Apache-2.0"][0], 70)
    prose = "\n".join(f"the text of this page is about the sea and what it is for, part {k}" for k in range(60))
    rows = [(f"full/{k}/LICENSE", text) for k, text in texts.items()] + [
        ("mit/LICENSE", "\n".join(x for para in mit.split("\n") for x in textwrap.wrap(para, 40) or [""])), ("mit/src/code", "x = 1\ny = 2"),
        ("head/hash", "\n".join(["#!/bin/sh", "# Copyright 2020 Ann Other", "#", *[f"# {x}" for x in notice], "", "run the code", prose])),
        ("head/star", "\n".join(["/*", *[f"   {x}" for x in notice], "*/", "int main;", prose])),
        ("head/wrapped", "# a tool for maps and much else that has nothing to do with it\n# This work is licensed under the GNU\n# General Public License, version 3.\ncode\n" + prose),
        ("head/late", "code\n# This work is licensed under the GNU\n# General Public License, version 3.\n" + prose), ("prose", prose),
    ]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in licences.scan(files, F.col("path").endswith("LICENSE") & (F.col("share") >= 0.9)).collect()}
    assert {k: got[f"full/{k}/LICENSE"].own for k in texts} == {k: k for k in texts}
    assert (got["mit/LICENSE"].own, got["mit/src/code"].own, got["mit/src/code"].licence) == ("MIT", None, "MIT")
    assert [got[f"head/{k}"].own for k in ("hash", "star", "wrapped", "late")] == ["Apache-2.0", "Apache-2.0", "GPL-3.0", None]
    assert got["prose"].licence is None


def test_header_lines(spark):
    texts = ["# a\n\n// b\ncode\n# c", "/* a\n b\n c */\ncode", "<!-- a -->\n\"\"\"b\nc\"\"\"\nx", "code", "", "/* never\nclosed"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    got = frame.orderBy("k").select(F.size(licences.header_lines(F.split("text", "\n"))).alias("n")).collect()
    assert [r.n for r in got] == [3, 3, 3, 0, 1, 2]


def test_nearest(spark):
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, 0.6) for c in centres[i % 6]]) for i in range(3000)]
    rows += [(3000 + k, list(rows[50][1])) for k in range(40)]  # ties
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [1.0, float("nan")] + [0.0] * 14), (5150, [None] + [1.0] * 15), (None, [1.0] * 16), (5200, [1.0, 2.0]), (5250, [2.0, 4.0]), (5300, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    vectors = neighbours.usable(table, "vec_id", "embedding")
    assert vectors.count() == 3042
    got = {}
    for r in neighbours.search(neighbours.build_index(vectors), vectors.filter("id % 50 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids = np.array([i for i, v in rows[:3040]])
    unit = np.array([v for _, v in rows[:3040]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 3001, 50):
        scores = unit @ unit[q]
        order = [i for i in np.lexsort((ids, -np.round(scores, 12))) if i != q][:5]
        assert len(got[q]) == 5
        for vec_id, score in got[q]:
            assert score == pytest.approx(float(unit[vec_id] @ unit[q]), abs=1e-12)
        hits += len({ids[i] for i in order} & {v for v, _ in got[q]})
        total += 5
    assert hits / total >= 0.9
    assert [v for v, _ in got[50]] == [3000, 3001, 3002, 3003, 3004]
    assert got[5200] == [(5250, pytest.approx(1.0))] and set(got) == {*range(0, 3001, 50), 5200, 5250}
    assert neighbours.search(neighbours.build_index(vectors.limit(0)), vectors.limit(0)).count() == 0
