"""Licences of files: header lines and licence files against templates, then inheritance along directories."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonwatch.llm.common import stored, text_or_empty

# fixed values: phrases by which files name their licence
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Redistributed under the three clause BSD License.", "Licensed under the BSD 3 Clause License."],
    "MPL-2.0": ["This source code is subject to the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "Licensed under the Creative Commons Attribution ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Licensed under the Creative Commons Attribution NonCommercial 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
}
# fixed values: notices of several lines, as the licences ask for them
_GPL = (
    "This {it} is free software; you can redistribute it and/or modify it under the terms of the {gpl} as published by the Free Software Foundation;"
    " either version {version} of the License, or (at your option) any later version. This {it} is distributed in the hope that it will be useful, but"
    " WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {gpl} for more details."
    " You should have received a copy of the {gpl} along with this {it}{end}"
)
_WRITE = "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_SEE = ". If not, see <https://www.gnu.org/licenses/>."
_GNU = "GNU {}General Public License"
NOTICES = {
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a'
        " copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed"
        ' under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License'
        " for the specific language governing permissions and limitations under the License."
    ],
    "GPL-2.0": [_GPL.format(it="program", gpl=_GNU.format(""), version="2", end=end) for end in (_WRITE, _SEE)],
    "GPL-3.0": [_GPL.format(it="program", gpl=_GNU.format(""), version="3", end=end) for end in (_WRITE, _SEE)],
    "LGPL-2.1": [_GPL.format(it="library", gpl=_GNU.format("Lesser "), version="2.1", end=end) for end in (_WRITE, _SEE)],
    "LGPL-3.0": [_GPL.format(it=it, gpl=_GNU.format("Lesser "), version="3", end=_SEE) for it in ("library", "program")],
    "AGPL-3.0": [_GPL.format(it="program", gpl=_GNU.format("Affero "), version="3", end=_SEE)],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,"
        " You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
}
#: Least cosine of a line, header or file and its template.
LIKE = 0.75
#: How comments of one line begin, and how longer ones begin and end.
LINE_COMMENTS = r"^(?:#|//|--|;|%)"
BLOCK_COMMENTS = [("/*", "*/"), ("<!--", "-->"), ('"""', '"""'), ("'''", "'''"), ("(*", "*)"), ("{-", "-}")]


def block_templates() -> dict[str, list[str]]:
    """Phrases, notices and the whole texts in ``licence_texts``, by licence."""
    texts = {p.stem: [p.read_text(encoding="utf-8")] for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    return {k: [*TEMPLATES.get(k, []), *NOTICES.get(k, []), *texts.get(k, [])] for k in sorted({*TEMPLATES, *NOTICES, *texts})}


def _words(line: Column) -> Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def template_terms(spark, templates: dict[str, list[str]]) -> DataFrame:
    """template, licence, term and tf: as many rows as the templates have words."""
    listed = [(k, licence, text) for k, (licence, text) in enumerate((n, t) for n, ts in templates.items() for t in ts)]
    table = spark.createDataFrame(listed, "template int, licence string, text string")
    words = table.select("template", "licence", F.explode(_words(F.col("text"))).alias("term"))
    return words.groupBy("template", "licence", "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))


def _rare_enough(terms: list, weight: dict[str, float], like: float) -> set[str]:
    """Terms of which a line must hold one to reach the least cosine with any template.

    Of each template the heaviest terms, until the rest weigh too little to reach it alone.
    """
    out: set[str] = set()
    by: dict[int, list[tuple[float, str]]] = {}
    for row in terms:
        by.setdefault(row["template"], []).append((row["tf"] * weight[row["term"]], row["term"]))
    for weighed in by.values():
        weighed.sort(reverse=True)
        whole = math.sqrt(sum(w * w for w, _ in weighed))
        for k, (_, term) in enumerate(weighed):
            if math.sqrt(sum(w * w for w, _ in weighed[k:])) < like * whole:
                break
            out.add(term)
    return out


def _listed(files: DataFrame) -> DataFrame:
    """path, line (from 0) and words of every line that has some."""
    lines = files.select("path", F.posexplode(F.split(text_or_empty(), "\n")).alias("line", "text"))
    return lines.select("path", "line", _words(F.col("text")).alias("w")).filter(F.size("w") > 0)


def term_counts(files: DataFrame) -> tuple[int, DataFrame]:
    """Number of lines with words, and a stored table of terms and the lines (n) that hold each."""
    listed = _listed(files)
    terms = listed.select(F.explode(F.array_distinct("w")).alias("term"))
    return max(1, listed.count()), stored(terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def _weights(terms: list, counts: tuple[int, DataFrame]) -> dict[str, float]:
    """Weight of each of the templates' terms."""
    n, holding = counts
    vocabulary = sorted({r["term"] for r in terms})
    asked = F.broadcast(holding.sparkSession.createDataFrame([(t,) for t in vocabulary], "term string"))
    seen = {r["term"]: r["n"] for r in holding.join(asked, "term").collect()}
    return {t: math.log(1 + n / (1 + seen.get(t, 0))) for t in vocabulary}


def _best_templates(counted: DataFrame, keys: list[str], terms: list, weight: dict[str, float], counts: tuple[int, DataFrame], like: float) -> DataFrame:
    """Keys, score and licence of the best template of each vector of ``counted`` (keys, term, tf), if like it."""
    n, holding = counts
    spark, counted = counted.sparkSession, stored(counted)  # both tables hold candidates only
    by: dict[tuple[int, str], list] = {}
    for row in terms:
        by.setdefault((row["template"], row["licence"]), []).append((row["term"], row["tf"] * weight[row["term"]]))
    parts = [
        (template, licence, term, w / math.sqrt(sum(v * v for _, v in own)))
        for (template, licence), own in by.items()
        for term, w in own
    ]
    of_template = F.broadcast(spark.createDataFrame(parts, "template int, licence string, term string, part double"))
    of_term = F.broadcast(spark.createDataFrame(list(weight.items()), "term string, weight double"))
    # only words outside the templates go by term to their counts: the templates' own, which most candidates share, are broadcast
    known = counted.join(of_term, "term").select(*keys, "term", (F.col("tf") * F.col("weight")).alias("w"))
    others = counted.join(of_term, "term", "left_anti").join(holding, "term")
    rest = others.select(*keys, "term", (F.col("tf") * F.log(1 + F.lit(n) / (1 + F.col("n")))).alias("w"))
    words = stored(known.unionByName(rest))
    norms = words.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = words.join(of_template, "term").groupBy(*keys, "template", "licence").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    liked = dots.join(norms, keys).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).filter(F.col("score") >= like)
    return liked.groupBy(*keys).agg(F.max("score").alias("score"), F.min_by("licence", F.struct(-F.col("score"), "licence")).alias("licence"))


def line_licences(
    files: DataFrame, templates: dict[str, list[str]] | None = None, like: float = LIKE, counts: tuple[int, DataFrame] | None = None
) -> DataFrame:
    """path, line (from 0), licence and score of every line that is like a template.

    Lines and templates are sparse TF-IDF vectors: a term weighs
    log(1 + lines / (1 + lines with it)) over all lines of all files, whether it
    stands in a template or not.  Only lines with one of a
    template's rare terms are weighed, as no other can reach ``like``.
    The best template of a line counts, ties to the name that sorts first.
    """
    templates = TEMPLATES if templates is None else templates
    terms = template_terms(files.sparkSession, templates).collect()  # the templates' own words
    counts = term_counts(files) if counts is None else counts
    weight = _weights(terms, counts)
    rare = F.array(*[F.lit(t) for t in sorted(_rare_enough(terms, weight, like))])
    near = _listed(files).filter(F.arrays_overlap("w", rare)).select("path", "line", F.explode("w").alias("term"))
    counted = near.groupBy("path", "line", "term").agg(F.count(F.lit(1)).alias("tf"))
    return _best_templates(counted, ["path", "line"], terms, weight, counts, like)


def header_lines(lines: Column) -> Column:
    """The lines of a file's leading comments: blank lines, comments of one line, and whole longer ones."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("inside"))  # inside: 0 between comments, k in one of the k-th kind, -1 behind the header

    def step(state: Column, line: Column) -> Column:
        t = F.trim(F.regexp_replace(line, r"\s", " "))
        blank = (t == "") | F.regexp_like(t, F.lit(LINE_COMMENTS))
        opened, closed = F.when(blank, 0), F.lit(None).cast("int")
        for k, (begin, end) in enumerate(BLOCK_COMMENTS, 1):
            opened = opened.when(F.startswith(t, F.lit(begin)), F.when(F.contains(F.substr(t, F.lit(len(begin) + 1)), F.lit(end)), 0).otherwise(k))
            closed = F.when(state["inside"] == k, F.when(F.contains(t, F.lit(end)), 0).otherwise(k)).otherwise(closed)
        inside = F.when(state["inside"] > 0, closed).when(state["inside"] == 0, opened.otherwise(-1)).otherwise(-1)
        return F.struct((state["n"] + F.when(inside < 0, 0).otherwise(1)).alias("n"), inside.alias("inside"))

    return F.slice(lines, F.lit(1), F.aggregate(lines, start, step)["n"])


def _blocks(files: DataFrame) -> DataFrame:
    """path, _h (hash of the text), kind, line, lines and words: each whole file (kind 0), its header (1),
    the header's paragraphs (2) and every two of its lines in a row (3); ``line`` is the place within the kind."""
    text = text_or_empty()
    begins = "|".join(["#|//|--|;|%", *[f"\\Q{begin}\\E" for begin, _ in BLOCK_COMMENTS]])
    header = F.when(F.regexp_like(text, F.lit(rf"^\s*(?:{begins})")), header_lines(F.split(text, "\n"))).otherwise(F.array().cast("array<string>"))
    rows = files.select("path", F.xxhash64(text).alias("_h"), text.alias("text"), header.alias("header"))
    wordy = lambda x: F.regexp_like(x, F.lit(r"[\p{L}\p{N}]"))
    block = lambda kind, line, said: F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), said.alias("text"))
    said = F.filter("header", wordy)
    spaced = F.array_join(F.transform("header", lambda x: F.when(wordy(x), x).otherwise("")), "\n")
    pairs = F.when(F.size(said) > 1, F.transform(F.sequence(F.lit(1), F.size(said) - 1), lambda k: block(3, k, F.array_join(F.slice(said, k, 2), "\n"))))
    headed = F.concat(
        F.array(block(1, F.lit(0), F.array_join("header", "\n"))),
        F.transform(F.split(spaced, "\n{2,}"), lambda x, k: block(2, k, x)),
        F.coalesce(pairs, F.array().cast("array<struct<kind:int,line:int,text:string>>")),
    )
    whole = F.array(block(0, F.lit(0), F.col("text")))
    told = rows.select("path", "_h", F.explode(F.when(F.size("header") > 0, F.concat(whole, headed)).otherwise(whole)).alias("b"))
    lines = F.size(F.filter(F.split("b.text", "\n"), wordy))
    return told.select("path", "_h", "b.kind", "b.line", lines.alias("lines"), _words(F.col("b.text")).alias("w"))


def _enough(terms: list, weight: dict[str, float], like: float) -> tuple[Column, list[str]]:
    """Per template the terms, the least number of them that can make up ``like``, and the rare ones of which one is needed; and all terms.

    By Cauchy and Schwarz the terms that a vector shares with a template must hold ``like`` of its length.
    """
    by: dict[int, list] = {}
    for row in terms:
        by.setdefault(row["template"], []).append(row)
    told = []
    for template, rows in sorted(by.items()):
        squares = sorted(((r["tf"] * weight[r["term"]]) ** 2 for r in rows), reverse=True)
        least = next(k for k in range(1, len(squares) + 1) if sum(squares[:k]) >= like * like * sum(squares) * (1 - 1e-9))
        lists = [sorted(x) for x in ({r["term"] for r in rows}, _rare_enough(rows, weight, like))]
        told.append(F.struct(F.lit(least).alias("least"), *[F.split(F.lit(" ".join(x)), " ").alias(name) for name, x in zip(("terms", "rare"), lists)]))
    return F.array(*told), sorted({r["term"] for r in terms})


def block_licences(
    files: DataFrame, templates: dict[str, list[str]] | None = None, like: float = LIKE, counts: tuple[int, DataFrame] | None = None
) -> DataFrame:
    """path, kind, line, lines (with words), licence and score of whole files and parts of headers that are like a template.

    Weights as for lines, but a term that occurs tf times counts 1 + log(tf), so
    that in long texts the commonest words do not decide.  Blocks that share too
    few terms with each template to reach ``like`` are left out before they are weighed.
    """
    templates = block_templates() if templates is None else templates
    terms = [r.asDict() | {"tf": 1 + math.log(r["tf"])} for r in template_terms(files.sparkSession, templates).collect()]
    counts = term_counts(files) if counts is None else counts
    weight = _weights(terms, counts)
    told, vocabulary = _enough(terms, weight, like)
    shared = F.array_intersect("w", F.split(F.lit(" ".join(vocabulary)), " "))
    meets = lambda d: F.exists(
        told, lambda t: (F.size(d) >= t["least"]) & F.arrays_overlap(d, t["rare"]) & (F.size(F.array_intersect(d, t["terms"])) >= t["least"])
    )
    keys = ["path", "_h", "kind", "line", "lines"]
    # a lambda holds what is shared, so that it is found once a block
    near = _blocks(files).filter(F.exists(F.array(shared), meets)).dropDuplicates(keys)
    counted = near.select(*keys, F.explode("w").alias("term")).groupBy(*keys, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))
    return _best_templates(counted, keys, terms, weight, counts, like).drop("_h")


def _directory(path: Column) -> Column:
    """What stands before the last slash; empty for a file at the top."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(files: DataFrame, licence_file: Column, templates: dict[str, list[str]] | None = None, like: float = LIKE) -> DataFrame:
    """path, own (licence by its best line, header or whole text), score, inherited, from_directory and licence, one row per path.

    ``files``: path and text; ``licence_file`` tells from their columns, and from
    ``share`` (of its lines with words, those like a template or in a block that is), which files speak for their
    directory.  A file without a licence of its own inherits from the nearest
    directory above it that has a licence file; the best score wins in a
    directory, ties to the path that sorts first.  Directories, not files, are
    joined with their ancestors, so a directory with a third of all files is one row.

    Null and empty texts hold no licence; rows without path are left out; rows
    that repeat a path count as one file with the lines of all.
    """
    named = files.filter("path is not null")
    counts = term_counts(named)
    lines = line_licences(named, templates, like, counts).withColumns({"kind": F.lit(-1), "lines": F.lit(1)})
    blocks = block_licences(named, templates, like, counts)
    found = stored(lines.unionByName(blocks))
    own = found.groupBy("path").agg(
        F.min_by("licence", F.struct(-F.col("score"), "line", "licence")).alias("own"),
        F.max("score").alias("score"),
        F.greatest(F.count(F.when(F.col("kind") < 0, 1)), F.max("lines")).alias("_like"),
    )
    n_lines = F.size(F.filter(F.split(text_or_empty(), "\n"), lambda x: F.regexp_like(x, F.lit(r"[\p{L}\p{N}]"))))
    sizes = named.groupBy("path").agg(F.sum(n_lines).alias("_lines"))
    judged = sizes.join(own, "path", "left").withColumn("share", F.coalesce(F.col("_like") / F.col("_lines"), F.lit(0.0)))
    judged = judged.withColumn("directory", _directory(F.col("path")))
    speaks = judged.filter(F.col("own").isNotNull() & licence_file)
    best = speaks.groupBy("directory").agg(F.max("score").alias("score"))
    holders = (
        speaks.join(best, ["directory", "score"])
        .groupBy("directory")
        .agg(F.min_by("own", "path").alias("inherited"))
        .withColumnRenamed("directory", "from_directory")
    )
    steps = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    ancestors = judged.select("directory").distinct().select("directory", F.explode(F.array_distinct(above)).alias("from_directory"))
    nearest = (
        ancestors.join(holders, "from_directory")
        .groupBy("directory")
        .agg(F.max_by(F.struct("from_directory", "inherited"), F.length("from_directory")).alias("near"))
        .select("directory", "near.from_directory", "near.inherited")
    )
    out = judged.join(nearest, "directory", "left")
    return out.select(
        "path", "own", "score", "inherited", "from_directory", F.coalesce("own", "inherited").alias("licence")
    )
