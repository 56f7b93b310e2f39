"""Registered queries of the training-data operators and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonwatch.llm import bpe, decontaminate, jaccard, language, licences, line_dedup, neighbours, quality, repair, sharding, toxicity, trie, urls
from photonwatch.llm.common import id_crc32, stored, text_or_empty

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    """Path of the byte-level vocabulary on this machine; executors have the same package."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op1_quality_classifier")
def _(spark: SparkSession, folder: str) -> DataFrame:
    stats = stored(quality.document_statistics(table(spark, folder, "documents")))
    labels = table(spark, folder, "labels").filter(id_crc32() % 3 != 1)
    model = quality.fit(stats, labels)
    return quality.score(stats, model).select("doc_id", (id_crc32() % 3 == 1).alias("held_out"), "score", "predicted")


@query("op2_toxicity")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, toxicity.training_labels(table(spark, folder, "labels"), 4, 2))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (id_crc32() % 4 == 2).alias("held_out"), "score", "predicted")


_TEMPLATES = ", ".join(
    f"({k}, '{licence}', '{text}')" for k, (licence, text) in enumerate((n, x) for n, texts in licences.TEMPLATES.items() for x in texts)
)


@query(
    "op3_licence_scan",
    sql=rf"""
WITH tmpl(template, licence, text) AS (VALUES {_TEMPLATES}),
terms AS (SELECT template, licence, term, count(*) AS tf FROM (SELECT template, licence,
  unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM tmpl) GROUP BY ALL),
files AS (SELECT doc_id, concat_ws('/', source, lang, CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path,
  string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT path, i, list_filter(regexp_split_to_array(lower(l[i]), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w
  FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM files)),
listed AS (SELECT * FROM lines WHERE len(w) > 0),
tot AS (SELECT greatest(1, count(*)) AS n FROM listed),
tf AS (SELECT path, i, term, count(*) AS tf FROM (SELECT path, i, unnest(w) AS term FROM listed) GROUP BY ALL),
weight AS (SELECT v.term, ln(1 + n / (1 + count(tf.term))) AS weight FROM (SELECT DISTINCT term FROM terms) v LEFT JOIN tf ON tf.term = v.term, tot GROUP BY v.term, n),
words AS (SELECT path, i, tf.term, tf * coalesce(weight, ln(1 + n / 2)) AS w FROM tf LEFT JOIN weight USING (term), tot),
norms AS (SELECT path, i, sqrt(sum(w * w)) AS norm FROM words GROUP BY ALL),
sides AS (SELECT template, sqrt(sum((tf * weight) * (tf * weight))) AS norm FROM terms JOIN weight USING (term) GROUP BY ALL),
liked AS (SELECT path, i, licence, round(sum(words.w * terms.tf * weight.weight / sides.norm) / norms.norm, 9) AS score
  FROM words JOIN terms USING (term) JOIN weight USING (term) JOIN sides USING (template) JOIN norms USING (path, i) GROUP BY path, i, template, licence, norms.norm),
best AS (SELECT path, i, score, min(licence) AS licence FROM (SELECT *, max(score) OVER (PARTITION BY path, i) AS top FROM liked WHERE score >= 0.75) WHERE score = top GROUP BY ALL),
own AS (SELECT path, arg_max(licence, struct_pack(a := score, b := -i)) AS own, max(score) AS score, count(*) AS n_like FROM best GROUP BY path),
judged AS (SELECT f.doc_id, f.path, own, score, coalesce(n_like / n_lines, 0) AS share, regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS directory
  FROM files f LEFT JOIN own USING (path) LEFT JOIN (SELECT path, count(*) AS n_lines FROM listed GROUP BY path) USING (path)),
holders AS (SELECT directory AS from_directory, arg_min(own, path) AS inherited FROM
  (SELECT *, max(score) OVER (PARTITION BY directory) AS top FROM judged WHERE own IS NOT NULL AND share >= 0.1) WHERE score = top GROUP BY directory),
above AS (SELECT directory, array_to_string(list_slice(string_split(directory, '/'), 1, k), '/') AS from_directory FROM
  (SELECT directory, unnest(range(0, len(string_split(directory, '/')) + 1)) AS k FROM (SELECT DISTINCT directory FROM judged))),
near AS (SELECT directory, arg_max(from_directory, length(from_directory)) AS from_directory, arg_max(inherited, length(from_directory)) AS inherited
  FROM above JOIN holders USING (from_directory) GROUP BY directory)
SELECT doc_id, path, own, round(score, 6) AS score, inherited, from_directory, coalesce(own, inherited) AS licence FROM judged LEFT JOIN near USING (directory)""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    # documents as files: source / language / thousand / id; a text of which a tenth of the lines name a licence speaks for its directory
    path = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    files = table(spark, folder, "documents").select(path.alias("path"), "text")
    found = licences.scan(files, F.col("share") >= 0.1)
    return found.select(
        F.element_at(F.split("path", "/"), -1).cast("bigint").alias("doc_id"),
        "path",
        "own",
        F.round("score", 6).alias("score"),
        "inherited",
        "from_directory",
        "licence",
    )


@query("op4_ngram_jaccard")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, folder, "documents"), width=3, percent=90)


RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]


@query("op5_url_filter")
def _(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    counts = stored(urls.word_counts(pages, "html"))
    return urls.classify(pages.select("page_id", "url"), counts, RULES).select("page_id", "host", "path", "rule", "verdict", "score")


@query("op6_nearest_vectors")
def _(spark: SparkSession, folder: str) -> DataFrame:
    vectors = neighbours.usable(table(spark, folder, "embeddings"), "vec_id", "embedding")
    return neighbours.search(neighbours.build_index(vectors), vectors.filter("id % 50 = 0"))


@query(
    "op7_substring_dedup",
    sql=r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*|[.!?\n]+') AS l FROM documents),
u AS (SELECT row, doc_id, i, l[i] AS unit FROM (SELECT row, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)),
n AS (SELECT *, trim(regexp_replace(lower(unit), '[^\p{L}\p{N}]+', ' ', 'g')) AS norm,
        coalesce(sum(length(unit)) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM u),
w AS (SELECT *, CASE WHEN norm = '' THEN 0 ELSE greatest(len(string_split(norm, ' ')), length(norm) // 8) END AS n_words FROM n),
o AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY i) AS ord, row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS FIRST, row, i) > 1 AS again
  FROM w WHERE n_words >= 3),
r AS (SELECT *, ord - row_number() OVER (PARTITION BY row ORDER BY ord) AS run FROM o WHERE again),
gone AS (SELECT row, min(i) AS a, max(i) AS b FROM r GROUP BY row, run HAVING sum(n_words) > 40),
spans AS (SELECT g.row, g.a, CAST(x.start AS BIGINT) AS s, CAST(y.start + length(y.unit) AS BIGINT) AS e
  FROM gone g JOIN w x ON x.row = g.row AND x.i = g.a JOIN w y ON y.row = g.row AND y.i = g.b),
listed AS (SELECT row, count(*) AS n_removed, string_agg(s || '-' || e, ',' ORDER BY a) AS removed FROM spans GROUP BY row),
left_over AS (SELECT w.row, string_agg(unit, '' ORDER BY i) AS text FROM w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.row = w.row AND w.i BETWEEN g.a AND g.b) GROUP BY w.row)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, coalesce(o.text, '') AS text
FROM d LEFT JOIN listed USING (row) LEFT JOIN left_over o USING (row)""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, folder, "documents").select("doc_id", "text"))
    span = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return out.select(
        "doc_id", F.size("removed").cast("bigint").alias("n_removed"), F.array_join(span, ",").alias("removed"), text_or_empty().alias("text")
    )


@query(
    "op8_decontamination",
    sql=r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS win FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM wins),
places AS (SELECT row, n, i, list_slice(w, i, i + n - 1) AS win FROM (
    SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
found AS (SELECT p.row, p.i, p.n, x.item_id FROM places p JOIN wins x ON p.n = x.n AND p.win = x.win),
words AS (SELECT row, count(DISTINCT pos) AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS pos FROM found) GROUP BY row),
names AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM found GROUP BY row)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (row) LEFT JOIN names USING (row)""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query("op9_bpe")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), vocabulary(), with_text=False)


@query("op10_sharding")
def _(spark: SparkSession, folder: str) -> DataFrame:
    text = text_or_empty()
    # texts are read once; counts and draws go over the narrow table
    sized = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shuffle_into_shards(stored(sized)).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


# CRC-32 of the digits of a number: the table of its 256 remainders, then one step per character
_CRC = """
tab AS (SELECT list(v ORDER BY k) AS t FROM (SELECT k, list_reduce(list_prepend(CAST(k AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]),
  lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) x(k)))"""


def _crc_sql(text: str) -> str:
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({text}, ''), lambda c: CAST(ord(c) AS BIGINT))), "
        "lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"
    )


# what insertions and edits do to the state: 0 nothing yet, 1 system, 2 user, 3 assistant
_INSERTIONS = """(VALUES (0, 0, 0, '', []), (0, 2, 5, 'I', ['user:']), (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 1, 0, '', []), (1, 2, 5, 'I', ['user:']),
  (1, 3, 10, 'II', ['user:', 'assistant:']), (2, 2, 0, '', []), (2, 3, 5, 'I', ['assistant:']), (3, 3, 0, '', []), (3, 2, 5, 'I', ['user:']))"""


@query(
    "op11_conversation_repair",
    sql=rf"""
WITH RECURSIVE {_CRC},
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS k FROM conversations),
crc AS (SELECT *, {_crc_sql("k")} % 20 AS kind FROM keyed, tab),
damaged AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE kind <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM damaged),
judged AS (SELECT *, substr(role, 1, 1) AS c, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
  bare <> '' AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS c_before FROM ordered),
ins AS (SELECT * FROM {_INSERTIONS} x(i, k, cost, audit, lines)),
edits AS (SELECT * FROM (VALUES ('D', '', 0, 0, 2), ('D', '', 1, 1, 2), ('D', '', 2, 2, 2), ('D', '', 3, 3, 2), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
  ('R', 'user', 0, 2, 1), ('R', 'user', 1, 2, 1), ('R', 'user', 3, 2, 1), ('R', 'assistant', 2, 3, 1)) x(edit, c, k, st, cost)),
walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS n, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM judged
  UNION ALL SELECT conv_id, n, st, cost, audit, lines FROM (
    SELECT r.conv_id, r.n, e.st, CAST(w.cost + ins.cost + e.cost + CASE WHEN r.cut AND e.edit <> 'D' THEN 5 ELSE 0 END AS BIGINT) AS cost, w.audit || ins.audit || e.edit AS audit,
      list_concat(w.lines, ins.lines, CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.c || ':' || r.text] END) AS lines
    FROM walk w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1 JOIN ins ON ins.i = w.st
    JOIN edits e ON e.k = ins.k AND (e.edit = 'D' OR NOT (r.blank OR r.again) AND (e.edit = 'R' OR e.c = r.c)))
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1),
ends AS (SELECT w.conv_id, w.cost + ins.cost AS cost, w.audit || ins.audit AS audit, list_concat(w.lines, ins.lines) AS lines
  FROM walk w JOIN (SELECT conv_id, max(n) AS n FROM judged GROUP BY 1) m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.n = w.n JOIN ins ON ins.i = w.st AND ins.k IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + ins.cost, w.audit || ins.audit) = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate,
  count(*) FILTER (WHERE cut AND NOT again) AS truncated, count(*) FILTER (WHERE c_before IS NOT NULL AND c_before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY 1)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM i.conv_id""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return repair.repair(repair.damaged(conversations), conversations)[0]


@query(
    "op12_prefix_trie",
    sql=rf"""
WITH {_CRC},
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, {_crc_sql("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM r), tab),
u AS (SELECT i.conv_id, 0 AS own, place, role, text FROM ids i JOIN r ON r.conv_id = i.conv_id - i.conv_id % 20 AND place <= h
  UNION ALL SELECT i.conv_id, 1, place, role, text FROM ids i JOIN r USING (conv_id) WHERE place > h),
seq AS (SELECT i.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY own, place) FILTER (WHERE own IS NOT NULL), []) AS s
  FROM ids i LEFT JOIN u USING (conv_id) GROUP BY i.conv_id),
member AS (SELECT conv_id, len(s) AS n, d, list_slice(s, 1, d) AS p FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM seq)),
node AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
  (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^ 	-
]+')) END AS own FROM member GROUP BY d, p),
kids AS (SELECT d - 1 AS d, list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (d, p)),
up AS (SELECT d, own, n_children, p, unnest(range(0, d + 1)) AS a FROM full_node),
below AS (SELECT a AS d, list_slice(p, 1, a) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own) AS saved FROM up GROUP BY ALL)
SELECT f.conv_id, f.d AS depth, q.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN below b USING (d, p) LEFT JOIN node q ON q.d = f.d - 1 AND q.p = list_slice(f.p, 1, f.d - 1)""",
)
def _(spark: SparkSession, folder: str) -> DataFrame:
    ids, listed = trie.rebuilt(trie.turns(table(spark, folder, "conversations")))
    return trie.prefix_trie(ids, listed)


@query("op13_language_id")
def _(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = id_crc32() % 4 == 2
    profiles = language.fit(docs.filter(~held_out).select("text", "lang"))
    return language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles).drop("text")
