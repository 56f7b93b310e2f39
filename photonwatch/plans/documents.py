"""Registered queries: chunking, page profiles, headings, sections, document jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonwatch import scale
from photonwatch.operators import text, transitions
from photonwatch.plans.fixtures import Tables
from photonwatch.plans.registry import query


def _manual_pages(t: Tables) -> DataFrame:
    """Documents as pages of their source; three of four open with a numbered heading."""
    kind = F.col("id") % 4
    number = F.when(kind == 1, "1. ").when(kind == 2, "1.2. ").when(kind == 3, "1.2.3. ").otherwise("")
    return t.chunks.select(
        F.col("filename").alias("document"),
        (F.col("chunk_index") + 1).alias("page"),
        F.concat(number, F.col("content")).alias("text"),
    )


_PAGES = """pages AS (SELECT filename AS document, chunk_index + 1 AS page,
 concat(CASE id % 4 WHEN 1 THEN '1. ' WHEN 2 THEN '1.2. ' WHEN 3 THEN '1.2.3. ' ELSE '' END, content) AS text FROM chunks)"""
_HEADINGS = f"""{_PAGES},
lines AS (SELECT document, page, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM pages),
parts AS (SELECT document, page, line, regexp_extract(trim(raw), '^((?:\\d+\\.){{1,3}})\\s+([A-Za-z].*)$', 1) AS number,
  trim(regexp_extract(trim(raw), '^((?:\\d+\\.){{1,3}})\\s+([A-Za-z].*)$', 2)) AS title FROM lines),
headings AS (SELECT document, page, CAST(line AS INTEGER) AS line, number, title, CAST(length(number) - length(replace(number, '.', '')) AS INTEGER) AS level
  FROM parts WHERE length(title) BETWEEN 4 AND 99)"""
_PATHS = f"""{_HEADINGS},
marks AS (SELECT *, page * 100000 + line AS at,
  last_value(CASE WHEN level = 1 THEN page * 100000 + line END IGNORE NULLS) OVER w AS one_at, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS one,
  last_value(CASE WHEN level = 2 THEN page * 100000 + line END IGNORE NULLS) OVER w AS two_at, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS two
  FROM headings WINDOW w AS (PARTITION BY document ORDER BY page, line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
paths AS (SELECT document, page, line, level, title, CASE level WHEN 1 THEN title WHEN 2 THEN concat_ws(' > ', one, title)
  ELSE concat_ws(' > ', one, CASE WHEN one_at IS NULL OR two_at > one_at THEN two END, title) END AS full_title FROM marks)"""


@query("k7_numbered_headings", views="chunks", sql=f"WITH {_HEADINGS} SELECT document, page, line, number, title, level FROM headings")
def _(t: Tables):
    return text.numbered_headings(_manual_pages(t)).select("document", "page", "line", "number", "title", "level")


@query("e13_section_paths", views="chunks", sql=f"WITH {_PATHS} SELECT document, page, line, level, title, full_title FROM paths")
def _(t: Tables):
    headings = text.numbered_headings(_manual_pages(t))
    return text.section_paths(headings, "document").select("document", "page", "line", "level", "title", "full_title")


@query("c18_section_of_page", views="chunks", sql=f"""
WITH {_PATHS}, best AS (SELECT p.document, p.page, s.full_title, row_number() OVER (PARTITION BY p.document, p.page ORDER BY s.page DESC, s.level DESC, s.line) AS r
 FROM pages p JOIN paths s ON s.document = p.document AND s.page <= p.page)
SELECT p.document, p.page, coalesce(b.full_title, concat('Content from Page ', CAST(p.page AS VARCHAR))) AS section
FROM pages p LEFT JOIN best b ON b.document = p.document AND b.page = p.page AND b.r = 1""")
def _(t: Tables):
    pages = _manual_pages(t)
    sections = text.section_paths(text.numbered_headings(pages), "document")
    return text.section_of_page(pages, sections, "document")


# documents as entries of a table of contents of their source, on six levels, three to a page
_ENTRIES = """
e AS (SELECT source AS document, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS no, CAST(1 + n_chars % 6 AS INTEGER) AS level, concat('Entry ', CAST(doc_id AS VARCHAR)) AS title FROM documents),
walk AS (SELECT document, no, level, title, [title] AS path FROM e WHERE no = 0
  UNION ALL SELECT e.document, e.no, e.level, e.title, list_append(list_slice(w.path, 1, e.level - 1), e.title) FROM walk w JOIN e ON e.document = w.document AND e.no = w.no + 1),
paths AS (SELECT document, no, level, title, len(path) AS depth, array_to_string(path, ' > ') AS full_title FROM walk)"""


def _entries(t: Tables) -> DataFrame:
    rows = t.raw("documents").select(F.col("source").alias("document"), "doc_id", (F.col("n_chars") % 6 + 1).cast("int").alias("level"))
    title = F.concat(F.lit("Entry "), F.col("doc_id").cast("string"))
    rows = rows.withColumn("title", title).withColumn("_bucket", F.floor(F.col("doc_id") / 1024))
    numbered = scale.split_row_number(rows, ["document"], "_bucket", [F.col("doc_id")], "no")
    return numbered.select("document", (F.col("no") - 1).alias("no"), "level", "title")


@query("e13_contents_paths", sql=f"WITH RECURSIVE {_ENTRIES} SELECT document, no, level, title, depth, full_title FROM paths")
def _(t: Tables):
    return text.contents_paths(_entries(t), "document").select("document", "no", "level", "title", "depth", "full_title")


@query("c18_section_by_contents", sql=f"""
WITH RECURSIVE {_ENTRIES}, asked AS (SELECT DISTINCT document, no // 2 AS page FROM e),
found AS (SELECT a.document, a.page, p.full_title, row_number() OVER (PARTITION BY a.document, a.page ORDER BY p.no // 3 DESC, p.no DESC) AS r
  FROM asked a LEFT JOIN paths p ON p.document = a.document AND p.no // 3 <= a.page)
SELECT document, page, coalesce(full_title, concat('Content from Page ', CAST(page AS VARCHAR))) AS section FROM found WHERE r = 1""")
def _(t: Tables):
    entries = _entries(t)
    sections = text.contents_paths(entries, "document").withColumn("page", F.floor(F.col("no") / 3)).withColumn("y_pos", F.col("no"))
    pages = entries.select("document", F.floor(F.col("no") / 2).alias("page")).distinct()
    return text.section_of_page(pages, sections, "document", order="y_pos")


_TERMS_SQL = ", ".join(f"CASE WHEN contains(lower(text), '{term.lower()}') THEN '{term}' END" for term in text.DOMAIN_TERMS)


@query("k5_page_profile", sql=f"""
SELECT doc_id, regexp_matches(text, '(?m)(?:^\\d+\\.[\\d\\.]*\\s+[A-Z]|^[A-Z][A-Z\\s]{{5,}}$|^\\d+\\.\\s+[A-Z])') AS has_headers,
 regexp_matches(text, '(?m)(?:^\\s*[•\\-\\*]\\s+|^\\s*\\d+\\.\\s+|^\\s*[a-z]\\)\\s+)') AS has_lists,
 array_to_string(list_filter([{_TERMS_SQL}], lambda x: x IS NOT NULL), ',') AS technical_terms,
 len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS word_count FROM documents""")
def _(t: Tables):
    return text.page_profile(t.raw("documents"))


def _has_sql(words) -> str:
    return "bool_or(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("k6_content_types", sql=f"""
SELECT source, array_to_string(list_filter([{", ".join(f"CASE WHEN {_has_sql(w)} THEN '{k}' END" for k, w in text.CONTENT_WORDS.items())}],
 lambda x: x IS NOT NULL), ',') AS content_types FROM documents GROUP BY source""")
def _(t: Tables):
    return text.content_types(t.raw("documents"), "source")


def _recursion(size: int, overlap: int, source: str) -> str:
    """Paragraph packing as a recursion over the parts of each text."""
    return f"""
parts AS (SELECT doc_id, string_split({source}, chr(10) || chr(10)) AS ps FROM documents),
pack AS (SELECT doc_id, ps, 0 AS i, '' AS held, false AS wrote, CAST(NULL AS VARCHAR) AS out FROM parts
 UNION ALL SELECT doc_id, ps, i + 1,
  CASE WHEN length(held) + length(ps[i + 1]) <= {size} THEN held || ps[i + 1] || chr(10) || chr(10)
       ELSE CASE WHEN wrote OR held <> '' THEN right(held, {overlap}) ELSE '' END || ps[i + 1] || chr(10) || chr(10) END,
  wrote OR (length(held) + length(ps[i + 1]) > {size} AND held <> ''),
  CASE WHEN length(held) + length(ps[i + 1]) > {size} AND held <> '' THEN held END
  FROM pack WHERE i < len(ps)),
outs AS (SELECT doc_id, i, out FROM pack WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, held FROM pack WHERE i = len(ps) AND held <> '')"""


_STRIP = "regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"


@query("k3_paragraph_chunks", sql=f"""
WITH RECURSIVE {_recursion(800, 100, "replace(text, chr(10), chr(10) || chr(10))")}
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, md5({_STRIP.format(c='out')}) AS digest FROM outs""")
def _(t: Tables):
    # the driver texts hold no blank lines: their lines are taken as paragraphs
    docs = t.raw("documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    pieces = text.chunked(docs, text.paragraph_chunks(size=800, overlap=100))
    return pieces.select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query("k1_fixed_chunks", sql=f"""
WITH RECURSIVE cuts AS (SELECT doc_id, text, 0 AS start, CAST(NULL AS BIGINT) AS stop FROM documents WHERE length(text) > 0
 UNION ALL SELECT doc_id, text, CASE WHEN stop IS NULL THEN start ELSE greatest(stop - 64, start + 1) END AS start,
  CAST((SELECT CASE WHEN s + 512 >= length(text) THEN s + 512 ELSE coalesce(
    {", ".join(f"CASE WHEN strpos(reverse(w), reverse({m})) > 0 THEN s + length(w) - strpos(reverse(w), reverse({m})) END" for m in ["'. '", "'.' || chr(10)", "'! '", "'!' || chr(10)", "'? '", "'?' || chr(10)"])},
    s + 512) END FROM (SELECT s, substr(text, s + 1, 512) AS w FROM (SELECT CASE WHEN stop IS NULL THEN start ELSE greatest(stop - 64, start + 1) END AS s))) AS BIGINT)
 FROM cuts WHERE CASE WHEN stop IS NULL THEN start ELSE greatest(stop - 64, start + 1) END < length(text)),
pieces AS (SELECT doc_id, start, {_STRIP.format(c='substr(text, start + 1, stop - start)')} AS piece FROM cuts WHERE stop IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_index, md5(piece) AS digest, length(piece) AS chunk_length FROM pieces WHERE piece <> ''""")
def _(t: Tables):
    pieces = text.fixed_chunked(t.raw("documents"), size=512, overlap=64)
    return pieces.select("doc_id", "chunk_index", F.md5("content").alias("digest"), F.col("chunk_length").cast("bigint").alias("chunk_length"))


@query("k2_heading_chunks", sql=f"""
WITH RECURSIVE secs AS (SELECT doc_id, list_transform(string_split(replace(text, chr(10) || 'The ', chr(10) || '## The '), chr(10) || '## '),
   lambda x, i: CASE WHEN i = 1 THEN x ELSE '## ' || x END) AS ss FROM documents WHERE text <> ''),
fold AS (SELECT doc_id, ss, 0 AS i, '' AS held, CAST(NULL AS VARCHAR) AS out FROM secs
 UNION ALL SELECT doc_id, ss, i + 1,
  CASE WHEN length(held) + length(ss[i + 1]) <= 900 THEN held || ss[i + 1] || chr(10) WHEN length(ss[i + 1]) > 900 THEN '' ELSE ss[i + 1] || chr(10) END,
  CASE WHEN length(held) + length(ss[i + 1]) > 900 AND held <> '' THEN held END FROM fold WHERE i < len(ss)),
big AS (SELECT doc_id, i + 1 AS sec, string_split(ss[i + 1], chr(10) || chr(10)) AS ps FROM fold
 WHERE i < len(ss) AND length(held) + length(ss[i + 1]) > 900 AND length(ss[i + 1]) > 900),
pack AS (SELECT doc_id, sec, ps, 0 AS j, '' AS held, CAST(NULL AS VARCHAR) AS out FROM big
 UNION ALL SELECT doc_id, sec, ps, j + 1,
  CASE WHEN length(held) + length(ps[j + 1]) <= 900 THEN held ELSE right(held, 100) END || ps[j + 1] || chr(10) || chr(10),
  CASE WHEN length(held) + length(ps[j + 1]) > 900 AND held <> '' THEN held END FROM pack WHERE j < len(ps)),
outs AS (SELECT doc_id, i AS sec, 0 AS j, out FROM fold WHERE out IS NOT NULL
 UNION ALL SELECT doc_id, i + 1, 0, held FROM fold WHERE i = len(ss) AND held <> ''
 UNION ALL SELECT doc_id, sec, j, out FROM pack WHERE out IS NOT NULL
 UNION ALL SELECT doc_id, sec, j + 1, held FROM pack WHERE j = len(ps) AND held <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec, j) - 1 AS chunk_index, md5({_STRIP.format(c='out')}) AS digest FROM outs""")
def _(t: Tables):
    # lines that open with "The" stand in for second-level headings
    docs = t.raw("documents").select("doc_id", F.regexp_replace("text", "\nThe ", "\n## The ").alias("text"))
    pieces = text.chunked(docs, text.heading_chunks(size=900, overlap=100))
    return pieces.select("doc_id", "chunk_index", F.md5("content").alias("digest"))


@query("k4_sentence_chunks", sql="""
WITH RECURSIVE parts AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
  lambda x: regexp_replace(regexp_replace(x, '^\\s+', ''), '\\s+$', '')), lambda x: x <> '') AS ss FROM documents),
pack AS (SELECT doc_id, ss, 0 AS i, '' AS held, CAST(NULL AS VARCHAR) AS out FROM parts
 UNION ALL SELECT doc_id, ss, i + 1,
  CASE WHEN length(CASE WHEN held = '' THEN ss[i + 1] ELSE held || ' ' || ss[i + 1] END) <= 512
       THEN CASE WHEN held = '' THEN ss[i + 1] ELSE held || ' ' || ss[i + 1] END
       ELSE CASE WHEN len(list_filter(regexp_split_to_array(held, '\\s+'), lambda w: w <> '')) > 16
            THEN array_to_string(list_slice(list_filter(regexp_split_to_array(held, '\\s+'), lambda w: w <> ''), -16, -1), ' ') || ' ' ELSE '' END || ss[i + 1] END,
  CASE WHEN length(CASE WHEN held = '' THEN ss[i + 1] ELSE held || ' ' || ss[i + 1] END) > 512 AND length(held) >= 100 THEN held END
 FROM pack WHERE i < len(ss)),
outs AS (SELECT doc_id, i, out FROM pack WHERE out IS NOT NULL UNION ALL SELECT doc_id, i + 1, held FROM pack WHERE i = len(ss) AND length(held) >= 100)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, md5(out) AS digest FROM outs""")
def _(t: Tables):
    pieces = text.chunked(t.raw("documents"), text.sentence_chunks())
    return pieces.select("doc_id", "chunk_index", F.md5("content").alias("digest"))


def _heading_option(n: int, pattern: str, weight: float) -> str:
    p = "(?i)" + pattern
    words = ", ".join(f"regexp_extract(line, '{p}', {g})" for g in ((1, 2) if n < 2 else (1,)))
    return (
        f"CASE WHEN length(line) >= 3 AND regexp_matches(line, '{p}') THEN struct_pack(score := {weight}::DOUBLE * (1.0::DOUBLE - i * 0.1::DOUBLE), "
        f"early := -i, first := -{n}, heading := trim(concat_ws(' ', {words}))) END"
    )


_HEADING_OPTIONS = ", ".join(_heading_option(n, p, w) for n, (p, w) in enumerate(text.HEADING_WEIGHTS))


@query("k8_best_heading", views="chunks", sql=f"""
WITH {_PAGES}, l AS (SELECT document, page, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\\r\\t]', ' ', 'g'))) AS ls FROM pages),
top AS (SELECT document, page, k - 1 AS i, ls[k] AS line FROM (SELECT *, unnest(range(1, least({text.HEADING_LINES}, len(ls)) + 1)) AS k FROM l)),
options AS (SELECT document, page, unnest([{_HEADING_OPTIONS}]) AS c FROM top),
best AS (SELECT document, page, list_sort(list(c))[-1] AS c FROM options WHERE c IS NOT NULL GROUP BY 1, 2),
titles AS (SELECT document, page, arg_min(line, i) AS title FROM top WHERE i < {text.TITLE_LINES} AND length(line) BETWEEN 10 AND 80 AND NOT ends_with(line, '.')
  AND NOT starts_with(line, '•') AND NOT regexp_matches(line, '^\\d+\\s') AND regexp_matches(line, '\\p{{Lu}}') GROUP BY 1, 2)
SELECT p.document, p.page, CASE WHEN b.c.score >= {text.WEAK_HEADING} THEN b.c.heading ELSE coalesce(t.title, b.c.heading, concat('Content from Page ', CAST(p.page AS VARCHAR))) END AS heading
FROM pages p LEFT JOIN best b USING (document, page) LEFT JOIN titles t USING (document, page)""")
def _(t: Tables):
    return text.best_heading(_manual_pages(t), key="document")


@query("a8_stored_documents", views="library chunks", sql="""
SELECT y.id, y.filename, count(c.id) AS chunk_count, CAST(sum(length(c.content)) AS BIGINT) AS total_length FROM library y JOIN chunks c ON c.filename = y.filename GROUP BY 1, 2""")
def _(t: Tables):
    return t.chunks.groupBy("filename").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("content")).alias("total_length")
    ).join(t.library.select("id", "filename"), "filename")


@query("l6_soft_delete", views="library", sql="""
SELECT id, filename, CASE WHEN status = 'active' AND (id % 5 = 2 OR filename IN ('src4', 'src9')) THEN 'inactive' ELSE status END AS status FROM library""")
def _(t: Tables):
    by_id = t.library.filter(F.col("id") % 5 == 2).select("id", F.lit(None).cast("string").alias("filename"))
    by_name = t.library.filter(F.col("filename").isin("src4", "src9")).select(F.lit(None).cast("bigint").alias("id"), "filename")
    return transitions.delete_documents(t.library, by_id.unionByName(by_name)).select("id", "filename", "status")
