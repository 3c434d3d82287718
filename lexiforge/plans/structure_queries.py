"""Queries of sections, chunkers and page extraction over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiforge.config import Settings
from lexiforge.functions import metadata as M
from lexiforge.functions import patterns as P
from lexiforge.functions import text as T
from lexiforge.operators import structure as S
from lexiforge.plans.registry import WS, document_lines, norm_sql, query, table, words_sql
from lexiforge.sources import files as H

SMALL = Settings(chunk_size=500, chunk_overlap=80, max_chunk=800)

_LINES = "lines AS (SELECT doc_id AS path, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS page_id, unnest(string_split(text, chr(10))) AS line FROM documents)"
_TRIM = rf"regexp_replace(line, '^{WS}+|{WS}+$', '', 'g')"
_HEADER = "CASE WHEN " + " OR ".join(f"regexp_matches({_TRIM}, '{p}')" for _, p in P.SECTIONS) + f" THEN {_TRIM} END"


@query(f"WITH {_LINES} SELECT path, page_id, md5(coalesce(last_value({_HEADER} IGNORE NULLS) OVER (PARTITION BY path ORDER BY page_id ROWS UNBOUNDED PRECEDING), 'Introduction')) AS section FROM lines")
def section_carry(spark, d):
    return S.page_sections(document_lines(spark, d)).select("path", "page_id", F.md5("section").alias("section"))


@query(f"WITH {_LINES}, c AS (SELECT path, page_id, coalesce(last_value({_HEADER} IGNORE NULLS) OVER (PARTITION BY path ORDER BY page_id ROWS UNBOUNDED PRECEDING), 'Introduction') AS section FROM lines) SELECT path, md5(section) AS section, array_to_string(list(page_id ORDER BY page_id), ',') AS pages FROM c GROUP BY path, section")
def section_maps(spark, d):
    return S.section_maps(S.page_sections(document_lines(spark, d))).select("path", F.md5("section").alias("section"), F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("""WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(start // 500 AS INTEGER) AS pos, md5(trim(text[start + 1:start + 500])) AS chunk FROM s WHERE trim(text[start + 1:start + 500]) <> ''""")
def fixed_chunks(spark, d):
    return S.fixed_chunks(table(spark, d, "documents")).select("doc_id", "pos", F.md5("chunk").alias("chunk"))


#: Chunkers as recursions: each round works off one line or element of every document.
_CHUNK = "STRUCT(t VARCHAR, p INTEGER[], s VARCHAR)[]"
_PAGE_CHUNKS = f"""{_LINES}, sects AS MATERIALIZED (SELECT path, page_id, line, coalesce(last_value({_HEADER} IGNORE NULLS) OVER (PARTITION BY path ORDER BY page_id ROWS UNBOUNDED PRECEDING), 'Introduction') AS section FROM lines),
fold(path, i, cur, pages, section, out) AS (
  SELECT doc_id, 0, '', []::INTEGER[], NULL::VARCHAR, []::{_CHUNK} FROM documents
  UNION ALL
  SELECT path, i + 1, CASE WHEN fits THEN cur1 WHEN length(cur1) > 80 THEN right(cur1, 80) ELSE '' END || chr(10) || '[Page ' || page_id || ']' || chr(10) || line,
    CASE WHEN fits THEN list_append(pages1, page_id) ELSE [page_id] END, turned_to, CASE WHEN NOT fits AND cur1 <> '' THEN list_append(out1, {{'t': cur1, 'p': pages1, 's': section}}) ELSE out1 END
  FROM (SELECT *, length(cur1) + length(line) <= 800 AS fits FROM (
    SELECT path, i, page_id, line, section, turned_to, CASE WHEN turned THEN '' ELSE cur END AS cur1, CASE WHEN turned THEN [] ELSE pages END AS pages1,
      CASE WHEN turned AND length(cur) > 100 THEN list_append(out, {{'t': cur, 'p': pages, 's': section}}) ELSE out END AS out1
    FROM (SELECT f.*, s.page_id, s.line, s.section AS turned_to, (f.section IS NULL OR s.section <> f.section) AND f.cur <> '' AS turned FROM fold f JOIN sects s ON s.path = f.path AND s.page_id = f.i + 1)))),
gathered AS (SELECT path, CASE WHEN length(cur) > 100 THEN list_append(out, {{'t': cur, 'p': pages, 's': section}}) ELSE out END AS out FROM fold QUALIFY row_number() OVER (PARTITION BY path ORDER BY i DESC) = 1),
chunked AS MATERIALIZED (SELECT path, unnest(out) AS c, generate_subscripts(out, 1) AS no FROM gathered)"""


def _told(chunked):
    """Chunks with their texts and sections as digests and their pages as a list."""
    pages = F.array_join(F.transform("pages", lambda p: p.cast("string")), ",")
    return chunked.select("path", "chunk_no", F.md5("text").alias("text"), pages.alias("pages"), F.md5("section").alias("section"))


@query(f"WITH RECURSIVE {_PAGE_CHUNKS} SELECT path, CAST(no - 1 AS INTEGER) AS chunk_no, md5(c.t) AS text, array_to_string(c.p, ',') AS pages, md5(c.s) AS section FROM chunked")
def page_chunks(spark, d):
    return _told(S.page_chunks(S.page_sections(document_lines(spark, d)), SMALL))


@query()
def hier_chunks(spark, d):
    """Held against a sequential version in the tests."""
    return S.hierarchical_chunks(S.page_sections(document_lines(spark, d)), SMALL)


@query(f"""WITH RECURSIVE {_PAGE_CHUNKS}, merged(path, i, acc) AS (
  SELECT DISTINCT path, CAST(0 AS BIGINT), []::{_CHUNK} FROM chunked
  UNION ALL
  SELECT m.path, i + 1, CASE WHEN len(acc) > 0 AND acc[-1].s = c.s AND length(acc[-1].t) + length(c.t) < 1500
    THEN list_append(acc[1:len(acc) - 1], {{'t': acc[-1].t || chr(10) || c.t, 'p': list_sort(list_distinct(list_concat(acc[-1].p, c.p))), 's': c.s}}) ELSE list_append(acc, c) END
  FROM merged m JOIN chunked k ON k.path = m.path AND k.no = m.i + 1),
whole AS (SELECT path, acc FROM merged QUALIFY row_number() OVER (PARTITION BY path ORDER BY i DESC) = 1),
told AS (SELECT path, unnest(acc) AS c, generate_subscripts(acc, 1) AS no FROM whole)
SELECT path, CAST(no - 1 AS INTEGER) AS chunk_no, md5(c.t) AS text, array_to_string(c.p, ',') AS pages, md5(c.s) AS section FROM told""")
def merged_chunks(spark, d):
    return _told(S.merge_chunks(S.page_chunks(S.page_sections(document_lines(spark, d)), SMALL), 1500))


def _elements(spark, d):
    """Headings, list items and paragraphs of pages, in order, as layout elements."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*+>.*?</(?:h[1-6]|p|li)\s*>"), F.lit(0))
    rows = table(spark, d, "pages").select(F.col("page_id").alias("path"), F.posexplode(found).alias("ord", "tag"))
    kind = F.when(F.rlike("tag", F.lit("(?i)^<h[1-6]")), F.lit("heading")).when(F.rlike("tag", F.lit("(?i)^<li")), F.lit("list")).otherwise(F.lit("paragraph"))
    return rows.select("path", "ord", kind.alias("element_type"), T.clean(H.entities(F.regexp_replace("tag", r"(?s)<[^>]*+>", " "))).alias("content"), F.lit(1).alias("page_number"))


def _decode(c: str) -> str:
    for name, sign in H.ENTITIES:
        c = f"replace({c}, '{name}', '{sign.replace(chr(39), chr(39) * 2)}')"
    return c


_ELEMENTS = r"""tags AS (SELECT page_id AS path, unnest(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)\s*>')) AS tag, generate_subscripts(regexp_extract_all(html, '(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?</(?:h[1-6]|p|li)\s*>'), 1) AS ord FROM pages),
elements AS (SELECT path, ord, CASE WHEN regexp_matches(tag, '(?i)^<h[1-6]') THEN 'heading' WHEN regexp_matches(tag, '(?i)^<li') THEN 'list' ELSE 'paragraph' END AS kind,
  trim(regexp_replace(""" + _decode("regexp_replace(tag, '(?s)<[^>]*>', ' ', 'g')") + r""", '[\x09-\x0D\x20]+', ' ', 'g')) AS content FROM tags)"""


@query(f"WITH {_ELEMENTS} SELECT path, CAST(ord - 1 AS INTEGER) AS ord, kind AS element_type, md5(coalesce(last_value(CASE WHEN kind = 'heading' THEN content END IGNORE NULLS) OVER (PARTITION BY path ORDER BY ord ROWS UNBOUNDED PRECEDING), '')) AS section FROM elements")
def element_sections(spark, d):
    return S.carried_sections(_elements(spark, d)).select("path", "ord", "element_type", F.md5("section").alias("section"))


@query(f"WITH {_ELEMENTS} SELECT path, coalesce(arg_min(CASE WHEN kind = 'heading' THEN content END, CASE WHEN kind = 'heading' THEN ord END), 'Untitled Document') AS title, CAST(count(*) AS BIGINT) AS elements, md5(string_agg(content, chr(10) ORDER BY ord)) AS content_hash FROM elements GROUP BY path")
def element_documents(spark, d):
    """Title, size and content hash of each page's elements."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "content")))
    head = F.min_by(F.when(F.col("element_type") == "heading", F.col("content")), F.when(F.col("element_type") == "heading", F.col("ord")))
    return _elements(spark, d).groupBy("path").agg(F.coalesce(head, F.lit("Untitled Document")).alias("title"), F.count("*").alias("elements"), F.md5(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n")).alias("content_hash"))


@query(f"""WITH RECURSIVE {_ELEMENTS}, fold(path, i, cur, pages, section, out) AS (
  SELECT DISTINCT path, CAST(0 AS BIGINT), '', []::INTEGER[], '', []::{_CHUNK} FROM elements
  UNION ALL
  SELECT path, i + 1, CASE WHEN length(cur2) >= 300 THEN right(cur2, 50) ELSE cur2 END, [1], named, CASE WHEN length(cur2) >= 300 THEN list_append(out2, {{'t': cur2, 'p': [1], 's': named}}) ELSE out2 END
  FROM (SELECT *, CASE WHEN cur1 = '' THEN content WHEN over THEN right(cur1, 50) || chr(10) || content ELSE cur1 || chr(10) || content END AS cur2,
      CASE WHEN over AND length(cur1) >= 40 THEN list_append(out1, {{'t': cur1, 'p': [1], 's': named}}) ELSE out1 END AS out2
    FROM (SELECT *, length(cur1) + length(content) + 1 > 400 AS over FROM (
      SELECT path, i, content, CASE WHEN kind = 'heading' THEN content ELSE section END AS named, CASE WHEN flushed THEN '' ELSE cur END AS cur1,
        CASE WHEN flushed THEN list_append(out, {{'t': cur, 'p': pages, 's': section}}) ELSE out END AS out1
      FROM (SELECT f.*, e.kind, e.content, e.kind = 'heading' AND length(f.cur) >= 40 AS flushed FROM fold f JOIN elements e ON e.path = f.path AND e.ord = f.i + 1))))),
whole AS (SELECT path, CASE WHEN length(cur) >= 40 THEN list_append(out, {{'t': cur, 'p': pages, 's': section}}) ELSE out END AS out FROM fold QUALIFY row_number() OVER (PARTITION BY path ORDER BY i DESC) = 1),
told AS (SELECT path, unnest(out) AS c, generate_subscripts(out, 1) AS no FROM whole)
SELECT path, CAST(no - 1 AS INTEGER) AS chunk_no, md5(c.t) AS text, array_to_string(c.p, ',') AS pages, md5(c.s) AS section FROM told""")
def element_chunks(spark, d):
    return _told(S.element_chunks(_elements(spark, d), Settings(chunk_size=300, chunk_overlap=50, max_chunk=400, min_chunk=40)))


def _strip(tags: tuple[str, ...]) -> str:
    out = "html"
    for t in tags:
        out = rf"regexp_replace({out}, '(?is)<{t}\b[^>]*>.*?</{t}\s*>', ' ', 'g')"
    return out


_HTML = _decode(rf"regexp_replace(regexp_replace({_strip(('script', 'style', 'nav', 'footer'))}, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', chr(10), 'g')")


@query(rf"SELECT page_id, md5(trim(regexp_replace(regexp_replace({_HTML}, '{WS}+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'))) AS text FROM pages")
def html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(H.html_text(F.col("html"))).alias("text"))


@query(rf"SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split({_HTML}, chr(10)), lambda x: trim(regexp_replace(x, '{WS}+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text FROM pages")
def html_lines(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(H.html_text(F.col("html"), keep_lines=True)).alias("text"))


_HTML1 = _decode(rf"regexp_replace({_strip(('script', 'style'))}, '(?s)<[^>]*>', '', 'g')")


@query(rf"SELECT page_id, md5(array_to_string(list_filter(list_transform(flatten(list_transform(regexp_split_to_array({_HTML1}, '\r\n|[\n\r]'), lambda l: string_split(trim(l), '  '))), lambda p: trim(p)), lambda p: p <> ''), ' ')) AS text FROM pages")
def html_text_v1(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(H.html_text_v1(F.col("html"))).alias("text"))


@query(r"WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>')) AS t, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>.*?</h[1-6]\s*>'), 1) AS pos FROM pages) SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(regexp_extract(t, '(?i)<h([1-6])', 1) AS INTEGER) AS level, trim(regexp_replace(" + _decode("regexp_replace(t, '(?s)<[^>]*>', ' ', 'g')") + rf", '{WS}+', ' ', 'g')) AS title FROM h")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(H.headings(F.col("html"))).alias("pos", "h")).select("page_id", "pos", "h.level", "h.title")


_MD = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g'), '!\[.*?\]\(.*?\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[*_~]+', '', 'g')"
_MD1 = rf"regexp_replace(regexp_replace(regexp_replace({_MD}, '(?m)^#+\s+', '', 'g'), '(?m)^[-*+]\s+', '', 'g'), '(?m)^\d+\.\s+', '', 'g')"


@query(f"SELECT doc_id, md5({_MD}) AS text, md5(array_to_string(list_filter(list_transform(string_split({_MD1}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS plain FROM documents")
def markdown_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(H.markdown_text(F.col("text"))).alias("text"), F.md5(H.markdown_plain(F.col("text"))).alias("plain"))


_TITLE = r"""trim(CASE WHEN regexp_extract(text[1:1000], '(?m)^#\s*(.+)$', 1) <> '' THEN regexp_extract(text[1:1000], '(?m)^#\s*(.+)$', 1) ELSE regexp_extract(text[1:1000], '(?m)^(.+)\n[=\-]{3,}', 1) END)"""
_SPEC = r"""CASE WHEN regexp_extract(upper(text[1:5000]), '(TS|TR)\s*(\d{2}\.\d{3})', 2) <> '' THEN regexp_extract(upper(text[1:5000]), '(TS|TR)\s*(\d{2}\.\d{3})', 1) || ' ' || regexp_extract(upper(text[1:5000]), '(TS|TR)\s*(\d{2}\.\d{3})', 2) END"""
_VERSION = r"coalesce(nullif(regexp_extract(lower(source), 'v(\d+(?:\.\d+)*)', 1), ''), nullif(regexp_extract(lower(source), 'rel[ease]*[-_]?(\d+)', 1), ''), nullif(regexp_extract(lower(source), 'l(\d{2}[a-z])', 1), ''), nullif(regexp_extract(lower(source), '(\d{4}[-_]\d{2})', 1), ''), nullif(regexp_extract(lower(source), 'rev[ision]*[-_]?(\d+)', 1), ''))"


@query(f"""WITH {_LINES}, c AS (SELECT path, page_id, coalesce(last_value({_HEADER} IGNORE NULLS) OVER (PARTITION BY path ORDER BY page_id ROWS UNBOUNDED PRECEDING), 'Introduction') AS section FROM lines),
heads AS (SELECT path, list(section ORDER BY first)[1:20] AS s FROM (SELECT path, section, min(page_id) AS first FROM c GROUP BY ALL) GROUP BY path),
s AS (SELECT doc_id, source, lang, text, {_TITLE} AS title, {_VERSION} AS version, {_SPEC} AS spec, array_to_string(h.s, '; ') AS sections FROM documents JOIN heads h ON path = doc_id)
SELECT doc_id, md5(concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, 'Vendor: ' || lang, 'Version: ' || version, 'Specification: ' || spec, 'Topics: ' || source || ', ' || lang, 'Sections: ' || sections, CASE WHEN text <> '' THEN 'Content preview: ' || text[1:1000] END)) AS summary FROM s""")
def document_summary(spark, d):
    """The language stands for the vendor, source and language for the topics; the source's name holds the version."""
    maps = S.section_maps(S.page_sections(document_lines(spark, d))).select("path", F.struct(F.element_at("pages", 1).alias("first"), "section").alias("_s"))
    heads = maps.groupBy(F.col("path").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list("_s")), lambda x: x["section"]).alias("sections"))
    text = F.col("text")
    docs = table(spark, d, "documents").select("doc_id", "text", M.title(text).alias("title"), F.col("lang").alias("vendor"), M.version(F.col("source")).alias("version"), M.spec_number(text).alias("spec_number"), F.array("source", "lang").alias("topics"))
    return S.document_summary(docs.join(heads, "doc_id")).select("doc_id", F.md5("summary").alias("summary"))


@query(f"""WITH s AS (SELECT doc_id, nullif(lang, 'en') AS vendor, replace({_SPEC}, ' ', '') AS spec, 'v' || {_VERSION} AS version, source || '.' || doc_id AS stem, source, lang, text FROM documents),
k AS (SELECT *, concat_ws('_', vendor, spec, version) AS parts FROM s)""" + r"""
SELECT doc_id, lower(CASE WHEN parts = '' THEN stem ELSE parts END) AS doc_key, 'Figure: ' || stem || chr(10) || 'Content: ' || md5(text) AS image, regexp_replace(trim(text[1:200]), '[<>:"/\\|?*]', '_', 'g')[1:150] AS file_name FROM k""")
def naming(spark, d):
    """Document ids, image texts and safe file names. Other languages than English stand for vendors."""
    path = F.concat(F.lit("all/"), "source", F.lit("."), F.col("doc_id").cast("string"), F.lit(".txt"))
    key = M.document_id(F.expr("nullif(lang, 'en')"), M.spec_number(F.col("text")), M.version(F.col("source")), path)
    image = T.image_text(M.stem(path), F.lit(None).cast("string"), F.md5("text"))
    return table(spark, d, "documents").select("doc_id", key.alias("doc_key"), image.alias("image"), T.safe_name(F.substring("text", 1, 200)).alias("file_name"))
