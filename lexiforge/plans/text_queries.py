"""Queries of the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import measures as X
from lexiforge.functions import metadata as M
from lexiforge.functions import patterns as P
from lexiforge.functions import text as T
from lexiforge.operators import clean as C
from lexiforge.plans.registry import WS, document_lines, keywords_sql, norm_sql, plain_sql, query, table, tokens_sql, words_sql
from lexiforge.session import spread


def _case(c: str, rows) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{T.either(p)}') THEN '{label}'" for label, p in rows) + " END"


@query(rf"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{{9F}}]', '', 'g'))) AS cleaned FROM documents")
def clean_text(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned"))


@query(rf"""SELECT doc_id, md5({norm_sql('text')}) AS md5_key, substr(sha256({norm_sql('text')}), 1, 32) AS sha_key,
  md5(trim(regexp_replace(regexp_replace(lower(text), '{WS}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\x09-\x0D\x20.-]', '', 'g'))) AS similarity_key FROM documents""")
def dedup_keys(spark, d):
    text = F.col("text")
    return spread(table(spark, d, "documents")).select("doc_id", T.md5_key(text).alias("md5_key"), T.sha_key(text).alias("sha_key"), F.md5(T.similarity_form(text)).alias("similarity_key"))


@query(f"""WITH w AS (SELECT doc_id, {words_sql(norm_sql('text'))} AS w FROM documents)
SELECT doc_id, CAST(CASE WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')))) END AS INTEGER) AS shingles FROM w""")
def shingle_counts(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.size(T.shingles(F.col("text"))).alias("shingles"))


@query(f"SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, md5(array_to_string(list_sort(t), ' ')) AS digest FROM (SELECT doc_id, {tokens_sql('text')} AS t FROM documents)")
def tokenize_counts(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", T.bm25_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("digest"))


@query(f"SELECT doc_id, array_to_string({keywords_sql('text')}, ',') AS keywords FROM documents")
def keywords(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(T.keywords(F.col("text")), ",").alias("keywords"))


def _phrases_sql(listed) -> str:
    known = ", ".join(f"'{p}'" for p in listed)
    return f"SELECT doc_id, array_to_string(list_concat(list_filter([{known}], lambda p: contains(lower(text), p)), list_transform(regexp_extract_all(text, '(?m)^([A-Za-z][^:]{{5,50}}):$', 1), lambda t: trim(lower(t)))), ',') AS phrases FROM documents"


def _phrases(spark, d, listed):
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(T.phrases(F.col("text"), listed), ",").alias("phrases"))


@query(_phrases_sql(P.PHRASES))
def phrases(spark, d):
    return _phrases(spark, d, P.PHRASES)


@query(_phrases_sql(P.PHRASES_OPTIMISED))
def phrases_optimised(spark, d):
    return _phrases(spark, d, P.PHRASES_OPTIMISED)


@query(_phrases_sql(P.PHRASES_BY_SECTION))
def phrases_by_section(spark, d):
    return _phrases(spark, d, P.PHRASES_BY_SECTION)


_LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents)"


@query(rf"WITH {_LINES} SELECT kind, count(*) AS lines FROM (SELECT coalesce({_case(f'''regexp_replace(line, '^{WS}+|{WS}+$', '', 'g')''', P.SECTIONS)}, 'none') AS kind FROM lines) GROUP BY kind")
def section_headers(spark, d):
    return document_lines(spark, d).groupBy(F.coalesce(T.section_type(F.col("text")), F.lit("none")).alias("kind")).agg(F.count("*").alias("lines"))


_CONT = ", ".join(f"'{w}'" for w in P.CONTINUATION)


@query(rf"""WITH asked AS (SELECT conv_id, turn, text, {words_sql('lower(text)')} AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn, array_to_string(regexp_extract_all(text, '"([^"]+)"', 1), ',') AS quoted,
  array_to_string(regexp_extract_all({plain_sql('text')}, '\b[A-Za-z]{{2,10}}\d{{2,10}}\b|\b\d{{2,10}}[A-Za-z]{{2,10}}\b'), ',') AS ids,
  (len(w) < 4 AND ({' OR '.join(f"contains(lower(text), '{p}')" for p in P.PRONOUNS)})) OR len(list_filter(w[1:5], lambda x: x IN ({_CONT}))) > 0 AS continues,
  {' OR '.join(f"contains(lower(text), '{p}')" for p in P.CONTINUATION_PARTS)} AS continues_v2,
  coalesce({', '.join("nullif(regexp_extract(lower(text), '" + p.replace("'", "''") + "', 1), '')" for p in P.SECTION_REQUESTS)}) AS section_request
FROM asked""")
def query_features(spark, d):
    text = F.col("text")
    asked = table(spark, d, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", F.array_join(T.quoted_terms(text), ",").alias("quoted"), F.array_join(T.technical_ids(text), ",").alias("ids"), T.continues(text).alias("continues"), T.continues_v2(text).alias("continues_v2"), T.section_request(text).alias("section_request"))


def _runs_sql(n: int) -> str:
    stop = ", ".join(f"'{w}'" for w in P.QUERY_STOP)
    return f"list_transform(list_filter(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i+{n - 1}]), lambda r: len(list_filter(r, lambda x: x NOT IN ({stop}))) > 0), lambda r: array_to_string(r, ' '))"


@query(f"""WITH asked AS (SELECT conv_id, turn, text, {words_sql('lower(text)')} AS w FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(array_to_string(list_concat({_runs_sql(4)}, {_runs_sql(3)}, {_runs_sql(2)}, CASE WHEN len(w) BETWEEN 3 AND 10 THEN [lower(text)] ELSE [] END), '|')) AS phrases FROM asked""")
def query_phrases(spark, d):
    return table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.md5(F.array_join(T.query_phrases(F.col("text")), "|")).alias("phrases"))


_EXPAND = ", ".join(f"CASE WHEN contains(l, '{k}') AND NOT contains(l, '{s}') THEN replace(l, '{k}', '{s}') END" for k, options in P.SYNONYMS for s in options)


@query(f"""WITH asked AS (SELECT item_id, lower('gap length of the cell ' || text) AS l FROM benchmark)
SELECT item_id, md5(array_to_string((list_concat([l], list_filter([{_EXPAND}], lambda x: x IS NOT NULL)))[1:5], '|')) AS variants FROM asked""")
def synonym_expansion(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.md5(F.array_join(T.expansions(F.concat(F.lit("gap length of the cell "), "text")), "|")).alias("variants"))


def _of_kind(kind: str):
    return F.size(F.filter("k", lambda x: x == kind)).alias(f"n_{kind}")


@query("WITH t AS (SELECT doc_id, " + plain_sql("text") + " AS p FROM documents) SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(upper(p), '{p}')) AS INTEGER) AS n_{kind}" for p, kind in P.QUERY_IDS) + r", CAST(len(regexp_extract_all(p, '\b[A-Z][A-Za-z]{3,}\b')) AS INTEGER) AS n_term FROM t")
def query_ids(spark, d):
    found = spread(table(spark, d, "documents")).select("doc_id", T.bind(T.query_ids(F.col("text")), lambda x: F.transform(x, lambda y: y["type"])).alias("k"))
    return found.select("doc_id", *[_of_kind(kind) for kind in [k for _, k in P.QUERY_IDS] + ["term"]])


_HEAD = plain_sql("lower(text[1:5000])")


@query(rf"""WITH t AS (SELECT doc_id, {_HEAD} AS h FROM documents)
SELECT doc_id, {_case('h', P.VENDORS)} AS vendor, {_case('h', P.DOC_TYPES)} AS doc_type,
  array_to_string(list_filter([{', '.join(f"CASE WHEN regexp_matches(h, '{T.either(p)}') THEN '{t}' END" for t, p in P.TOPICS)}], lambda x: x IS NOT NULL), ',') AS topics,
  CASE WHEN regexp_extract(upper(h), '(TS|TR)\s*(\d{{2}}\.\d{{3}})', 2) <> '' THEN regexp_extract(upper(h), '(TS|TR)\s*(\d{{2}}\.\d{{3}})', 1) || ' ' || regexp_extract(upper(h), '(TS|TR)\s*(\d{{2}}\.\d{{3}})', 2) END AS spec
FROM t""")
def metadata_extract(spark, d):
    head = T.plain(F.lower(F.substring("text", 1, M.HEAD)))
    read = spread(table(spark, d, "documents")).select("doc_id", T.bind(head, lambda h: F.struct(M.vendor(h).alias("vendor"), M.doc_type(h).alias("doc_type"), F.array_join(M.topics(h), ",").alias("topics"), M.spec_number(h).alias("spec"))).alias("m"))
    return read.select("doc_id", "m.*")


def _score_sql(c: str) -> str:
    parts = []
    for p, worth in P.VERSION_SCORES:
        each = " + ".join(f"ascii(upper(regexp_extract(m, '{p}', {g}))) " if w is None else f"coalesce(TRY_CAST(regexp_extract(m, '{p}', {g}) AS BIGINT), 0) * {w}" for g, w in enumerate(worth, 1))
        parts.append(f"coalesce(list_max(list_transform(regexp_extract_all({c}, '{p}'), lambda m: {each})), 0)")
    return f"CAST(greatest({', '.join(parts)}) AS BIGINT)"


def _family_sql(stem: str) -> str:
    out = f"lower({stem})"
    for p, _ in P.VERSION_SCORES:
        out = f"regexp_replace({out}, '{p}', '', 'g')"
    return rf"regexp_replace(regexp_replace({out}, '[-_\s]+', '_', 'g'), '^_+|_+$', '', 'g')"


_STEM = r"CASE WHEN regexp_matches(regexp_extract(url, '([^/]*)$', 1), '^.+\.[^.]*$') THEN regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^(.+)\.[^.]*$', 1) ELSE regexp_extract(url, '([^/]*)$', 1) END"


@query(f"SELECT page_id, {_score_sql('lower(url)')} AS version_score, {_family_sql(_STEM)} AS family FROM pages")
def version_scores(spark, d):
    return table(spark, d, "pages").select("page_id", M.version_score(F.col("url")).alias("version_score"), M.family(F.col("url")).alias("family"))


@query(f"""WITH s AS (SELECT page_id, {_score_sql('lower(url)')} AS version_score, {_family_sql(_STEM)} AS family FROM pages)
SELECT family, version_score, page_id FROM s QUALIFY row_number() OVER (PARTITION BY family ORDER BY version_score DESC, page_id) = 1""")
def newest_version(spark, d):
    paths = table(spark, d, "pages").select(F.col("page_id").alias("seq"), F.col("url").alias("path"))
    return C.newest_versions(paths).select("family", "version_score", F.col("seq").alias("page_id"))


def _noise_sql(c: str) -> str:
    low = rf"regexp_replace(lower({c}), '^{WS}+|{WS}+$', '', 'g')"
    found = " ".join(f"WHEN regexp_matches({low}, '(?m){p}') THEN 'pattern:{p[:30]}'" for p in P.NOISE)
    toc = rf"len(list_filter(string_split({low}, chr(10)), lambda l: regexp_matches(l, '^.*\.{{3,}}\s*\d+\s*$'))) > len(string_split({low}, chr(10))) * 0.5"
    return rf"CASE WHEN length({low}) < 200 THEN 'too_short' WHEN len({words_sql(low)}) < 30 THEN 'few_words' {found} WHEN len(regexp_extract_all({low}, '[.\d]')) / length({low}) > 0.3 AND {toc} THEN 'toc_format' END"


@query(f"SELECT doc_id, {_noise_sql('text')} AS reason FROM documents")
def noise_pages(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", C.noise_reason(F.col("text")).alias("reason"))


@query(f"WITH {_LINES} SELECT reason, count(*) AS pages FROM (SELECT coalesce({_noise_sql('line')}, 'kept') AS reason FROM lines) GROUP BY reason")
def noise_reasons(spark, d):
    return C.noise_counts(document_lines(spark, d))


@query(f"""WITH {_LINES} SELECT doc_id AS path, page AS orig_page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS page_id FROM lines WHERE ({_noise_sql('line')}) IS NULL""")
def clean_pages(spark, d):
    return C.drop_noise(document_lines(spark, d)).select("path", F.col("orig_page").cast("long").alias("orig_page"), F.col("page_id").cast("long").alias("page_id"))


@query(f"""SELECT doc_id, length(text) AS char_count, CAST(len({words_sql('text')}) AS BIGINT) AS word_count, length(text) // 4 AS tokens,
  length(CASE WHEN length(text) <= 400 THEN text ELSE text[1:400] || '...' END) AS truncated, md5(text[1:200]) AS snippet FROM documents""")
def text_counts(spark, d):
    text = F.col("text")
    return spread(table(spark, d, "documents")).select("doc_id", F.length(text).cast("long").alias("char_count"), F.size(T.words(text)).cast("long").alias("word_count"), T.estimate_tokens(text).alias("tokens"), F.length(T.truncate_to_tokens(text, 100)).cast("long").alias("truncated"), F.md5(F.substring(text, 1, 200)).alias("snippet"))


@query(r"""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, '<h[1-6][^>]*>([^<]*)</h[1-6]>', 1)) AS heading FROM pages)
SELECT page_id, heading, CAST(CASE WHEN length(regexp_extract(heading, '^(#[^\s]*)', 1)) > 0 THEN least(length(regexp_extract(heading, '^(#[^\s]*)', 1)), 6)
  WHEN regexp_extract(heading, '^(\d+(?:\.\d+)*)\s', 1) <> '' THEN least(len(regexp_extract_all(regexp_extract(heading, '^(\d+(?:\.\d+)*)\s', 1), '\.')) + 1, 6) ELSE 1 END AS INTEGER) AS level FROM h""")
def heading_levels(spark, d):
    found = table(spark, d, "pages").select("page_id", F.explode(T.all_matches(F.col("html"), r"<h[1-6][^>]*>([^<]*)</h[1-6]>", 1)).alias("heading"))
    return found.select("page_id", "heading", T.heading_level(F.col("heading")).cast("int").alias("level"))


@query(r"""SELECT doc_id, CAST(2 * len(regexp_extract_all(text, '(?i)(?:figure|fig\.?)\s*\d+(?:\.\d+)?')) + len(regexp_extract_all(text, '(?i)(?:image|img\.?)\s*\d+(?:\.\d+)?')) AS INTEGER) AS n FROM documents""")
def figure_references(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.size(T.figure_references(F.col("text"))).alias("n"))


@query(f"""WITH w AS (SELECT doc_id, list_distinct({words_sql('lower(text)')}) AS w, length(text) AS n, CAST(embedding AS DOUBLE[]) AS e FROM documents JOIN embeddings ON vec_id = doc_id),
pairs AS (SELECT a.doc_id, a.n AS n, b.n AS m, list_dot_product(a.e, b.e) AS dot, CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0.0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END AS jaccard,
  1 - bit_count(xor(a.doc_id, b.doc_id)) / 64.0 AS bits FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, round(jaccard, 6) AS jaccard, round(dot, 6) AS dot, round(0.5 * jaccard + 0.3 * bits + 0.2 * (least(n, m) / greatest(n, m, 1)), 6) AS combined FROM pairs""")
def measure_checks(spark, d):
    """Measures of each document and the next one; their ids stand for SimHashes."""
    docs = spread(table(spark, d, "documents")).select("doc_id", F.array_distinct(T.words(F.lower("text"))).alias("w"), F.length("text").alias("n"))
    one = docs.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    other = one.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"), F.col("n").alias("m"), F.col("embedding").alias("e"))
    jaccard = X.jaccard(F.col("w"), F.col("v"))
    told = X.combined(jaccard, X.hamming_similarity(F.col("doc_id"), F.col("doc_id") + 1), F.col("n"), F.col("m"))
    return one.join(other, "doc_id").select("doc_id", F.round(jaccard, 6).alias("jaccard"), F.round(X.dot(F.col("embedding"), F.col("e")), 6).alias("dot"), F.round(told, 6).alias("combined"))


_UPPER = f"upper({plain_sql('text')})"


@query("SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"list_transform(regexp_extract_all({_UPPER}, '(?i){p}'), lambda k: upper(k))" for p in P.SECTION_KEYWORDS) + """, list_transform(list_filter(regexp_extract_all(text, '"([^"]+)"', 1), lambda q: length(q) > 2), lambda q: upper(q))))), ',')) AS keywords FROM documents""")
def keywords_by_section(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.md5(F.array_join(T.keywords_by_section(F.col("text")), ",")).alias("keywords"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(" + ", ".join(f"regexp_extract_all({_UPPER}, '{p}')" for p, _ in P.QUERY_IDS) + rf", list_transform(regexp_extract_all({plain_sql('text')}, '\b[A-Z][A-Za-z]{{3,}}\b')[1:10], lambda k: upper(k))))), ',') AS keywords FROM documents")
def keywords_first(spark, d):
    return spread(table(spark, d, "documents")).select("doc_id", F.array_join(T.keywords_first(F.col("text")), ",").alias("keywords"))


_SECTION_TOKENS = "list_concat(" + words_sql(r"regexp_replace(lower(text), '[^\p{L}\p{N}_\x09-\x0D\x20.-]', ' ', 'g')") + ", " + ", ".join(f"regexp_extract_all({plain_sql('lower(text)')}, '{p}')" for p in P.SECTION_TOKENS) + ")"


@query(f"SELECT doc_id, md5(array_to_string(list_sort(list_filter({_SECTION_TOKENS}, lambda t: length(t) >= 2)), ' ')) AS every, md5(array_to_string(list_sort(list_distinct(list_filter({_SECTION_TOKENS}, lambda t: length(t) >= 2))), ' ')) AS tokens FROM documents")
def tokenize_by_section(spark, d):
    text = F.col("text")
    told = lambda tokens: F.md5(F.array_join(F.array_sort(tokens), " "))
    return spread(table(spark, d, "documents")).select("doc_id", told(T.bm25_tokens_by_section(text, False)).alias("every"), told(T.bm25_tokens_by_section(text)).alias("tokens"))
