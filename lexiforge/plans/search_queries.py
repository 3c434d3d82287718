"""Queries of indexing, scoring and retrieval over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import clean as C
from lexiforge.operators import context as K
from lexiforge.operators import index as I
from lexiforge.operators import retrieve as R
from lexiforge.operators import score as S
from lexiforge.plans.registry import BM25_SQL, QUESTIONS_SQL, WS, chunks, document_lines, keywords_sql, norm_sql, plain_sql, query, questions, table, tokens_sql, words_sql
from lexiforge.session import sent

#: Vectors stand for documents by vec_id = doc_id (a convention of these queries); a question's vector is that of one row.
QUESTION_VECTORS = ((1, 0), (2, 1), (3, 2), (4, 3))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), "embedding")


def _question_vectors(spark, d):
    named = spark.createDataFrame(QUESTION_VECTORS, "query_id int, idx long")
    return _vectors(spark, d).join(sent(named), "idx").select("query_id", F.col("embedding").alias("vector"))


_TOP = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) <= {k}"
_COSINE = "qv(query_id, v) AS (SELECT k.query_id, CAST(e.embedding AS DOUBLE[]) FROM (VALUES (1, 0), (2, 1), (3, 2), (4, 3)) AS k(query_id, vec_id) JOIN embeddings e USING (vec_id)),\ncosine AS (SELECT query_id, vec_id AS idx, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 5) AS score FROM embeddings, qv)"


@query(f"""WITH dfs AS (SELECT term, count(*) AS df FROM (SELECT unnest({tokens_sql('text')}) AS term FROM documents) GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS r FROM dfs)
SELECT term, df, round(CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END, 6) AS idf FROM raw""")
def bm25_stats(spark, d):
    every = chunks(spark, d)
    return I.bm25_idf(I.term_rows(every), every.select("idx").count()).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {BM25_SQL} SELECT query_id, idx, score FROM bm25 {_TOP.format(k=40)}")
def bm25_topk(spark, d):
    return S.top(S.bm25(chunks(spark, d), questions(spark)), 40).select("query_id", "idx", "score")


@query(f"WITH {_COSINE} SELECT query_id, idx, score FROM cosine {_TOP.format(k=20)}")
def cosine_topk_batch(spark, d):
    return S.top(S.cosine(_vectors(spark, d), _question_vectors(spark, d)), 20).select("query_id", "idx", "score")


@query(f"WITH {_COSINE} SELECT query_id, idx, score FROM cosine JOIN (SELECT vec_id AS idx, label FROM embeddings) USING (idx) WHERE label = 1 {_TOP.format(k=20)}")
def cosine_topk_filtered(spark, d):
    """The predicate acts before the cut, as in a vector store."""
    only = table(spark, d, "embeddings").where("label = 1").select(F.col("vec_id").alias("idx"), "embedding")
    return S.top(S.cosine(only, _question_vectors(spark, d)), 20).select("query_id", "idx", "score")


def _phrases_list() -> str:
    from lexiforge.functions.patterns import PHRASES

    known = ", ".join(f"'{p}'" for p in PHRASES)
    return f"SELECT doc_id, list_concat(list_filter([{known}], lambda p: contains(lower(text), p)), list_transform(regexp_extract_all(text, '(?m)^([A-Za-z][^:]{{5,50}}):$', 1), lambda t: trim(lower(t)))) AS phrases FROM documents"


_INDEX = f"""kw AS (SELECT doc_id AS idx, {keywords_sql('text')} AS k FROM documents),
postings AS (
  SELECT DISTINCT 'keyword' AS index_name, unnest(k) AS term, idx FROM kw
  UNION ALL SELECT DISTINCT 'keyword_lower', lower(unnest(k)), idx FROM kw)"""


@query(f"""WITH {_INDEX}, titled AS (SELECT doc_id, unnest(list_distinct(phrases)) AS term FROM ({_phrases_list()})),
every AS (SELECT * FROM postings UNION ALL SELECT 'phrase', term, doc_id FROM titled UNION ALL SELECT 'section', source, doc_id FROM documents WHERE source IS NOT NULL UNION ALL SELECT 'vendor', lang, doc_id FROM documents WHERE lang IS NOT NULL)
SELECT index_name, term, count(*) AS n, min(idx) AS first FROM every GROUP BY ALL""")
def inverted_index(spark, d):
    return I.inverted_index(chunks(spark, d)).groupBy("index_name", "term").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


_TERMS = rf"""terms AS (SELECT query_id, unnest(list_concat({keywords_sql('q')}, regexp_extract_all(q, '"([^"]+)"', 1), regexp_extract_all({plain_sql('q')}, '\b[A-Za-z]{{2,10}}\d{{2,10}}\b|\b\d{{2,10}}[A-Za-z]{{2,10}}\b'))) AS term FROM questions),
firsts AS (SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY index_name, term ORDER BY idx) <= 30),
kwhits AS (SELECT t.query_id, f.idx, sum(CASE f.index_name WHEN 'keyword' THEN 1.0 ELSE 0.5 END) AS raw
  FROM terms t JOIN firsts f ON (f.index_name = 'keyword' AND f.term = upper(t.term)) OR (f.index_name = 'keyword_lower' AND f.term = lower(t.term)) GROUP BY t.query_id, f.idx),
keyed AS (SELECT query_id, idx, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM kwhits)"""


@query(f"WITH {QUESTIONS_SQL}, {_INDEX}, {_TERMS} SELECT query_id, idx, round(score, 6) AS score FROM keyed")
def keyword_search(spark, d):
    found = S.keyword_scores(I.inverted_index(chunks(spark, d)), R.feature_terms(questions(spark)))
    return found.select("query_id", "idx", F.round("score", 6).alias("score"))


_EXACT = rf"""quoted AS (SELECT query_id, lower(unnest(regexp_extract_all(q, '"([^"]+)"', 1))) AS term FROM questions),
exacts AS (SELECT query_id, doc_id AS idx, sum((length(l) - length(replace(l, term, ''))) / length(term) * 3.0
   + CASE WHEN regexp_matches(l, '(?:^|[^\p{{L}}\p{{N}}_])' || regexp_replace(term, '([.])', '\\\1', 'g') || '(?:$|[^\p{{L}}\p{{N}}_])') THEN 3.0 ELSE 0 END) AS raw
  FROM (SELECT doc_id, lower(text) AS l FROM documents) JOIN quoted ON contains(l, term) GROUP BY query_id, doc_id),
exact AS (SELECT query_id, idx, raw / max(raw) OVER (PARTITION BY query_id) AS score FROM exacts)"""


@query(f"WITH {QUESTIONS_SQL}, {_EXACT} SELECT query_id, idx, round(score, 6) AS score FROM exact")
def exact_search(spark, d):
    terms = questions(spark).select("query_id", F.explode(T.quoted_terms(F.col("text"))).alias("term"))
    return S.exact_scores(chunks(spark, d), terms).select("query_id", "idx", F.round("score", 6).alias("score"))


def _stop() -> str:
    from lexiforge.functions.patterns import TEXT_STOP

    return ", ".join(f"'{w}'" for w in TEXT_STOP)


def _grams(n: int) -> str:
    return f"SELECT idx, {n} AS n, unnest(range(1, len(w) - {n - 2})) AS i, unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: w[i:i+{n - 1}])) AS r FROM ws WHERE len(w) >= {n}"


@query(f"""WITH ws AS (SELECT doc_id AS idx, {words_sql('lower(text)')} AS w FROM documents),
grams AS (SELECT idx, n, i, array_to_string(r, ' ') AS term FROM ({_grams(2)} UNION ALL {_grams(3)} UNION ALL {_grams(4)}) WHERE length(array_to_string(r, ' ')) > 10 AND len(list_filter(r, lambda x: x NOT IN ({_stop()}))) > 0),
kept AS (SELECT term, idx FROM grams QUALIFY row_number() OVER (PARTITION BY term ORDER BY idx, n, i) <= 100),
counted AS (SELECT term, count(*) AS postings, max(idx) AS last FROM kept GROUP BY term)
SELECT term, postings, last FROM counted WHERE postings > 1
UNION ALL SELECT 'one posting: ' || sum(length(term)), count(*), CAST(sum(last) AS BIGINT) FROM counted WHERE postings = 1""")
def phrase_index(spark, d):
    kept = I.phrase_ngrams(chunks(spark, d))
    counted = kept.groupBy("term").agg(F.count("*").alias("postings"), F.max("idx").alias("last"))
    total = counted.where("postings = 1").agg(F.concat(F.lit("one posting: "), F.sum(F.length("term"))).alias("term"), F.count("*").alias("postings"), F.sum("last").alias("last"))
    return counted.where("postings > 1").unionByName(total)


_FUSED = f"""{BM25_SQL}, {_COSINE}, {_INDEX}, {_TERMS}, {_EXACT},
cut_b AS (SELECT * FROM bm25 {_TOP.format(k=40)}), cut_s AS (SELECT * FROM cosine {_TOP.format(k=40)}),
nb AS (SELECT query_id, idx, score / max(score) OVER (PARTITION BY query_id) AS b FROM cut_b),
ns AS (SELECT query_id, idx, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS s FROM cut_s),
wide AS (SELECT query_id, idx, max(s) AS s, max(b) AS b, max(k) AS k, max(e) AS e FROM (
  SELECT query_id, idx, s, NULL AS b, NULL AS k, NULL AS e FROM ns UNION ALL SELECT query_id, idx, NULL, b, NULL, NULL FROM nb
  UNION ALL SELECT query_id, idx, NULL, NULL, score, NULL FROM keyed UNION ALL SELECT query_id, idx, NULL, NULL, NULL, score FROM exact) GROUP BY query_id, idx),
fused AS (SELECT query_id, idx, concat_ws('+', CASE WHEN s IS NOT NULL THEN 'semantic' END,
    CASE WHEN b IS NOT NULL THEN 'bm25' END, CASE WHEN k IS NOT NULL THEN CASE WHEN s IS NULL AND b IS NULL THEN 'keyword' ELSE 'kw' END END, CASE WHEN e IS NOT NULL THEN 'exact' END) AS type,
  round(0.4 * coalesce(s, 0) + 0.3 * coalesce(b, 0) + 0.3 * greatest(coalesce(k, 0), coalesce(e, 0)), 6) AS hybrid FROM wide)"""


def _fused(spark, d, allowed=None, mode="post"):
    return R.hybrid(chunks(spark, d), questions(spark), _vectors(spark, d), _question_vectors(spark, d), allowed=allowed, filter_mode=mode)


def _present(spark, d):
    """Candidates that are documents: some vectors stand for none."""
    return _fused(spark, d).join(chunks(spark, d).select("idx"), "idx", "left_semi")


@query(f"WITH {_FUSED} SELECT query_id, idx, type, hybrid FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, idx) <= 40")
def hybrid_topk(spark, d):
    return S.top(_fused(spark, d), 40, "hybrid").select("query_id", "idx", "type", "hybrid")


@query(f"WITH {_FUSED} SELECT query_id, idx, type, hybrid FROM fused WHERE idx IN (SELECT doc_id FROM documents WHERE lang = 'en') QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, idx) <= 40")
def hybrid_filtered_post(spark, d):
    return S.top(_fused(spark, d, chunks(spark, d).where("vendor = 'en'").select("idx")), 40, "hybrid").select("query_id", "idx", "type", "hybrid")


_ENGLISH = "WITH documents AS (SELECT * FROM main.documents WHERE lang = 'en'), embeddings_all AS (SELECT * FROM main.embeddings), "


@query(f"WITH {_FUSED.replace('FROM documents', 'FROM (SELECT * FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')').replace('FROM embeddings, qv', 'FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = ' + chr(39) + 'en' + chr(39) + ')), qv')} SELECT query_id, idx, type, hybrid FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, idx) <= 40")
def hybrid_filtered_pre(spark, d):
    return S.top(_fused(spark, d, chunks(spark, d).where("vendor = 'en'").select("idx"), "pre"), 40, "hybrid").select("query_id", "idx", "type", "hybrid")


_PRIMARY = f"prim AS (SELECT doc_id AS idx, min(doc_id) OVER (PARTITION BY md5({norm_sql('text')})) AS first, text, lang FROM documents)"


@query(f"""WITH {_FUSED}, {_PRIMARY},
one AS (SELECT f.*, p.first, p.text FROM fused f JOIN prim p USING (idx) QUALIFY row_number() OVER (PARTITION BY query_id, regexp_replace(lower(text[1:300]), '{WS}+', ' ', 'g') ORDER BY hybrid DESC, idx) = 1),
two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id, first ORDER BY hybrid DESC, idx) = 1)
SELECT query_id, idx, hybrid FROM two QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, idx) <= 12""")
def result_dedup(spark, d):
    primary = chunks(spark, d).withColumn("primary", F.min("idx").over(Window.partitionBy(T.md5_key(F.col("text"))))).select("idx", "text", "primary")
    return S.deduplicate(_fused(spark, d).join(primary, "idx"), 12).select("query_id", "idx", "hybrid")


@query(f"""WITH {_FUSED}, kept AS (SELECT f.*, lang FROM fused f JOIN documents ON doc_id = idx QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, idx) <= 12),
n AS (SELECT query_id, lang, count(*) AS c, max(hybrid) AS h, min(idx) AS i FROM kept GROUP BY ALL),
best AS (SELECT query_id, arg_min(lang, struct_pack(a := -c, b := -h, c := i)) AS main FROM n GROUP BY query_id)
SELECT query_id, idx, CASE WHEN lang <> main THEN 0.8 ELSE 1.0 END AS penalty, round(hybrid * CASE WHEN lang <> main THEN 0.8 ELSE 1.0 END, 6) AS penalised FROM kept JOIN best USING (query_id)""")
def vendor_penalty(spark, d):
    kept = S.top(_present(spark, d), 12, "hybrid").join(chunks(spark, d).select("idx", "vendor"), "idx")
    return S.vendor_penalty(kept).select("query_id", "idx", "penalty", "penalised")


@query(f"""WITH {_FUSED}, kept AS (SELECT f.*, text, q FROM fused f JOIN documents ON doc_id = idx JOIN questions USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, idx) <= 40)
SELECT query_id, idx, round(0.3 * hybrid + 0.7 * (len(list_intersect({tokens_sql('q')}, {tokens_sql('text[1:1500]')})) / len({tokens_sql("q")})), 8) AS final FROM kept""")
def rerank_lexical(spark, d):
    kept = S.top(_present(spark, d), 40, "hybrid").join(chunks(spark, d).select("idx", "text"), "idx").join(sent(questions(spark).withColumnRenamed("text", "q")), "query_id")
    return S.rerank(kept, S.lexical_overlap(F.col("text"), F.col("q"))).select("query_id", "idx", "final")


_KEPT12 = f"""{_FUSED}, kept AS (SELECT query_id, idx, hybrid AS score, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, idx) AS rank, text, source, lang FROM fused JOIN documents ON doc_id = idx QUALIFY rank <= 12)"""


def _kept12(spark, d):
    return S.top(_present(spark, d).withColumnRenamed("hybrid", "score"), 12)


@query(f"""WITH {_KEPT12}, pieces AS (SELECT *, '[Document ' || rank || '] ' || source || ' | Page: N/A | Vendor: ' || lang || ' | Section: ' || source || ' | Score: ' || printf('%.3f', score) || chr(10) || text[1:2000] AS piece FROM kept),
run AS (SELECT *, sum(length(piece)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM pieces)
SELECT query_id, CAST(count(*) AS BIGINT) AS pieces, md5(string_agg(piece, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM run WHERE used <= 24000 GROUP BY query_id""")
def context_budget(spark, d):
    told = _kept12(spark, d).join(chunks(spark, d), "idx").withColumn("pages", F.array().cast("array<int>"))
    kept = K.within_budget(K.pieces(told))
    return K.context(kept).join(kept.groupBy("query_id").agg(F.count("*").alias("pieces")), "query_id").select("query_id", "pieces", F.md5("context").alias("context"))


@query(f"""WITH {_KEPT12} SELECT query_id, md5(string_agg('[Document ' || rank || '] Source: ' || source || ' | Page: N/A | Section: ' || source || ' | Score: ' || printf('%.3f', score) || chr(10) || text[1:2000], chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) FILTER (rank <= 5)) AS by_source,
  md5(string_agg('[' || source || ' | page ' || idx || ' | score=' || printf('%.3f', score) || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS first FROM kept GROUP BY query_id""")
def context_formats(spark, d):
    """The contexts of the other generations; a document's id stands for its page."""
    told = _kept12(spark, d).join(chunks(spark, d), "idx").withColumn("pages", F.array().cast("array<int>")).withColumn("page", F.col("idx"))
    first = K.context(K.pieces_first(told)).select("query_id", F.md5("context").alias("first"))
    return K.context(K.pieces_by_source(told)).select("query_id", F.md5("context").alias("by_source")).join(first, "query_id")


@query(f"""WITH {_KEPT12}, kept3 AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 3)
SELECT query_id, source AS section, md5(('Section: ' || source || chr(10) || string_agg('[' || source || ']' || chr(10) || text[1:1000] || chr(10), '' ORDER BY rank))[1:500]) AS text FROM kept3 GROUP BY query_id, source""")
def compressed_sections(spark, d):
    return K.compressed_sections(_kept12(spark, d).join(chunks(spark, d), "idx")).select("query_id", "section", F.md5("text").alias("text"))


@query(f"""WITH {_KEPT12} SELECT query_id, CAST(count(DISTINCT lang) AS BIGINT) AS vendors, CASE WHEN count(DISTINCT lang) > 1 THEN 'multi_vendor' ELSE 'base' END AS prompt FROM kept GROUP BY query_id""")
def prompt_choice(spark, d):
    found = _kept12(spark, d).join(chunks(spark, d), "idx").groupBy("query_id").agg(F.countDistinct("vendor").alias("vendors"))
    return found.select("query_id", "vendors", K.prompt_kind(F.lit(None).cast("string"), F.col("vendors")).alias("prompt"))


def _line_chunks(spark, d):
    order = Window.partitionBy("path").orderBy("page_id")
    lines = document_lines(spark, d)
    return lines.select((F.col("path") * 100_000 + F.col("page_id")).alias("idx"), F.col("path").alias("source"), F.col("page_id").alias("page_start"), F.col("page_id").alias("page_end"), F.array("page_id").alias("pages"))


_LINE_CHUNKS = "lines AS (SELECT doc_id AS source, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents), parts AS (SELECT source * 100000 + page AS idx, source, page FROM lines)"


@query(f"WITH {_LINE_CHUNKS} SELECT a.idx, CAST(o.ord AS INTEGER) AS ord, b.idx AS neighbour FROM parts a, (VALUES (0, 1), (1, -1)) AS o(ord, step) JOIN parts b ON b.source = a.source AND b.page = a.page + o.step")
def adjacency(spark, d):
    return I.adjacency(_line_chunks(spark, d))


@query(f"WITH {_LINE_CHUNKS} SELECT a.idx, b.idx AS neighbour FROM parts a JOIN parts b ON b.source = a.source AND (b.page = a.page + 1 OR b.page = a.page - 1)")
def adjacency_all(spark, d):
    return I.adjacency_all(_line_chunks(spark, d))


@query(f"""WITH {_KEPT12}, firstof AS (SELECT doc_id AS idx, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 3),
near AS (SELECT DISTINCT query_id, n.doc_id AS idx FROM kept k JOIN (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) me ON me.doc_id = k.idx
  JOIN (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents) n ON n.source = me.source AND abs(n.p - me.p) = 1
  WHERE NOT EXISTS (SELECT 1 FROM kept x WHERE x.query_id = k.query_id AND x.idx = n.doc_id)),
sect AS (SELECT DISTINCT k.query_id, f.idx FROM kept k JOIN firstof f ON f.source = k.source WHERE k.rank <= 3
  AND NOT EXISTS (SELECT 1 FROM kept x WHERE x.query_id = k.query_id AND x.idx = f.idx) AND NOT EXISTS (SELECT 1 FROM near x WHERE x.query_id = k.query_id AND x.idx = f.idx))
SELECT query_id, idx, score, 'result' AS how FROM kept UNION ALL SELECT query_id, idx, 0.5, 'adjacent' FROM near UNION ALL SELECT query_id, idx, 0.4, 'section' FROM sect""")
def retrieve_with_context(spark, d):
    return R.expand(_kept12(spark, d), chunks(spark, d), _neighbours(spark, d))


@query(f"""WITH {QUESTIONS_SQL.replace('questions(', 'asked_(')}, top AS (SELECT doc_id AS idx, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, source FROM documents)
SELECT source AS section, idx FROM top WHERE rn <= 5""")
def section_expand(spark, d):
    first = chunks(spark, d).withColumn("rn", F.row_number().over(Window.partitionBy("section").orderBy("idx"))).where("rn <= 5")
    return first.select("section", "idx")


def _phrases_sql() -> str:
    from lexiforge.plans.text_queries import _runs_sql

    return f"list_concat({_runs_sql(4)}, {_runs_sql(3)}, {_runs_sql(2)}, CASE WHEN len(w) BETWEEN 3 AND 10 THEN [lower(q)] ELSE [] END)"


def _cascade_sql() -> str:
    from lexiforge.functions.patterns import QUERY_IDS
    from lexiforge.plans.text_queries import _EXPAND

    ids = lambda c: "list_concat(" + ", ".join(f"regexp_extract_all(upper({plain_sql(c)}), '{p}')" for p, _ in QUERY_IDS) + ")"
    terms = rf"list_transform(regexp_extract_all({plain_sql('q')}, '\b[A-Z][A-Za-z]{{3,}}\b'), lambda t: upper(t))"
    return rf"""WITH {QUESTIONS_SQL}, asked AS (SELECT query_id, q, {words_sql('lower(q)')} AS w, lower(q) AS l FROM questions),
known AS (SELECT query_id, q, l, {_phrases_sql()} AS ps, list_transform(regexp_extract_all(q, '"([^"]+)"', 1), lambda t: lower(t)) AS quoted, list_concat({ids('q')}, {terms}) AS ids,
  (list_concat([l], list_filter([{_EXPAND}], lambda x: x IS NOT NULL)))[2:5] AS variants, list_filter({words_sql('upper(q)')}, lambda x: length(x) > 3) AS big FROM asked),
texts AS (SELECT doc_id AS idx, lower(text) AS low, upper(text) AS up, ' ' || array_to_string({words_sql('lower(text)')}, ' ') || ' ' AS spaced, {ids('text')} AS own FROM documents),
hits AS (SELECT query_id, idx, CASE
   WHEN len(list_filter(quoted, lambda t: contains(low, t))) > 0 THEN [5.0, 0]
   WHEN len(list_filter(ps, lambda p: length(p) > 10 AND contains(spaced, ' ' || p || ' '))) > 0 THEN [3.0, 1]
   WHEN len(list_filter(ps, lambda p: contains(low, p))) > 0 THEN [2.5, 2] END AS high,
   list_has_any(ids, own) AS same, len(list_filter(variants, lambda v: contains(low, v))) > 0 AS alike, len(list_filter(big, lambda b: contains(up, b))) AS n FROM texts, known),
scored AS (SELECT query_id, idx, CASE WHEN high IS NOT NULL AND high[1] >= 0.5 + 0.2 * n THEN high[1] WHEN n > 0 AND 0.5 + 0.2 * n > CASE WHEN same THEN 2.0 WHEN alike THEN 1.5 ELSE 0 END THEN round(0.5 + 0.2 * n, 6)
   WHEN same THEN 2.0 WHEN alike THEN 1.5 END AS score FROM hits)
SELECT query_id, idx, score FROM scored WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, idx) <= 15"""


@query(_cascade_sql())
def cascade_topk(spark, d):
    return R.cascade(chunks(spark, d), questions(spark)).select("query_id", "idx", "score")


def _overlap(cut: str) -> str:
    return f"(len(list_intersect({tokens_sql('q')}, {tokens_sql(cut)})) / len({tokens_sql('q')}))"


def _results_sql(source: str, k: int) -> str:
    """The best of each text head, then of each primary, then the k best, of ``source`` (query_id, idx, first, text, final)."""
    return f"""one AS (SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY query_id, regexp_replace(lower(text[1:300]), '{WS}+', ' ', 'g') ORDER BY final DESC, idx) = 1),
two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id, first ORDER BY final DESC, idx) = 1),
results AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final DESC, idx) AS INTEGER) AS "rank" FROM two QUALIFY "rank" <= {k})"""


def _retrieve_sql(where: str) -> str:
    return f"""WITH {_FUSED}, {_PRIMARY}, owned AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source) AS document FROM documents), docs5 AS (SELECT query_id, idx FROM cosine WHERE idx IN (SELECT document FROM owned) {_TOP.format(k=5)}),
kept AS (SELECT f.query_id, f.idx, f.type, f.hybrid, p.text, p.first, q FROM fused f JOIN prim p USING (idx) JOIN questions USING (query_id) WHERE {where} QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY hybrid DESC, f.idx) <= 40),
scored AS (SELECT *, round(CASE WHEN count(*) OVER (PARTITION BY query_id) > 5 THEN 0.3 * hybrid + 0.7 * {_overlap('text[1:1500]')} ELSE hybrid END, 8) AS final FROM kept),
{_results_sql('scored', 12)}
SELECT query_id, "rank", idx, type, hybrid, final FROM results"""


def _primaries(spark, d):
    return chunks(spark, d).select("idx", F.min("idx").over(Window.partitionBy(T.md5_key(F.col("text")))).alias("primary"))


@query(_retrieve_sql("true"))
def retrieve(spark, d):
    """What a question gets: fused, cut, re-ranked, without duplicates."""
    return R.retrieve(chunks(spark, d), questions(spark), _vectors(spark, d), _question_vectors(spark, d), primary=_primaries(spark, d))


@query(_retrieve_sql("p.lang = 'en' AND EXISTS (SELECT 1 FROM docs5 s JOIN documents d ON d.doc_id = s.idx JOIN owned o ON o.document = s.idx WHERE d.lang = 'en' AND s.query_id = f.query_id AND f.idx = o.doc_id)"))
def retrieve_by_documents(spark, d):
    """Only chunks of the nearest documents and of one vendor; a source stands for a document, its first row for the document's vector."""
    every = chunks(spark, d)
    members = every.select(F.min("idx").over(Window.partitionBy("source")).alias("document"), "idx")
    wholes = _vectors(spark, d).join(members.select(F.col("document").alias("idx")).distinct(), "idx", "left_semi").join(every.select("idx", "vendor"), "idx")
    allowed = R.document_stage(wholes, _question_vectors(spark, d), members, "en")
    return R.retrieve(every, questions(spark), _vectors(spark, d), _question_vectors(spark, d), allowed=allowed, vendor="en", primary=_primaries(spark, d))


def _neighbours(spark, d):
    """Documents of a source stand for the pages of a file, in order of their id."""
    page = F.row_number().over(Window.partitionBy("source").orderBy("idx"))
    paged = chunks(spark, d).select("idx", "source", page.alias("page_start")).select("*", F.col("page_start").alias("page_end"), F.array("page_start").alias("pages"))
    return I.adjacency(paged)


_SMART = rf"""{BM25_SQL.replace("1 - 0.75 + 0.75", "1 - 0.8 + 0.8")}, {_COSINE}, {_INDEX},
asks AS (SELECT query_id, unnest(list_concat(regexp_extract_all(upper({plain_sql('q')}), '\b[A-Z]{{2,}}\b'), regexp_extract_all(q, '"([^"]+)"', 1), regexp_extract_all({plain_sql('q')}, '\b[A-Za-z]{{2,10}}\d{{2,10}}\b|\b\d{{2,10}}[A-Za-z]{{2,10}}\b'))) AS term FROM questions),
firsts AS (SELECT * FROM postings QUALIFY row_number() OVER (PARTITION BY index_name, term ORDER BY idx) <= 20),
kwhits AS (SELECT t.query_id, f.idx, sum(1.0) AS raw FROM asks t JOIN firsts f ON (f.index_name = 'keyword' AND f.term = upper(t.term)) OR (f.index_name = 'keyword_lower' AND f.term = lower(t.term)) GROUP BY t.query_id, f.idx),
keyed AS (SELECT query_id, idx, raw / max(raw) OVER (PARTITION BY query_id) AS k FROM kwhits), {_EXACT},
cut_e AS (SELECT query_id, idx, score AS e FROM exact {_TOP.format(k=15)}),
cut_b AS (SELECT * FROM bm25 {_TOP.format(k=30)}), cut_s AS (SELECT * FROM cosine {_TOP.format(k=12)}),
nb AS (SELECT query_id, idx, score / max(score) OVER (PARTITION BY query_id) AS b FROM cut_b),
ns AS (SELECT query_id, idx, CASE WHEN max(score) OVER (PARTITION BY query_id) > 0 THEN score / max(score) OVER (PARTITION BY query_id) ELSE 0 END AS s FROM cut_s),
nc AS (SELECT query_id, doc_id AS idx, 0.7 AS c FROM questions, documents WHERE doc_id <= 4 AND query_id = 3),
wide AS (SELECT query_id, idx, max(s) AS s, max(b) AS b, max(k) AS k, max(e) AS e, max(c) AS c FROM (
  SELECT query_id, idx, s, NULL AS b, NULL AS k, NULL AS e, NULL AS c FROM ns UNION ALL SELECT query_id, idx, NULL, b, NULL, NULL, NULL FROM nb UNION ALL SELECT query_id, idx, NULL, NULL, k, NULL, NULL FROM keyed
  UNION ALL SELECT query_id, idx, NULL, NULL, NULL, e, NULL FROM cut_e UNION ALL SELECT query_id, idx, NULL, NULL, NULL, NULL, c FROM nc) GROUP BY query_id, idx),
own AS (SELECT query_id, idx, coalesce(s, 0) AS s, coalesce(b, 0) AS b,
  CASE WHEN c IS NOT NULL THEN 'continuation' WHEN s IS NOT NULL THEN 'semantic' || CASE WHEN b IS NOT NULL THEN '+bm25' ELSE '' END WHEN b IS NOT NULL THEN 'bm25' WHEN k IS NOT NULL THEN 'keyword' ELSE 'exact_match' END
    || CASE WHEN e IS NOT NULL AND coalesce(c, s, b, k) IS NOT NULL THEN '+exact' ELSE '' END AS type,
  round(round(0.5 * coalesce(s, 0) + 0.35 * coalesce(b, 0) + 0.15 * greatest(CASE WHEN k IS NOT NULL THEN k WHEN c IS NOT NULL THEN 0.7 ELSE 0 END, coalesce(e, 0)), 6)
    * CASE WHEN c IS NOT NULL THEN 1.5 ELSE 1 END * CASE WHEN k IS NULL THEN 1 WHEN coalesce(c, s, b) IS NOT NULL THEN 1.5 ELSE 1.2 END * CASE WHEN e IS NOT NULL THEN 2 ELSE 1 END, 6) AS final FROM wide),
named AS (SELECT query_id, source FROM (SELECT query_id, vec_id AS idx, round(list_dot_product(CAST(embedding AS DOUBLE[]), v), 5) AS score FROM embeddings, qv WHERE query_id = 2 {_TOP.format(k=1)}) JOIN documents ON doc_id = idx WHERE source IS NOT NULL),
sect AS (SELECT query_id, idx, s, b, type, final FROM own UNION ALL SELECT n.query_id, doc_id, 0, 0, 'section', 0.045 FROM named n JOIN documents d ON d.source = n.source WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = n.query_id AND o.idx = doc_id)),
head AS (SELECT query_id, idx FROM sect QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s + b DESC, idx) <= 8),
paged AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS p FROM documents),
beside AS (SELECT DISTINCT h.query_id, n.doc_id AS idx FROM head h JOIN paged me ON me.doc_id = h.idx JOIN paged n ON n.source = me.source AND abs(n.p - me.p) = 1 WHERE NOT EXISTS (SELECT 1 FROM sect o WHERE o.query_id = h.query_id AND o.idx = n.doc_id)),
every AS (SELECT query_id, idx, type, final FROM sect UNION ALL SELECT query_id, idx, 'adjacent', 0.012 FROM beside),
{_PRIMARY},
placed AS (SELECT f.query_id, f.idx, f.type, f.final AS own_final, p.text, p.first, q, row_number() OVER (PARTITION BY f.query_id ORDER BY f.final DESC, f.idx) AS place, count(*) OVER (PARTITION BY f.query_id) AS n FROM every f JOIN prim p USING (idx) JOIN questions USING (query_id)),
scored AS (SELECT *, round(CASE WHEN n > 5 AND place <= 24 THEN 0.35 * own_final + 0.65 * {_overlap('text')} ELSE own_final END, 8) AS final FROM placed),
{_results_sql('scored', 8)}"""


@query(f'WITH {_SMART} SELECT query_id, "rank", idx, type, final FROM results'.replace("(3, 'mail", "(3, 'more on mail"))
def smart_retrieve(spark, d):
    """The whole of the boosted retrieval. The third question continues one that found documents 0 to 4, the second names a section by its vector."""
    asked = questions(spark).withColumn("text", F.when(F.col("query_id") == 3, F.concat(F.lit("more on "), "text")).otherwise(F.col("text")))
    previous = chunks(spark, d).where("idx <= 4").select(F.lit(3).alias("query_id"), "idx")
    section = _question_vectors(spark, d).where("query_id = 2")
    return R.smart_retrieve(chunks(spark, d), asked, _vectors(spark, d), _question_vectors(spark, d), _neighbours(spark, d), section, previous=previous, primary=_primaries(spark, d))


@query(f"""WITH {_COSINE}, best AS (SELECT query_id, idx FROM cosine {_TOP.format(k=5)})
SELECT b.query_id, d.doc_id AS idx FROM best b JOIN documents d ON d.doc_id // 10 = b.idx WHERE b.idx IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def document_stage(spark, d):
    """Ten consecutive documents stand for the chunks of one; the vendor filter acts after the cut."""
    vectors = _vectors(spark, d).join(chunks(spark, d).select("idx", "vendor"), "idx")
    members = chunks(spark, d).select(F.floor(F.col("idx") / 10).cast("long").alias("document"), "idx")
    return R.document_stage(_vectors(spark, d).join(vectors.select("idx", "vendor"), "idx", "left"), _question_vectors(spark, d), members, "en")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, d):
    """What is left to do: rows whose id is not among those done."""
    from lexiforge.sources.sinks import remaining

    return remaining(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query(f"""SELECT count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT lang) AS vendors, CAST(sum(len({words_sql('text')})) AS BIGINT) AS words, round(avg(len({words_sql('text')})), 6) AS mean_words FROM documents""")
def corpus_statistics(spark, d):
    n = F.size(T.words(F.col("text")))
    return table(spark, d, "documents").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.countDistinct("lang").alias("vendors"), F.sum(n).cast("long").alias("words"), F.round(F.avg(n), 6).alias("mean_words"))


@query("""WITH t AS (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS back, md5(text) AS question, md5(CASE WHEN r = 'assistant' THEN a[1:300] END) AS answer FROM t WHERE role = 'user' QUALIFY back <= 2""")
def history_last2(spark, d):
    return K.last_turns(table(spark, d, "conversations")).select("conv_id", "turn", "back", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


def _continues_sql(c: str) -> str:
    from lexiforge.functions.patterns import CONTINUATION, PRONOUNS

    listed = ", ".join(f"'{w}'" for w in CONTINUATION)
    w = words_sql(f"lower({c})")
    return f"((len({w}) < 4 AND ({' OR '.join(f'contains(lower({c}), {chr(39)}{p}{chr(39)})' for p in PRONOUNS)})) OR len(list_filter(({w})[1:5], lambda x: x IN ({listed}))) > 0)"


@query(f"""WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, md5(CASE WHEN {_continues_sql('text')} AND before IS NOT NULL THEN before || ' ' || text ELSE text END) AS query FROM t""")
def continued_queries(spark, d):
    return K.enhanced_queries(table(spark, d, "conversations"), T.continues).select("conv_id", "turn", F.md5("query").alias("query"))


@query("SELECT doc_id FROM (SELECT doc_id, lang AS vendor, [source, lang] AS topics FROM documents) WHERE vendor = 'en' AND list_has_any(topics, ['src1', 'src2'])")
def metadata_filter(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("vendor"), F.array("source", "lang").alias("topics"))
    return C.filter_metadata(docs, vendor="en", topics=["src1", "src2"]).select("doc_id")
