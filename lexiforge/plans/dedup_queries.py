"""Queries of duplicates over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import measures as X
from lexiforge.functions import text as T
from lexiforge.operators import dedup as D
from lexiforge.plans.registry import WS, chunks, ensure_checkpoint, norm_sql, query, table, words_sql

_SHINGLES = f"""ws AS (SELECT doc_id AS idx, {words_sql(norm_sql('text'))} AS w, text FROM documents),
sh AS MATERIALIZED (SELECT idx, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM ws),
flat AS (SELECT idx, unnest(s) AS t FROM sh)"""


def _docs(spark, d):
    return chunks(spark, d).select("idx", "text")


@query(f"SELECT idx, p AS primary FROM (SELECT doc_id AS idx, min(doc_id) OVER (PARTITION BY md5({norm_sql('text')})) AS p FROM documents) WHERE idx <> p".replace("AS primary", 'AS "primary"'))
def exact_dups(spark, d):
    return D.exact_duplicates(_docs(spark, d))


_FIRST = f"firsts AS (SELECT min(doc_id) AS idx FROM documents GROUP BY md5({norm_sql('text')}))"


@query(f"""WITH {_SHINGLES}, {_FIRST}, f AS (SELECT flat.* FROM flat JOIN firsts USING (idx)), n AS (SELECT idx, count(*) AS n FROM f GROUP BY idx),
common AS (SELECT a.idx AS x, b.idx AS y, count(*) AS c FROM f a JOIN f b ON a.t = b.t AND a.idx < b.idx GROUP BY ALL)
SELECT x, y, round(c / (p.n + q.n - c), 6) AS similarity FROM common JOIN n p ON p.idx = x JOIN n q ON q.idx = y WHERE c / (p.n + q.n - c) >= 0.8""")
def jaccard_pairs(spark, d):
    return D.jaccard_pairs(_docs(spark, d)).select("x", "y", F.round("similarity", 6).alias("similarity"))


_MINHASH = f"""{_SHINGLES}, seeds AS (SELECT unnest(range(0, 100)) AS i),
sig AS (SELECT idx, i, min(md5((i * 31337)::VARCHAR || t)) AS m FROM flat, seeds GROUP BY idx, i), signatures AS (SELECT idx, list(m ORDER BY i) AS signature FROM sig GROUP BY idx)"""


@query(f"WITH {_MINHASH} SELECT idx, md5(array_to_string(signature, ',')) AS signature FROM signatures")
def minhash_signature(spark, d):
    return D.minhash(_docs(spark, d)).select("idx", F.md5(F.array_join("signature", ",")).alias("signature"))


@query(f"""WITH {_MINHASH}, firsts AS (SELECT signature, min(idx) AS idx FROM signatures GROUP BY signature)
SELECT a.idx AS x, b.idx AS y, len(list_filter(range(1, 101), lambda i: a.signature[i] = b.signature[i])) / 100.0 AS similarity FROM firsts a JOIN firsts b ON a.idx < b.idx
WHERE len(list_filter(range(1, 101), lambda i: a.signature[i] = b.signature[i])) >= 80 UNION ALL SELECT f.idx, s.idx, 1.0 FROM signatures s JOIN firsts f USING (signature) WHERE s.idx <> f.idx""")
def minhash_pairs(spark, d):
    return D.signature_pairs(D.minhash(_docs(spark, d)))


_BITS = " | ".join(f"(CASE WHEN sum(CASE WHEN (h & (1::UBIGINT << {i})) <> 0 THEN 1 ELSE -1 END) > 0 THEN (1::UBIGINT << {i}) ELSE 0::UBIGINT END)" for i in range(64))
_SIMHASH = rf"""toks AS (SELECT doc_id AS idx, unnest({words_sql(rf"trim(regexp_replace(regexp_replace(lower(text), '{WS}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\x09-\x0D\x20.-]', '', 'g'))")}) AS w FROM documents),
hashed AS (SELECT idx, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM toks),
sims AS MATERIALIZED (SELECT idx, {_BITS} AS simhash FROM hashed GROUP BY idx)"""


@query(f"WITH {_SIMHASH} SELECT idx, CAST(CASE WHEN simhash >= 9223372036854775808 THEN simhash::HUGEINT - 18446744073709551616 ELSE simhash END AS BIGINT) AS simhash FROM sims")
def simhash(spark, d):
    return D.simhashes(_docs(spark, d))


@query(f"WITH {_SIMHASH}, firsts AS (SELECT simhash, min(idx) AS idx FROM sims GROUP BY simhash) SELECT a.idx AS x, b.idx AS y, CAST(bit_count(xor(a.simhash, b.simhash)) AS INTEGER) AS distance FROM firsts a JOIN firsts b ON a.idx < b.idx WHERE bit_count(xor(a.simhash, b.simhash)) <= 3")
def hamming_pairs(spark, d):
    return D.hamming_pairs(D.simhashes(_docs(spark, d)))


@query(f"""WITH {_SHINGLES}, n AS (SELECT idx, count(*) AS n FROM flat GROUP BY idx),
common AS (SELECT a.idx AS x, b.idx AS y, count(*) AS c FROM flat a JOIN flat b ON a.t = b.t AND a.idx < b.idx AND a.idx >= b.idx - 99 GROUP BY ALL)
SELECT x, y, round(c / (p.n + q.n - c), 6) AS similarity FROM common JOIN n p ON p.idx = x JOIN n q ON q.idx = y WHERE c / (p.n + q.n - c) >= 0.85""")
def recent_window_pairs(spark, d):
    return D.recent_pairs(_docs(spark, d)).select("x", "y", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_MINHASH}, {_SIMHASH}, pairs AS (SELECT a.idx AS x, b.idx AS y, len(list_filter(range(1, 101), lambda i: a.signature[i] = b.signature[i])) / 100.0 AS m FROM signatures a JOIN signatures b ON a.idx < b.idx
  WHERE len(list_filter(range(1, 101), lambda i: a.signature[i] = b.signature[i])) >= 80)
SELECT x, y, round(0.5 * m + 0.3 * (1 - bit_count(xor(p.simhash, q.simhash)) / 64.0) + 0.2 * (least(length(s.text), length(t.text)) / greatest(length(s.text), length(t.text), 1)), 6) AS similarity
FROM pairs JOIN sims p ON p.idx = x JOIN sims q ON q.idx = y JOIN documents s ON s.doc_id = x JOIN documents t ON t.doc_id = y""")
def combined_similarity(spark, d):
    """0.5 MinHash + 0.3 SimHash + 0.2 ratio of lengths of all pairs that MinHash proposes."""
    docs = _docs(spark, d)
    pairs = D.similar_rows(D.minhash(docs), D.simhashes(docs).join(docs.select("idx", F.length("text").alias("n")), "idx"))
    score = X.combined(F.col("similarity"), X.hamming_similarity(F.col("a.simhash"), F.col("b.simhash")), F.col("a.n"), F.col("b.n"))
    return pairs.select(F.least("a.idx", "b.idx").alias("x"), F.greatest("a.idx", "b.idx").alias("y"), F.round(score, 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_SHINGLES}, {_FIRST}, f AS (SELECT flat.* FROM flat JOIN firsts USING (idx)), n AS (SELECT idx, count(*) AS n FROM f GROUP BY idx),
common AS (SELECT a.idx AS x, b.idx AS y, count(*) AS c FROM f a JOIN f b ON a.t = b.t AND a.idx < b.idx GROUP BY ALL),
alike AS (SELECT x, y FROM common JOIN n p ON p.idx = x JOIN n q ON q.idx = y WHERE c / (p.n + q.n - c) >= 0.8
  UNION SELECT p, idx FROM (SELECT doc_id AS idx, min(doc_id) OVER (PARTITION BY md5({norm_sql('text')})) AS p FROM documents) WHERE idx <> p),
earlier AS MATERIALIZED (SELECT idx, place, coalesce(xs, []) AS xs FROM (SELECT doc_id AS idx, row_number() OVER (ORDER BY doc_id) AS place FROM documents) LEFT JOIN (SELECT y AS idx, list(x) AS xs FROM alike GROUP BY y) USING (idx)),
fold(i, acc) AS (SELECT CAST(0 AS BIGINT), []::BIGINT[] UNION ALL SELECT i + 1, CASE WHEN len(list_intersect(xs, acc)) = 0 THEN list_append(acc, idx) ELSE acc END FROM fold JOIN earlier ON place = i + 1),
done AS (SELECT acc FROM fold ORDER BY i DESC LIMIT 1)
SELECT idx, list_contains(acc, idx) AS accepted, CASE WHEN NOT list_contains(acc, idx) THEN list_min(list_intersect(xs, acc)) END AS duplicate_of FROM earlier, done""")
def near_dup_resolved(spark, d):
    """Acceptance in order of arrival."""
    ensure_checkpoint(spark)
    docs = _docs(spark, d)
    pairs = D.jaccard_pairs(docs).select("x", "y")
    copies = D.exact_duplicates(docs).select(F.col("primary").alias("x"), F.col("idx").alias("y"))
    return D.accept_in_order(docs.select("idx"), pairs.unionByName(copies))


@query(f"""WITH {_SHINGLES}, {_SIMHASH}, sig AS (SELECT idx, i, min(substr(md5(i::VARCHAR || ':' || t), 1, 16)) AS m FROM flat, (SELECT unnest(range(0, 128)) AS i) GROUP BY idx, i),
signed AS (SELECT idx, md5(string_agg(m, ',' ORDER BY i)) AS minhash FROM sig GROUP BY idx)
SELECT doc_id, sha256({norm_sql('text')}) AS content_hash, minhash, CAST(CASE WHEN simhash >= 9223372036854775808 THEN simhash::HUGEINT - 18446744073709551616 ELSE simhash END AS BIGINT) AS simhash,
  CAST(len(s) AS INTEGER) AS shingles, length({norm_sql('text')}) AS chars FROM documents JOIN sh ON sh.idx = doc_id JOIN signed ON signed.idx = doc_id JOIN sims ON sims.idx = doc_id""")
def fingerprints(spark, d):
    """The whole record of a text: hash, MinHash (as a digest), SimHash, shingles and length of its normal form."""
    return D.fingerprints(_docs(spark, d)).select(F.col("idx").alias("doc_id"), "content_hash", F.md5(F.array_join("minhash", ",")).alias("minhash"), "simhash", "shingles", "chars")


@query(f"""WITH {_SHINGLES}, sig AS (SELECT idx, i, min(substr(md5(i::VARCHAR || ':' || t), 1, 16)) AS m FROM flat, (SELECT unnest(range(0, 128)) AS i) GROUP BY idx, i)
SELECT idx, md5(string_agg(m, ',' ORDER BY i)) AS signature FROM sig GROUP BY idx""")
def minhash_prefixed(spark, d):
    return D.minhash_prefixed(_docs(spark, d)).select("idx", F.md5(F.array_join("signature", ",")).alias("signature"))


@query(f"""WITH {_MINHASH}, firsts AS (SELECT signature, min(idx) AS idx FROM signatures GROUP BY signature),
pairs AS (SELECT a.idx AS x, b.idx AS y, len(list_filter(range(1, 101), lambda i: a.signature[i] = b.signature[i])) / 100.0 AS s FROM firsts a JOIN firsts b ON a.idx < b.idx
  WHERE len(list_filter(range(1, 101), lambda i: a.signature[i] = b.signature[i])) >= 80 UNION ALL SELECT f.idx, s.idx, 1.0 FROM signatures s JOIN firsts f USING (signature) WHERE s.idx <> f.idx),
both_ AS (SELECT x, y, s FROM pairs UNION ALL SELECT y, x, s FROM pairs)
SELECT x, y, s AS similarity, CASE WHEN s >= 1 THEN 'exact' WHEN s >= 0.9 THEN 'near_duplicate' ELSE 'similar' END AS label FROM both_ QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 5""")
def most_similar(spark, d):
    return D.most_similar(D.signature_pairs(D.minhash(_docs(spark, d))))
