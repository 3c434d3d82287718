"""Duplicates, scores, retrieval, models and streams."""

import math
import random

from pyspark.sql import functions as F

from lexiforge import models
from lexiforge.operators import context as K
from lexiforge.operators import dedup as D
from lexiforge.operators import index as I
from lexiforge.operators import layout as L
from lexiforge.operators import retrieve as R
from lexiforge.operators import score as S
from lexiforge.streaming import dedup as stream


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "idx long, text string")


def test_accept_in_order(spark):
    r = random.Random(3)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(50)})
    accepted, duplicate = [], {}
    for i in range(40):
        near = [x for x, y in pairs if y == i and x in accepted]
        if near:
            duplicate[i] = min(near)
        else:
            accepted.append(i)
    state = D.accept_in_order(spark.range(40).withColumnRenamed("id", "idx"), spark.createDataFrame(pairs, "x long, y long"))
    got = {row.idx: (row.accepted, row.duplicate_of) for row in state.collect()}
    assert got == {i: (i in accepted, duplicate.get(i)) for i in range(40)}


def test_pairs_find_all(spark):
    r = random.Random(1)
    base = [" ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(60)) for _ in range(6)]
    texts = [t for b in base for t in (b, b + " end", b.replace("ax", "bx", 1))] + [base[0]]
    frame = docs(spark, texts)
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    seen, first = {}, []
    for i, t in enumerate(texts):
        if t not in seen:
            seen[t] = i
            first.append(i)
    want = {(i, j) for i in first for j in first if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8}
    assert {(x.x, x.y) for x in D.jaccard_pairs(frame).collect()} == want
    assert [(x.idx, x.primary) for x in D.exact_duplicates(frame).collect()] == [(len(texts) - 1, 0)]
    assert len(D.bands(100, 0.8)) == 21


def test_bm25_by_hand(spark):
    frame = docs(spark, ["apple pie", "apple tart", "apple cake plain", "pear"])
    got = {(r.query_id, r.idx): r.score for r in S.bm25(frame, spark.createDataFrame([(1, "apple pie")], "query_id int, text string")).collect()}
    df = {"apple": 3, "pie": 1, "tart": 1, "cake": 1, "plain": 1, "pear": 1}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, v in raw.items()}
    part = lambda t, dl: idf[t] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / 2))
    assert got == {(1, 0): round(part("apple", 2) + part("pie", 2), 6), (1, 1): round(part("apple", 2), 6), (1, 2): round(part("apple", 3), 6)}


def test_fusion_and_rules(spark):
    q = lambda rows: spark.createDataFrame(rows, "query_id int, idx long, score double")
    fused = {r.idx: (r.type, r.hybrid) for r in S.fuse(q([(1, 1, 1.0)]), q([(1, 1, 0.5), (1, 2, 1.0)]), q([(1, 3, 1.0)]), q([(1, 3, 0.2), (1, 4, 1.0)])).collect()}
    assert fused == {1: ("semantic+bm25", 0.55), 2: ("bm25", 0.3), 3: ("keyword+exact", 0.3), 4: ("exact", 0.3)}
    rows = spark.createDataFrame([(1, 1, "a", 0.9), (1, 2, "a", 0.8), (1, 3, "b", 0.7), (1, 4, None, 0.6)], "query_id int, idx long, vendor string, hybrid double")
    assert [r.penalty for r in S.vendor_penalty(rows).orderBy("idx").collect()] == [1.0, 1.0, 0.8, 1.0]
    assert [r.penalty for r in S.vendor_penalty(rows, "b").orderBy("idx").collect()] == [0.5, 0.5, 1.0, 1.0]
    texts = spark.createDataFrame([(1, 1, "same text", None, 0.9), (1, 2, "same  text", None, 0.8), (1, 3, "other", 1, 0.7), (1, 4, "third", None, 0.6)], "query_id int, idx long, text string, primary long, hybrid double")
    assert [r.idx for r in S.deduplicate(texts, 5).orderBy("rank").collect()] == [1, 4]


def test_filter_that_empties_finds_nothing(spark):
    frame = docs(spark, ['say "red fox" now', "red fox"]).withColumn("section", F.lit("s")).withColumn("vendor", F.lit("v"))
    asked = spark.createDataFrame([(1, '"red fox"')], "query_id int, text string")
    assert R.hybrid(frame, asked, allowed=frame.select("idx").where("idx < 0")).count() == 0
    assert R.hybrid(frame, asked).count() == 2


def test_expand_and_adjacency(spark):
    chunks = spark.createDataFrame([(0, "f", 1, 2, [1, 2], "A"), (1, "f", 3, 3, [3], "A"), (2, "f", 4, 5, [4, 5], "B"), (3, "g", 3, 3, [3], "A")], "idx long, source string, page_start int, page_end int, pages array<int>, section string")
    edges = I.adjacency(chunks)
    assert sorted((r.idx, r.neighbour) for r in edges.collect()) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    results = spark.createDataFrame([(1, 1, 1, 0.9)], "query_id int, idx long, rank int, score double")
    assert sorted((r.idx, r.how) for r in R.expand(results, chunks, edges).collect()) == [(0, "adjacent"), (1, "result"), (2, "adjacent"), (3, "section")]
    assert 3 not in [r.idx for r in R.expand(results, chunks, edges, within_source=True).collect()]


def test_context(spark):
    rows = spark.createDataFrame([(1, 1, 0, "x" * 50, "f", [1, 3], "v", "s", 0.5), (1, 2, 1, "y" * 50, "f", [2], None, "", 0.25)], "query_id int, rank int, idx long, text string, source string, pages array<int>, vendor string, section string, score double")
    made = K.pieces(rows).orderBy("rank").collect()
    assert made[0].piece.startswith("[Document 1] f | Page: 1-3 | Vendor: v | Section: s | Score: 0.500\nxxx") and "Vendor" not in made[1].piece
    assert K.within_budget(K.pieces(rows), 30).count() == 1


def test_layout(spark):
    images = spark.createDataFrame([("p", 1, 1, "h", 100, 100, "c", None, "long text " * 6), ("p", 2, 1, "h", 100, 100, "", None, ""), ("p", 3, 2, "k", 10, 100, "", None, "")], "path string, seq int, page int, hash string, width int, height int, caption string, alt_text string, ocr_text string")
    assert [r.seq for r in L.distinct_images(images).collect()] == [1]
    assert L.image_chunks(images).count() == 1 and {r.page: r.images for r in L.image_index(images).collect()} == {1: 2, 2: 1}


def test_models(spark):
    frame = docs(spark, ["red fox", "red fox", None])
    rows = models.embed(frame, models.HashedEncoder).orderBy("idx").collect()
    assert rows[0].embedding == rows[1].embedding and abs(sum(x * x for x in rows[0].embedding) - 1) < 1e-5
    index = spark.createDataFrame([("ROUTER",), ("TABLE",)], "term string")
    near = models.fuzzy_keywords(index, spark.createDataFrame([(1, "ROUTERS")], "query_id int, term string")).collect()
    assert [r.keyword for r in near] == ["ROUTER"]

    class Echo:
        def generate(self, system, prompt):
            if prompt == "bad":
                raise ValueError("no")
            return prompt

    asked = spark.createDataFrame([(1, "s", "hi"), (2, "s", "bad")], "query_id int, system string, prompt string")
    assert [(r.answer, r.error) for r in models.generate(asked, Echo).orderBy("query_id").collect()] == [("hi", None), (None, "no")]


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.sql("SELECT * FROM VALUES (1L, 'a b c d e f', TIMESTAMP'2024-01-01 00:00:00'), (2L, 'A  b c d e f', TIMESTAMP'2024-01-01 00:01:00'), (3L, 'z', TIMESTAMP'2024-01-01 00:02:00') AS t(idx, text, ts)").coalesce(1).write.parquet(str(source))
    read = lambda: spark.readStream.schema("idx long, text string, ts timestamp").parquet(str(source))
    q = stream.first_arrivals(read(), "ts").writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2
    q = read().writeStream.foreachBatch(stream.register(str(tmp_path / "kept"))).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 3]


def test_smart_in_sequence(spark):
    r = random.Random(8)
    words = ["router", "fox", "AB12", "red", "this", "mode", "TABLE"]
    texts = [" ".join(r.choice(words) for _ in range(8)) for _ in range(12)]
    chunks = docs(spark, texts).withColumn("section", F.lit("s")).withColumn("vendor", F.lit("v"))
    vectors = [[r.random(), r.random()] for _ in texts]
    vectors = [[a / math.hypot(a, b), b / math.hypot(a, b)] for a, b in vectors]
    frame = spark.createDataFrame(list(enumerate(vectors)), "idx long, embedding array<float>")
    asked = spark.createDataFrame([(1, 'this "red fox" AB12')], "query_id int, text string")
    question = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, vector array<float>")
    previous = spark.createDataFrame([(1, 0), (1, 5)], "query_id int, idx long")
    got = {x.idx: (x.type, x.boost, x.final) for x in R.smart(chunks, asked, frame, question, previous=previous).collect()}
    from lexiforge.config import V1_OPTIMISED as C

    scores = lambda rows: {x.idx: x.score for x in rows.collect()}
    near = scores(S.max_normalised(S.top(S.cosine(frame, question), C.semantic_k)))
    bm = scores(S.max_normalised(S.top(S.bm25(chunks, asked, C), C.bm25_k)))
    terms = spark.createDataFrame([(1, t) for t in ["THIS", "RED", "FOX", "red fox", "AB12"]], "query_id int, term string")
    key = scores(S.keyword_scores(I.inverted_index(chunks), terms, C.postings_limit, lower=1.0))
    exact = scores(S.top(S.exact_scores(chunks, spark.createDataFrame([(1, "red fox")], "query_id int, term string"), C.exact_boost), 15))
    found = {i: {"s": 0.0, "b": 0.0, "k": 0.7, "type": "continuation", "boost": 1.5} for i in (0, 5)}
    for name, hits, label in (("s", near, "semantic"), ("b", bm, "bm25")):
        for i, v in hits.items():
            if name == "b" and found.get(i, {}).get("type") == "semantic":
                found[i]["type"] += "+bm25"
            found.setdefault(i, {"s": 0.0, "b": 0.0, "k": 0.0, "type": label, "boost": 1.0})[name] = v
    for i, v in key.items():
        if i in found:
            found[i]["k"] = v
            found[i]["boost"] *= 1.5
        else:
            found[i] = {"s": 0.0, "b": 0.0, "k": v, "type": "keyword", "boost": 1.2}
    for i, v in exact.items():
        if i in found:
            found[i]["k"] = max(found[i]["k"], v)
            found[i]["boost"] *= 2.0
            found[i]["type"] += "+exact"
        else:
            found[i] = {"s": 0.0, "b": 0.0, "k": v, "type": "exact_match", "boost": 2.0}
    assert set(got) == set(found)
    for i, f in found.items():
        hybrid = C.weights[0] * f["s"] + C.weights[1] * f["b"] + C.weights[2] * f["k"]
        assert got[i][0] == f["type"] and abs(got[i][1] - f["boost"]) < 1e-9 and abs(got[i][2] - hybrid * f["boost"]) < 1e-5


def test_variants(spark):
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.8), (2, 3, 0.6)], "x long, y long, similarity double")
    assert [(r.x, r.y, r.label) for r in D.most_similar(pairs).orderBy("x", "y").collect()] == [(1, 2, "exact"), (1, 3, "similar"), (2, 1, "exact"), (3, 1, "similar")]
    prints = spark.createDataFrame([(1, 2, "h", "h", ["a"], ["b"], 0, 1), (1, 3, "h", "g", ["a"] * 20, ["a"] * 20, 0, -1), (1, 4, "h", "g", ["a"], ["b"], 0, 7), (1, 5, "h", "g", ["a"], ["b"], 0, 255)], "x long, y long, hash_x string, hash_y string, minhash_x array<string>, minhash_y array<string>, simhash_x long, simhash_y long")
    assert {r.y: round(r.score, 4) for r in D.fingerprint_matches(prints).collect()} == {2: 1.0, 3: 1.0, 4: round(1 - 3 / 64, 4)}
    rows = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (1, 3, 0.7)], "query_id int, idx long, final double")
    assert [r.final for r in S.rerank_head(rows, F.lit(1.0), head=2).orderBy("idx").collect()] == [0.965, 0.93, 0.7]
