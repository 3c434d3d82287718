"""Composite retrieval: two stages with filters, context expansion, and the first generation's cascade."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.config import V1_OPTIMISED, V2, Settings
from lexiforge.functions import patterns as P
from lexiforge.functions import text as T
from lexiforge.operators import index as I
from lexiforge.operators import score as S
from lexiforge.session import sent


def feature_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: keywords, quoted terms and technical ids of each query; a term found twice counts twice."""
    every = F.concat(T.keywords(F.col("text")), T.quoted_terms(F.col("text")), T.technical_ids(F.col("text")))
    return queries.select("query_id", F.explode(every).alias("term"))


def hybrid(chunks: DataFrame, queries: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, cfg: Settings = V2, allowed: DataFrame | None = None, filter_mode: str = "post") -> DataFrame:
    """Fused candidates of chunks (idx, text, section, vendor) for queries (query_id, text).

    allowed: idx that may be found. "pre" scores only those; "post" cuts and normalises over all chunks, then drops.
    """
    searched = chunks.join(allowed, "idx", "left_semi") if allowed is not None and filter_mode == "pre" else chunks
    terms, quoted = feature_terms(queries), queries.select("query_id", F.explode(T.quoted_terms(F.col("text"))).alias("term"))
    words = S.max_normalised(S.top(S.bm25(searched, queries, cfg), cfg.bm25_k))
    keys = S.keyword_scores(I.inverted_index(searched), terms, cfg.postings_limit)
    exact = S.exact_scores(searched, quoted, cfg.exact_boost)
    near = None
    if vectors is not None:
        seen = vectors.join(allowed, "idx", "left_semi") if allowed is not None and filter_mode == "pre" else vectors
        near = S.max_normalised(S.top(S.cosine(seen, query_vectors), cfg.semantic_k))
    else:
        near = words.limit(0)
    fused = S.fuse(near, words, keys, exact, cfg.weights)
    return fused.join(allowed, "idx", "left_semi") if allowed is not None and filter_mode == "post" else fused


def document_stage(vectors: DataFrame, query_vectors: DataFrame, members: DataFrame, vendor: str | None = None, k: int = 5) -> DataFrame:
    """query_id, idx: the chunks of the k documents nearest to a query, of a vendor if one is asked for.

    vectors: idx (of a document), embedding, vendor. members: document, idx (of a chunk). The filter acts after the cut.
    """
    best = S.top(S.cosine(vectors, query_vectors), k)
    if vendor is not None:
        best = best.join(vectors.where(F.col("vendor") == vendor), "idx", "left_semi")
    return best.select("query_id", F.col("idx").alias("document")).join(members, "document").select("query_id", "idx")


def expand(results: DataFrame, chunks: DataFrame, adjacency: DataFrame, neighbours: int = 2, per_section: int = 3, within_source: bool = False) -> DataFrame:
    """query_id, idx, score, how: results (query_id, idx, rank, score), then neighbours at 0.5, then chunks of the first three's sections at 0.4.

    A section's first chunks are taken over all sources, or within the result's own.
    """
    base = results.select("query_id", "idx", "score", F.lit("result").alias("how"))
    near = adjacency.withColumn("_rn", F.row_number().over(Window.partitionBy("idx").orderBy("ord"))).where(F.col("_rn") <= neighbours)
    beside = results.select("query_id", "idx").join(near, "idx").select("query_id", F.col("neighbour").alias("idx")).distinct().join(base, ["query_id", "idx"], "left_anti")
    keys = ["section", "source"] if within_source else ["section"]
    first = chunks.where("section IS NOT NULL").withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))).where(F.col("_rn") <= per_section)
    sections = results.where("rank <= 3").join(chunks.select("idx", "section", "source"), "idx").select("query_id", *keys).distinct()
    shared = sections.join(first.select(*keys, "idx"), keys).select("query_id", "idx").distinct()
    rest = shared.join(base, ["query_id", "idx"], "left_anti").join(beside, ["query_id", "idx"], "left_anti")
    return base.unionByName(beside.select("query_id", "idx", F.lit(0.5).alias("score"), F.lit("adjacent").alias("how"))).unionByName(rest.select("query_id", "idx", F.lit(0.4).alias("score"), F.lit("section").alias("how")))


def cascade(chunks: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """First generation, without its fuzzy and semantic levels: the best level at which a chunk answers a query.

    quoted text 5.0, a phrase of the question as indexed run of words 3.0 or in the text 2.5, an identifier 2.0, a synonym 1.5,
    words longer than three characters 0.5 + 0.2 each. Equal scores go to the earlier level, then the smaller idx.
    """
    none = F.array().cast("array<string>")
    own_ids = T.bind(F.upper(T.plain(F.col("text"))), lambda t: F.when(F.rlike(t, F.lit("[0-9]")), F.flatten(F.array(*[T.all_matches(t, p) for p, _ in P.QUERY_IDS]))).otherwise(none))
    spaced = F.concat(F.lit(" "), F.array_join(T.words(F.lower("text")), " "), F.lit(" "))
    texts = chunks.select("idx", F.lower("text").alias("low"), F.upper("text").alias("up"), spaced.alias("spaced"), own_ids.alias("own"))
    asked = queries.select(
        "query_id", F.transform(T.quoted_terms(F.col("text")), F.lower).alias("quoted"), T.query_phrases(F.col("text")).alias("phrases"), F.transform(T.query_ids(F.col("text")), lambda x: x["term"]).alias("ids"),
        F.slice(T.expansions(F.col("text")), 2, 4).alias("variants"), F.filter(T.words(F.upper("text")), lambda w: F.length(w) > 3).alias("big"),
    )
    low = texts.join(sent(asked))  # the stated query batch
    any_in = lambda terms, where: F.exists(terms, lambda t: F.contains(where, t))
    run = F.exists("phrases", lambda p: (F.length(p) > 10) & F.contains(F.col("spaced"), F.concat(F.lit(" "), p, F.lit(" "))))
    count = F.size(F.filter("big", lambda w: F.contains(F.col("up"), w)))
    levels = [
        (any_in(F.col("quoted"), F.col("low")), F.lit(5.0)), (run, F.lit(3.0)), (any_in(F.col("phrases"), F.col("low")), F.lit(2.5)),
        (F.arrays_overlap("ids", "own"), F.lit(2.0)), (any_in(F.col("variants"), F.col("low")), F.lit(1.5)), (count > 0, F.round(0.5 + 0.2 * count, 6)),
    ]
    made = F.array_compact(F.array(*[F.when(hit, F.struct((-score).alias("neg"), F.lit(i).alias("level"), score.alias("score"))) for i, (hit, score) in enumerate(levels)]))
    best = low.select("query_id", "idx", F.array_min(made).alias("b")).where("b IS NOT NULL")
    return S.top(best.select("query_id", "idx", F.col("b.score").alias("score"), F.col("b.level").alias("level")), k)


def smart(chunks: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, cfg: Settings = V1_OPTIMISED, previous: DataFrame | None = None) -> DataFrame:
    """query_id, idx, type, boost, semantic, bm25, hybrid, final: candidates boosted by how they were found.

    previous (query_id, idx): what the turn before found, for continuing questions. Keyword hits raise a candidate's boost
    by 1.5 or enter with 1.2, exact hits by 2.0, continued ones start at 1.5.
    """
    up = T.all_matches(F.upper(T.plain(F.col("text"))), r"\b[A-Z]{2,}\b")
    terms = queries.select("query_id", F.explode(F.concat(up, T.quoted_terms(F.col("text")), T.technical_ids(F.col("text")))).alias("term"))
    quoted = queries.select("query_id", F.explode(T.quoted_terms(F.col("text"))).alias("term"))
    near = S.max_normalised(S.top(S.cosine(vectors, query_vectors), cfg.semantic_k))
    words = S.max_normalised(S.top(S.bm25(chunks, queries, cfg), cfg.bm25_k))
    keys = S.keyword_scores(I.inverted_index(chunks), terms, cfg.postings_limit, lower=1.0)
    exact = S.top(S.exact_scores(chunks, quoted, cfg.exact_boost), 15)
    parts = [("semantic", near), ("bm25", words), ("keyword", keys), ("exact", exact)]
    if previous is not None:
        going = queries.where(T.continues(F.col("text"))).select("query_id").join(previous, "query_id")
        parts.append(("continuation", going.select("query_id", "idx", F.lit(0.7).alias("score"))))
    every = reduce(lambda a, b: a.unionByName(b), [d.select("query_id", "idx", F.lit(kind).alias("kind"), "score") for kind, d in parts])
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score")))
    wide = every.groupBy("query_id", "idx").agg(*[of(kind).alias(kind) for kind in ("semantic", "bm25", "keyword", "exact", "continuation")])
    has = lambda c: F.col(c).isNotNull()
    before = has("continuation") | has("semantic") | has("bm25")
    boost = F.when(has("continuation"), F.lit(1.5)).otherwise(F.lit(1.0))
    boost = boost * F.when(has("keyword"), F.when(before, F.lit(1.5)).otherwise(F.lit(1.2))).otherwise(F.lit(1.0)) * F.when(has("exact"), F.lit(2.0)).otherwise(F.lit(1.0))
    found = (("continuation", "continuation"), ("semantic", "semantic"), ("bm25", "bm25"), ("keyword", "keyword"), ("exact", "exact_match"))
    both = F.when(~has("continuation") & has("semantic") & has("bm25"), F.lit("+bm25")).otherwise(F.lit(""))
    late = F.when(has("exact") & (before | has("keyword")), F.lit("+exact")).otherwise(F.lit(""))
    kind = F.concat(F.coalesce(*[F.when(has(c), F.lit(label)) for c, label in found]), both, late)
    a, b, c = cfg.weights
    zero = lambda x: F.coalesce(F.col(x), F.lit(0.0))
    own = F.when(has("keyword"), F.col("keyword")).when(has("continuation"), F.lit(0.7)).otherwise(F.lit(0.0))
    scored = wide.select("query_id", "idx", kind.alias("type"), boost.alias("boost"), zero("semantic").alias("semantic"), zero("bm25").alias("bm25"), F.round(a * zero("semantic") + b * zero("bm25") + c * F.greatest(own, zero("exact")), 6).alias("hybrid"))
    return scored.withColumn("final", F.round(F.col("hybrid") * F.col("boost"), 6))


def retrieve(chunks: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, cfg: Settings = V2, allowed: DataFrame | None = None, vendor: str | None = None, primary: DataFrame | None = None, reranker=S.lexical_overlap) -> DataFrame:
    """query_id, rank, idx, type, hybrid, final: what a question gets, from candidates to the k results.

    Fused candidates, of those chunks only that allowed (query_id, idx), such as ``document_stage`` gives, and the vendor
    leave; the ``semantic_k`` best of them; re-ranked if they are more than five; of equal text heads and of equal primaries
    (primary: idx, primary) the best one. chunks: idx, text, section, vendor.
    """
    fused = hybrid(chunks, queries, vectors, query_vectors, cfg)
    if allowed is not None:
        fused = fused.join(allowed.distinct(), ["query_id", "idx"], "left_semi")
    shown = chunks.where(F.col("vendor") == vendor) if vendor is not None else chunks
    kept = S.top(fused.join(shown.select("idx", "text"), "idx"), cfg.semantic_k, "hybrid").drop("rank")
    asked = queries.select("query_id", F.col("text").alias("_q"))
    mixed = cfg.rerank_mix[0] * F.col("hybrid") + cfg.rerank_mix[1] * F.greatest(reranker(F.col("text"), F.col("_q")), F.lit(0.0))
    many = F.count("*").over(Window.partitionBy("query_id")) > 5
    final = kept.join(sent(asked), "query_id").withColumn("final", F.round(F.when(many, mixed).otherwise(F.col("hybrid")), 8))
    named = final.join(primary, "idx", "left") if primary is not None else final.withColumn("primary", F.col("idx"))
    return S.deduplicate(named, cfg.final_k, "final").select("query_id", "rank", "idx", "type", "hybrid", "final")


def smart_retrieve(chunks: DataFrame, queries: DataFrame, vectors: DataFrame, query_vectors: DataFrame, adjacency: DataFrame, section_vectors: DataFrame | None = None, cfg: Settings = V1_OPTIMISED, previous: DataFrame | None = None, primary: DataFrame | None = None, reranker=S.lexical_overlap) -> DataFrame:
    """query_id, rank, idx, type, final: the boosted candidates with sections and neighbours, re-ranked at the head, without duplicates.

    section_vectors (query_id, vector): of what a question names as a section; all chunks of the section of the nearest chunk
    enter with 0.3. Neighbours (adjacency: idx, neighbour) of the ``final_k`` best by semantic and BM25 scores enter with 0.1
    and a boost of 0.8. The first 2 * semantic_k candidates are mixed with the re-ranker's score if there are more than five.
    """
    own = smart(chunks, queries, vectors, query_vectors, cfg, previous).select("query_id", "idx", "type", "semantic", "bm25", "final")
    worth = lambda keyword, boost: F.round(F.round(F.lit(cfg.weights[2] * keyword), 6) * boost, 6).alias("final")
    none = [F.lit(0.0).alias("semantic"), F.lit(0.0).alias("bm25")]
    if section_vectors is not None:
        nearest = S.top(S.cosine(vectors, section_vectors), 1).join(chunks.select("idx", "section"), "idx").where("section IS NOT NULL").select("query_id", "section")
        whole = nearest.join(chunks.select("idx", "section"), "section").select("query_id", "idx")
        more = whole.join(own, ["query_id", "idx"], "left_anti").select("query_id", "idx", F.lit("section").alias("type"), *none, worth(0.3, 1.0))
        own = own.unionByName(more)
    head = S.top(own.withColumn("_both", F.col("semantic") + F.col("bm25")), cfg.final_k, "_both").select("query_id", "idx")
    beside = head.join(adjacency, "idx").select("query_id", F.col("neighbour").alias("idx")).distinct()
    own = own.unionByName(beside.join(own, ["query_id", "idx"], "left_anti").select("query_id", "idx", F.lit("adjacent").alias("type"), *none, worth(0.1, 0.8)))
    told = own.join(chunks.select("idx", "text"), "idx").join(sent(queries.select("query_id", F.col("text").alias("_q"))), "query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "idx")
    placed = told.withColumn("_place", F.row_number().over(order)).withColumn("_many", F.count("*").over(Window.partitionBy("query_id")) > 5)
    mixed = cfg.rerank_mix[0] * F.col("final") + cfg.rerank_mix[1] * F.greatest(reranker(F.col("text"), F.col("_q"), 1 << 30), F.lit(0.0))
    ranked = placed.withColumn("final", F.round(F.when(F.col("_many") & (F.col("_place") <= 2 * cfg.semantic_k), mixed).otherwise(F.col("final")), 8))
    named = ranked.join(primary, "idx", "left") if primary is not None else ranked.withColumn("primary", F.col("idx"))
    return S.deduplicate(named, cfg.final_k, "final").select("query_id", "rank", "idx", "type", "final")


def contains_any(text: Column, terms: Column) -> Column:
    return F.exists(terms, lambda t: F.contains(F.lower(text), F.lower(t)))
