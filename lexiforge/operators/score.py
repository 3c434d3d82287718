"""Scores of candidates for a batch of queries: BM25, keywords, exact text, vectors, fusion, boosts and penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.config import V2, Settings
from lexiforge.functions import measures as X
from lexiforge.functions import text as T
from lexiforge.operators import index as I
from lexiforge.session import materialise, sent


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct BM25 tokens of each query."""
    return queries.select("query_id", F.explode(T.bm25_tokens(F.col("text"))).alias("term"))


def bm25(chunks: DataFrame, queries: DataFrame, cfg: Settings = V2) -> DataFrame:
    """query_id, idx, score > 0 (6 decimals) of the chunks that share a term with a query."""
    tokens = materialise(chunks.select("idx", T.bm25_tokens(F.col("text")).alias("tokens")), "tokens")
    n, average = tokens.agg(F.count("*"), F.avg(F.size("tokens"))).first()
    idf = I.bm25_idf(tokens.select(F.explode("tokens").alias("term")), n)
    rows = tokens.select("idx", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    asked = query_terms(queries).join(idf.select("term", "idf"), "term")
    met = rows.join(asked, "term")
    part = F.col("idf") * (cfg.bm25_k1 + 1) / (1 + cfg.bm25_k1 * (1 - cfg.bm25_b + cfg.bm25_b * F.col("dl") / F.lit(average)))
    return met.groupBy("query_id", "idx").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def top(scored: DataFrame, k: int, score: str = "score", by: str = "query_id") -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller idx."""
    order = Window.partitionBy(by).orderBy(F.desc(score), "idx")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def keyword_scores(index: DataFrame, terms: DataFrame, limit: int = 30, upper: float = 1.0, lower: float = 0.5) -> DataFrame:
    """query_id, idx, score: postings of query terms (query_id, term, repeats counted), over each query's largest."""
    up = terms.select("query_id", F.upper("term").alias("term"), F.lit("keyword").alias("index_name"), F.lit(upper).alias("w"))
    low = terms.select("query_id", F.lower("term").alias("term"), F.lit("keyword_lower").alias("index_name"), F.lit(lower).alias("w"))
    asked = up.unionByName(low)
    # only postings of asked terms are ranked
    met = index.join(sent(asked.select("index_name", "term").distinct()), ["index_name", "term"], "left_semi")
    summed = I.first_postings(met, limit).join(asked, ["index_name", "term"]).groupBy("query_id", "idx").agg(F.sum("w").alias("raw"))
    return summed.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))).drop("raw")


def exact_scores(chunks: DataFrame, terms: DataFrame, boost: float = 3.0) -> DataFrame:
    """query_id, idx, score: non-overlapping occurrences of terms, each worth ``boost``, once more if one stands alone; over the largest."""
    asked = terms.select("query_id", F.lower("term").alias("term")).where("term <> ''")
    low = chunks.select("idx", F.lower("text").alias("low"))
    found = low.join(sent(asked), F.contains(F.col("low"), F.col("term")))  # the stated query batch
    count = (F.length("low") - F.length(F.replace("low", "term", F.lit("")))) / F.length("term")
    edge = F.lit(r"(?:^|[^\p{L}\p{N}_])")
    end = F.lit(r"(?:$|[^\p{L}\p{N}_])")
    alone = F.rlike("low", F.concat(edge, F.regexp_replace("term", r"([\\.\[\]{}()*+?^$|])", r"\\$1"), end))
    raw = found.groupBy("query_id", "idx").agg(F.sum(count * boost + F.when(alone, F.lit(boost)).otherwise(F.lit(0.0))).alias("raw"))
    return raw.withColumn("score", F.col("raw") / F.max("raw").over(Window.partitionBy("query_id"))).drop("raw")


def cosine(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, idx, score (5 decimals): inner product of unit vectors (idx, embedding) with queries (query_id, vector)."""
    pairs = vectors.join(sent(queries))  # the stated query batch against all rows
    return pairs.select("query_id", "idx", F.round(X.dot(F.col("embedding"), F.col("vector")), 5).alias("score"))


def max_normalised(scored: DataFrame, score: str = "score") -> DataFrame:
    largest = F.max(score).over(Window.partitionBy("query_id"))
    return scored.withColumn(score, F.when(largest > 0, F.col(score) / largest).otherwise(F.lit(0.0)))


KINDS = (("semantic", "semantic"), ("bm25", "bm25"), ("keyword", "kw"), ("exact", "exact"))


def fuse(semantic: DataFrame, bm25_: DataFrame, keyword: DataFrame, exact: DataFrame | None, weights: tuple[float, float, float] = V2.weights) -> DataFrame:
    """query_id, idx, semantic, bm25, keyword, type, hybrid from scores that are normalised already.

    One union and one aggregate instead of a chain of outer joins. An exact score raises the keyword score.
    """
    parts = [d.select("query_id", "idx", F.lit(kind).alias("kind"), "score") for (kind, _), d in zip(KINDS, (semantic, bm25_, keyword, exact), strict=True) if d is not None]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("score")))
    wide = every.groupBy("query_id", "idx").agg(*[of(kind).alias(f"_{kind}") for kind, _ in KINDS])
    has = [F.when(F.col(f"_{kind}").isNotNull(), F.lit(tag)) for kind, tag in KINDS]
    first = F.coalesce(*[F.when(F.col(f"_{kind}").isNotNull(), F.lit(kind)) for kind, _ in KINDS])
    tags = F.array_compact(F.array(*has))
    label = F.concat_ws("+", first, F.slice(tags, F.lit(2), F.greatest(F.size(tags) - 1, F.lit(0))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    out = wide.select("query_id", "idx", zero("_semantic").alias("semantic"), zero("_bm25").alias("bm25"), F.greatest(zero("_keyword"), zero("_exact")).alias("keyword"), label.alias("type"))
    a, b, c = weights
    return out.withColumn("hybrid", F.round(a * F.col("semantic") + b * F.col("bm25") + c * F.col("keyword"), 6))


def rerank(candidates: DataFrame, rerank_score: Column, mix: tuple[float, float] = V2.rerank_mix, clamp: bool = True) -> DataFrame:
    """final = mix of the hybrid and the re-ranker's score, the latter not below 0."""
    score = F.greatest(rerank_score, F.lit(0.0)) if clamp else rerank_score
    return candidates.withColumn("final", F.round(mix[0] * F.col("hybrid") + mix[1] * score, 8))


def lexical_overlap(text: Column, query: Column, cut: int = 1500) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of a query's tokens that the text's first characters hold."""
    asked = T.bm25_tokens(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, T.bm25_tokens(F.substring(text, 1, cut)))) / F.size(asked)).otherwise(F.lit(0.0))


def deduplicate(ranked: DataFrame, k: int, score: str = "hybrid", prefix: int = 300) -> DataFrame:
    """ranked (query_id, idx, text, primary, score): per query the best of each text prefix, then of each primary, then the k best."""
    order = lambda *keys: Window.partitionBy("query_id", *keys).orderBy(F.desc(score), "idx")
    key = F.xxhash64(F.regexp_replace(F.lower(F.substring("text", 1, prefix)), T.WS + "+", " "))
    one = ranked.withColumn("_key", key).withColumn("_rn", F.row_number().over(order("_key"))).where("_rn = 1")
    two = one.withColumn("_rn", F.row_number().over(order(F.coalesce("primary", "idx")))).where("_rn = 1").drop("_rn", "_key")
    return top(two, k, score)


def vendor_penalty(results: DataFrame, asked: str | None = None, score: str = "hybrid") -> DataFrame:
    """results with penalty and penalised score: half for another vendor than asked for, else 0.8 for all but the commonest.

    A null vendor is never penalised; ties for the commonest go to the vendor met first.
    """
    if asked:
        penalty = F.when(F.col("vendor") != asked, F.lit(0.5)).otherwise(F.lit(1.0))
        return results.withColumn("penalty", F.coalesce(penalty, F.lit(1.0))).withColumn("penalised", F.round(F.col(score) * F.col("penalty"), 6))
    counts = results.where("vendor IS NOT NULL").groupBy("query_id", "vendor").agg(F.count("*").alias("_n"), F.min(F.struct(-F.col(score), F.col("idx"))).alias("_first"))
    main = counts.groupBy("query_id").agg(F.min(F.struct(-F.col("_n"), F.col("_first"), F.col("vendor")))["vendor"].alias("_main"))
    out = results.join(main, "query_id", "left")
    penalty = F.when(F.col("vendor") != F.col("_main"), F.lit(0.8)).otherwise(F.lit(1.0))
    return out.withColumn("penalty", F.coalesce(penalty, F.lit(1.0))).withColumn("penalised", F.round(F.col(score) * F.col("penalty"), 6)).drop("_main")


def rerank_head(candidates: DataFrame, rerank_score: Column, head: int = 24, mix: tuple[float, float] = (0.35, 0.65)) -> DataFrame:
    """candidates (query_id, idx, final): only the first ``head`` are mixed with the re-ranker's score; the others keep theirs and are sorted among them."""
    ranked = candidates.withColumn("_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "idx")))
    mixed = mix[0] * F.col("final") + mix[1] * F.greatest(rerank_score, F.lit(0.0))
    return ranked.withColumn("final", F.round(F.when(F.col("_rank") <= head, mixed).otherwise(F.col("final")), 8)).drop("_rank")
