"""Inverted indexes, BM25 statistics, adjacency: each a table, never a monolith."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.functions.patterns import TEXT_STOP


def postings(chunks: DataFrame, name: str, terms: Column) -> DataFrame:
    """index_name, term, idx: one row for each distinct term of a chunk."""
    return chunks.select(F.lit(name).alias("index_name"), F.explode(F.array_distinct(terms)).alias("term"), "idx")


def inverted_index(chunks: DataFrame) -> DataFrame:
    """Postings of keywords (upper and lower case), phrases, sections and vendors of chunks (idx, text, section, vendor).

    One pass over the texts: all terms of a chunk are one array, which is exploded once.
    """
    def named(name: str, terms: Column) -> Column:
        return F.transform(F.array_distinct(terms), lambda t: F.struct(F.lit(name).alias("index_name"), t.alias("term")))

    def every(upper: Column) -> Column:
        own = [named(name, F.when(F.col(name).isNotNull(), F.array(name)).otherwise(F.array().cast("array<string>"))) for name in ("section", "vendor")]
        return F.concat(named("keyword", upper), named("keyword_lower", F.transform(upper, F.lower)), named("phrase", T.phrases(F.col("text"))), *own)

    listed = F.coalesce(T.bind(F.coalesce(T.keywords(F.col("text")), F.array().cast("array<string>")), every), F.array().cast("array<struct<index_name:string,term:string>>"))
    return chunks.select("idx", F.explode(listed).alias("t")).select("t.index_name", "t.term", "idx")


def first_postings(index: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` postings of each term, in order of idx."""
    return index.withColumn("rn", F.row_number().over(Window.partitionBy("index_name", "term").orderBy("idx"))).where(F.col("rn") <= limit).drop("rn")


def phrase_ngrams(chunks: DataFrame, limit: int = 100) -> DataFrame:
    """term, idx: runs of two to four words over ten characters with a word that is no stop word, at most ``limit`` postings a term.

    Repeats within a chunk count, as they arrive in order of length and place.
    """
    def runs(w: Column) -> Column:
        def of(n: int) -> Column:
            every = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.struct(F.lit(n).alias("n"), i.alias("i"), F.slice(w, i, n).alias("r")))
            kept = F.filter(every, lambda x: (F.length(F.array_join(x["r"], " ")) > 10) & F.exists(x["r"], lambda y: ~y.isin(*TEXT_STOP)))
            told = F.transform(kept, lambda x: F.struct(x["n"], x["i"], F.array_join(x["r"], " ").alias("term")))
            return F.when(F.size(w) >= n, told).otherwise(F.array().cast("array<struct<n:int,i:int,term:string>>"))

        return F.concat(of(2), of(3), of(4))

    rows = chunks.select("idx", F.explode(T.bind(T.words(F.lower("text")), runs)).alias("x")).select("idx", "x.*")
    order = Window.partitionBy("term").orderBy("idx", "n", "i")
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= limit).select("term", "idx")


def term_rows(chunks: DataFrame) -> DataFrame:
    """idx, term: the distinct BM25 tokens of each chunk; a term's frequency in a chunk is always 1."""
    return chunks.select("idx", F.explode(T.bm25_tokens(F.col("text"))).alias("term"))


def bm25_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("idx", F.size(T.bm25_tokens(F.col("text"))).alias("dl"))


def bm25_idf(terms: DataFrame, n: int) -> DataFrame:
    """term, df, idf = ln(n - df + 0.5) - ln(df + 0.5); a negative one becomes a quarter of the mean over all terms."""
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # one row is sent


def adjacency(chunks: DataFrame) -> DataFrame:
    """idx, neighbour of chunks (idx, source, page_start, page_end, pages): the chunk of the page after and before, within a source.

    A page stands for the last chunk that holds it.
    """
    page = chunks.select("source", F.explode("pages").alias("page"), "idx").groupBy("source", "page").agg(F.max("idx").alias("neighbour"))
    wanted = chunks.select("idx", "source", F.explode(F.array(F.struct(F.lit(0).alias("ord"), (F.col("page_end") + 1).alias("page")), F.struct(F.lit(1).alias("ord"), (F.col("page_start") - 1).alias("page")))).alias("w")).select("idx", "source", "w.*")
    return wanted.join(page, ["source", "page"]).where("idx <> neighbour").select("idx", "ord", "neighbour")


def adjacency_all(chunks: DataFrame) -> DataFrame:
    """idx, neighbour: every chunk that starts on the page after another ends, both ways."""
    a = chunks.select("source", F.col("idx").alias("x"), (F.col("page_end") + 1).alias("page"))
    b = chunks.select("source", F.col("idx").alias("y"), F.col("page_start").alias("page"))
    met = a.join(b, ["source", "page"]).where("x <> y")
    return met.select(F.col("x").alias("idx"), F.col("y").alias("neighbour")).union(met.select("y", "x")).distinct()
