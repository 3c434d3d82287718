"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.session import shared_root, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name; sql is what DuckDB runs on the same tables."""
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """documents as chunks: idx, text, source, vendor (the language), section (the source)."""
    return spread(table(spark, folder, "documents")).select(F.col("doc_id").alias("idx"), "text", "source", F.col("lang").alias("vendor"), F.col("source").alias("section"))


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    from lexiforge.operators.structure import lines_of

    return lines_of(spread(table(spark, folder, "documents")))


def questions(spark: SparkSession) -> DataFrame:
    """The stated query batch."""
    return spark.createDataFrame(QUESTIONS, "query_id int, text string")


def ensure_checkpoint(spark: SparkSession) -> None:
    """A folder for checkpoints: the session's, or a local one where it names none."""
    shared_root(spark)


QUESTIONS = [
    (1, "which documents are licensed under the apache license version 2.0"),
    (2, 'where is "all rights reserved" or "MIT License" stated'),
    (3, 'mail "example.com" token of the handover'),
    (4, "de la que los"),
]

#: SQL fragments shared by the twins.
WS = r"[\x09-\x0D\x20]"
QUESTIONS_SQL = "questions(query_id, q) AS (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in QUESTIONS) + ")"


def norm_sql(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '{WS}+', ' ', 'g'))"


def words_sql(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '{WS}+'), lambda w: w <> '')"


def plain_sql(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', '__', 'g')"


def telecom_sql(c: str) -> str:
    from lexiforge.functions.text import joined_terms

    return "list_concat(" + ", ".join(f"regexp_extract_all({c}, '(?i){p}')" for p in joined_terms()) + ")"


def tokens_sql(c: str) -> str:
    low = f"lower({c})"
    split = words_sql(rf"regexp_replace({low}, '[^\p{{L}}\p{{N}}_\x09-\x0D\x20.-]', ' ', 'g')")
    return f"list_filter(list_distinct(list_concat({split}, {telecom_sql(plain_sql(low))})), lambda t: length(t) >= 2)"


def keywords_sql(c: str) -> str:
    p = plain_sql(c)
    found = rf"list_concat({telecom_sql(p)}, regexp_extract_all({p}, '\b[A-Z]{{3,}}\b'), list_filter(regexp_extract_all({c}, '" + r'"([^"]+)"' + rf"', 1), lambda q: length(q) > 2), regexp_extract_all({p}, '(?i)\bv?\d+\.\d+(?:\.\d+)*\b'))"
    return f"list_sort(list_distinct(list_transform({found}, lambda k: upper(k))))"


#: tok(idx, terms), df, idf and BM25 scores of the questions, as the operators define them.
BM25_SQL = f"""
{QUESTIONS_SQL},
tok AS MATERIALIZED (SELECT doc_id AS idx, {tokens_sql('text')} AS terms FROM documents),
size AS (SELECT count(*) AS n, avg(len(terms)) AS average FROM tok),
rowsof AS (SELECT idx, len(terms) AS dl, unnest(terms) AS term FROM tok),
dfs AS (SELECT term, count(*) AS df FROM rowsof GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM dfs, size),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
asked AS (SELECT query_id, unnest({tokens_sql('q')}) AS term FROM questions),
bm25 AS (
  SELECT query_id, idx, round(sum(idf * 2.5 / (1 + 1.5 * (1 - 0.75 + 0.75 * dl / (SELECT average FROM size)))), 6) AS score
  FROM rowsof JOIN asked USING (term) JOIN idf USING (term) GROUP BY query_id, idx HAVING score > 0)"""
