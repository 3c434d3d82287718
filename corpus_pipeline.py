"""The corpus pipeline: five stages of the training-data operators, each written as Parquet and read again as the next one's input.

quality rules drop what they reject; of each group of near copies one row stays; personal data is masked in the text;
sources are mixed to their target weights (documents repeat or go); what is left is packed along a space-filling curve.
All stages but the last return the columns of documents, extra ones included, whatever their names.

Null texts fail the quality rules. doc_ids may be null or repeated: rows are told apart by a written number where it matters,
and different texts that share an id all stay. Equal rows count as copies. Texts are whole, whatever their length. Every
stage takes an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm import mixing, nearcopies, packing, personal, quality
from lexiforge.llm.queries import tokenizer_path
from lexiforge.llm.shared import materialise, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: that of the smallest id (none counts as the largest), then of the smallest hash of its text.

    Rows are told apart by a written number, so ids may repeat or be missing; rows without near copies all stay.
    """
    row = F.struct(*docs.columns).alias("row")  # one column, so that no name can clash
    numbered = materialise(docs.select(row, F.monotonically_increasing_id().alias("number")), "numbered")
    texts = numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))
    classes = nearcopies.near_copies(texts, counted=False).where("n_links > 0").select(F.col("doc_id").alias("number"), "class_id")
    linked = materialise(classes.join(numbered.select("number", F.col("row.doc_id").alias("doc_id"), F.xxhash64("row.text").alias("hash")), "number"), "linked")
    first = linked.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "number")).alias("first")).select(F.col("first.number").alias("number"))
    others = materialise(linked.select("number").join(first, "number", "left_anti"), "copies")  # a table: its size is known before the documents are joined
    return numbered.join(others, "number", "left_anti").select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return personal.masked(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_join),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("packing", packing_order),
]

#: Tokenising, hashed n-grams and the curve have no SQL form; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.split()[0].lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
