"""Noise pages, metadata filters and the newest version of each document family."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions import metadata as M
from lexiforge.functions import patterns as P
from lexiforge.functions.text import WS, words

MIN_CHARS, MIN_WORDS = 200, 30


def noise_reason(text: Column) -> Column:
    """Why a page is noise: too_short, few_words, pattern:..., toc_format; null for content."""
    low = F.regexp_replace(F.lower(text), rf"^{WS}+|{WS}+$", "")
    found = reduce(lambda rest, p: F.when(F.rlike(low, F.lit("(?m)" + p)), F.lit("pattern:" + p[:30])).otherwise(rest), reversed(P.NOISE), F.lit(None).cast("string"))
    lines = F.split(low, "\n")
    toc = F.size(F.filter(lines, lambda l: F.rlike(l, F.lit(r"^.*\.{3,}\s*\d+\s*$")))) > F.size(lines) * 0.5
    dense = F.regexp_count(low, F.lit(r"[.\d]")) / F.length(low) > 0.3
    rest = F.when(found.isNotNull(), found).when(dense & toc, F.lit("toc_format"))
    return F.when(F.length(low) < MIN_CHARS, F.lit("too_short")).when(F.size(words(low)) < MIN_WORDS, F.lit("few_words")).otherwise(rest)


def drop_noise(pages: DataFrame) -> DataFrame:
    """pages (path, page_id, text) without noise; page_id is counted anew within a path, orig_page is kept."""
    order = Window.partitionBy("path").orderBy("orig_page")
    kept = pages.withColumnRenamed("page_id", "orig_page").where(noise_reason(F.col("text")).isNull())
    return kept.withColumn("page_id", F.row_number().over(order))


def noise_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy(F.coalesce(noise_reason(F.col("text")), F.lit("kept")).alias("reason")).agg(F.count("*").alias("pages"))


def filter_metadata(docs: DataFrame, vendor: str | None = None, release: int | None = None, doc_type: str | None = None, topics: list[str] | None = None) -> DataFrame:
    """Rows whose metadata equal what is asked for; of topics any one suffices. A null never matches."""
    out = docs
    for name, value in (("vendor", vendor), ("release", release), ("doc_type", doc_type)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.where(F.arrays_overlap("topics", F.array(*map(F.lit, topics)))) if topics else out


def newest_versions(paths: DataFrame, score: Column | None = None, family: Column | None = None) -> DataFrame:
    """The row of paths (seq, path) with the largest version score in each family; ties keep the first."""
    scored = paths.withColumn("family", M.family(F.col("path")) if family is None else family).withColumn("version_score", M.version_score(F.col("path")) if score is None else score)
    best = Window.partitionBy("family").orderBy(F.desc("version_score"), "seq")
    return scored.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")


def newest_delimited(paths: DataFrame) -> DataFrame:
    """As newest_versions, by the delimited versions of stems, compared number by number."""
    named = paths.withColumn("_v", M.delimited_version(M.stem(F.col("path"))))
    best = Window.partitionBy("family").orderBy(F.desc("version_parts"), "seq")
    keyed = named.select("seq", "path", F.col("_v.base").alias("family"), M.version_parts(F.col("_v.version")).alias("version_parts"))
    return keyed.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").drop("_rn")
