"""From results to a prompt: budgets, formats, conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.config import V2

SEPARATOR = "\n\n---\n\n"


def pieces(results: DataFrame, cut: int = 2000) -> DataFrame:
    """results (query_id, rank, idx, text, source, pages, vendor, section, score) with piece: a header line and the text's start."""
    pages = F.when(F.size("pages") > 1, F.concat(F.element_at("pages", 1).cast("string"), F.lit("-"), F.element_at("pages", -1).cast("string"))).when(F.size("pages") == 1, F.element_at("pages", 1).cast("string")).otherwise(F.lit("N/A"))
    part = lambda name, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f" | {name}: "), F.col(c))).otherwise(F.lit(""))
    head = F.concat(F.format_string("[Document %d] ", F.col("rank")), F.coalesce("source", F.lit("unknown")), F.lit(" | Page: "), pages, part("Vendor", "vendor"), part("Section", "section"), F.lit(" | Score: "), F.format_string("%.3f", F.col("score")), F.lit("\n"))
    return results.withColumn("piece", F.concat(head, F.substring("text", 1, cut)))


def pieces_by_source(results: DataFrame, most: int = 5, cut: int = 2000) -> DataFrame:
    """The section-aware generation's pieces: of the first ``most`` results, with source, page, section and score in the header line."""
    pages = F.when(F.size("pages") > 0, F.concat(F.element_at("pages", 1).cast("string"), F.lit("-"), F.element_at("pages", -1).cast("string"))).otherwise(F.lit("N/A"))
    section = F.when(F.coalesce("section", F.lit("")) != "", F.concat(F.lit(" | Section: "), "section")).otherwise(F.lit(""))
    head = F.concat(F.format_string("[Document %d] Source: ", F.col("rank")), F.coalesce("source", F.lit("unknown")), F.lit(" | Page: "), pages, section, F.lit(" | Score: "), F.format_string("%.3f", F.col("score")), F.lit("\n"))
    return results.where(F.col("rank") <= most).withColumn("piece", F.concat(head, F.substring("text", 1, cut)))


def pieces_first(results: DataFrame) -> DataFrame:
    """The first generation's pieces: whole texts under source, page and score in brackets. page: the result's page."""
    head = F.concat(F.lit("["), "source", F.lit(" | page "), F.col("page").cast("string"), F.lit(" | score="), F.format_string("%.3f", F.col("score")), F.lit("]\n"))
    return results.withColumn("piece", F.concat(head, "text"))


def within_budget(numbered: DataFrame, max_tokens: int = V2.context_tokens) -> DataFrame:
    """Pieces (query_id, rank, piece) up to the first that would exceed four characters a token."""
    total = F.sum(F.length("piece")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("used", total).where(F.col("used") <= 4 * max_tokens)


def context(budgeted: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "piece")))
    return budgeted.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda p: p["piece"]), SEPARATOR).alias("context"))


def compressed_sections(results: DataFrame, per_section: int = 3, cut: int = 500) -> DataFrame:
    """query_id, section, text: what stands in for a summary by a model: the first chunks of each section, cut."""
    best = Window.partitionBy("query_id", "section").orderBy("rank")
    kept = results.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= per_section)
    line = F.concat(F.lit("["), F.coalesce("source", F.lit("unknown")), F.lit("]\n"), F.substring("text", 1, 1000), F.lit("\n"))
    joined = kept.groupBy("query_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "").alias("_t"))
    return joined.select("query_id", "section", F.substring(F.concat(F.lit("Section: "), "section", F.lit("\n"), "_t"), 1, cut).alias("text"))


def prompt_kind(vendor_filter: Column, vendors: Column) -> Column:
    return F.when(vendor_filter.isNotNull(), F.lit("vendor")).when(vendors > 1, F.lit("multi_vendor")).otherwise(F.lit("base"))


def last_turns(turns: DataFrame, n: int = 2, cut: int = 300) -> DataFrame:
    """The last n questions of each conversation (conv_id, turn, role, text) with the answer that follows, cut."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumn("answer", F.when(F.lead("role").over(order) == "assistant", F.substring(F.lead("text").over(order), 1, cut)))
    asked = paired.where("role = 'user'").withColumn("back", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return asked.where(F.col("back") <= n).select("conv_id", "turn", "back", F.col("text").alias("question"), "answer")


def enhanced_queries(turns: DataFrame, continues) -> DataFrame:
    """conv_id, turn, query: a question that continues the conversation is led by the question before it."""
    asked = turns.where("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return asked.select("conv_id", "turn", F.when(continues(F.col("text")) & before.isNotNull(), F.concat(before, F.lit(" "), "text")).otherwise(F.col("text")).alias("query"))
