"""Tables and images of layout elements, and similar-item lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.functions.text import image_text
from lexiforge.schemas import STORED_LIMITS

MIN_IMAGE_TEXT = 50


def tables_of(elements: DataFrame) -> DataFrame:
    """path, index, page, content of the table elements, counted within a document."""
    order = Window.partitionBy("path").orderBy("ord")
    return elements.where("element_type = 'table'").select("path", (F.row_number().over(order) - 1).alias("index"), F.col("page_number").alias("page"), "content")


def distinct_images(images: DataFrame, least_pixels: int = 50) -> DataFrame:
    """Images (seq, hash, width, height, ...) without repeats of a hash; the first wins, small ones are dropped."""
    big = images.where((F.col("width") >= least_pixels) & (F.col("height") >= least_pixels))
    first = Window.partitionBy("hash").orderBy("seq")
    return big.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def image_index(images: DataFrame) -> DataFrame:
    """page, images, with_text, with_caption."""
    has = lambda c: F.count(F.when(F.coalesce(F.col(c), F.lit("")) != "", 1))
    return images.groupBy("page").agg(F.count("*").alias("images"), has("ocr_text").alias("with_text"), has("caption").alias("with_caption"))


def image_chunks(images: DataFrame) -> DataFrame:
    """path, page, text, chunk_type of images that have enough text to be searched."""
    text = image_text(F.col("caption"), F.col("alt_text"), F.col("ocr_text"))
    return images.select("path", "page", text.alias("text"), F.lit("image").alias("chunk_type")).where(F.length("text") >= MIN_IMAGE_TEXT)


def stored_rows(chunks: DataFrame) -> DataFrame:
    """Chunks cut to a vector store's lengths."""
    return chunks.select(*[F.substring(c, 1, STORED_LIMITS[c]).alias(c) if c in STORED_LIMITS else F.col(c) for c in chunks.columns])


def section_hierarchy(headings: DataFrame) -> DataFrame:
    """path, title, level, page of each title; a repeated title keeps its last place."""
    return headings.groupBy("path", "title").agg(F.max_by(F.struct("level", "page"), "ord").alias("_h")).select("path", "title", "_h.level", "_h.page")
