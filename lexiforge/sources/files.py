"""Readers: files as rows, and text out of HTML, Markdown and plain text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.functions.text import WS, clean
from lexiforge.session import ship

EXTENSIONS = ("pdf", "html", "htm", "md", "txt")


def discover(spark: SparkSession, folder: str, extensions: Iterable[str] = EXTENSIONS) -> DataFrame:
    """path, suffix, length, content of the files below a folder, the suffix in any case."""
    listed = ",".join(sorted({x for e in extensions for x in (e, e.upper(), e.capitalize())}))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{listed}}}").load(folder)
    return files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), "length", "content")


def decoded(content: Column) -> Column:
    """UTF-8 text; invalid bytes are dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def _without(html: Column, tags: Iterable[str]) -> Column:
    for tag in tags:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*+>.*?</{tag}\s*>", " ")
    return html


#: Character references that pages commonly use.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&"))


def entities(text: Column) -> Column:
    for name, sign in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


def html_text(html: Column, keep_lines: bool = False) -> Column:
    """Text nodes without scripts, styles, navigation and footers; one line, or one a text node."""
    bare = F.regexp_replace(F.regexp_replace(_without(html, ("script", "style", "nav", "footer")), r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*+>", "\n")
    text = entities(bare)
    if keep_lines:
        lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, WS + "+", " "))), lambda x: x != "")
        return F.array_join(lines, "\n")
    return clean(text)


def html_text_v1(html: Column) -> Column:
    """First generation: only scripts and styles go; lines are trimmed, parted at two spaces and joined by one."""
    bare = entities(F.regexp_replace(_without(html, ("script", "style")), r"(?s)<[^>]*+>", ""))
    parts = F.flatten(F.transform(F.split(bare, r"\r\n|[\n\r]"), lambda line: F.split(F.trim(line), "  ")))
    return F.array_join(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), " ")


def markdown_text(text: Column) -> Column:
    """Without code, images and emphasis; links as their text."""
    for pattern, new in ((r"(?s)```.*?```", ""), (r"`[^`]+`", ""), (r"!\[.*?\]\(.*?\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"[*_~]+", "")):
        text = F.regexp_replace(text, pattern, new)
    return text


def markdown_plain(text: Column) -> Column:
    """As markdown_text, also without heading marks, bullets, numbers of lists and blank lines."""
    text = markdown_text(text)
    for pattern in (r"(?m)^#+\s+", r"(?m)^[-*+]\s+", r"(?m)^\d+\.\s+"):
        text = F.regexp_replace(text, pattern, "")
    return F.array_join(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")


def headings(html: Column) -> Column:
    """array<struct<level, title>> of h1 to h6 in order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])\b[^>]*+>(.*?)</h[1-6]\s*>"), F.lit(0))
    return F.transform(found, lambda h: F.struct(F.regexp_extract(h, r"(?i)<h([1-6])", 1).cast("int").alias("level"), clean(entities(F.regexp_replace(h, r"(?s)<[^>]*+>", " "))).alias("title")))


def pages_by(parser: Callable[[bytes], list[str]], files: DataFrame, original_numbers: bool = False) -> DataFrame:
    """path, page_id, text by a parser of whole files (such as one for PDF); blank pages are dropped before or after numbering."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                pages = list(enumerate(parser(bytes(content)), 1))
                kept = [(i, t) for i, t in pages if t.strip()]
                rows += [(path, i if original_numbers else n, t) for n, (i, t) in enumerate(kept, 1)]
            yield pd.DataFrame(rows, columns=["path", "page_id", "text"])

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "path string, page_id int, text string")


def read_pages(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """path, page_id, text of all files: HTML, Markdown and plain text natively, other suffixes by the given parsers."""
    files = discover(spark, folder)
    text = decoded(F.col("content"))
    whole = F.when(F.col("suffix").isin("html", "htm"), html_text(text)).when(F.col("suffix") == "md", markdown_text(text)).otherwise(text)
    out = files.where(F.col("suffix").isin("html", "htm", "md", "txt")).select("path", F.lit(1).alias("page_id"), whole.alias("text")).where(F.trim("text") != "")
    for suffix, parser in (parsers or {}).items():
        out = out.unionByName(pages_by(parser, files.where(F.col("suffix") == suffix)))
    return out
