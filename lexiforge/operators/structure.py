"""Sections and chunkers. Order is a column; stateful chunkers are folds over a document's ordered pages.

A fold gathers one document's pages in a row, which its size bounds; nothing is gathered across documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.config import V1_SECTIONS, V2, Settings
from lexiforge.functions.text import WS, clean, section_type, sentences, words


def lines_of(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """path, page_id (from 1), text: each line of a text as a page."""
    return docs.select(F.col(id_column).alias("path"), F.posexplode(F.split("text", "\n")).alias("page_id", "text")).withColumn("page_id", F.col("page_id") + 1)


def page_sections(pages: DataFrame, cfg: Settings = V2) -> DataFrame:
    """pages (path, page_id, text) with section: the last header in a page's first lines, else that of the page before."""
    def pick(lines: Column) -> Column:
        headers = F.filter(F.slice(lines, 1, cfg.header_lines), lambda l: section_type(l).isNotNull())
        return F.regexp_replace(F.element_at(headers, -1), rf"^{WS}+|{WS}+$", "")

    header = F.transform(F.array(F.split("text", "\n")), lambda l: F.when(F.exists(F.slice(l, 1, cfg.header_lines), lambda x: section_type(x).isNotNull()), pick(l)))[0]
    carried = F.last(header, ignorenulls=True).over(Window.partitionBy("path").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0))
    return pages.withColumn("section", F.coalesce(carried, F.lit(cfg.first_section)))


def section_maps(sections: DataFrame) -> DataFrame:
    """path, section, pages: the ascending pages of each section."""
    return sections.groupBy("path", "section").agg(F.sort_array(F.collect_list("page_id")).alias("pages"))


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 0) -> DataFrame:
    """doc_id, pos, chunk: slices of ``size`` characters, trimmed, empty ones dropped."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(step))
    cut = docs.where(F.length("text") > 0).select("doc_id", "text", F.posexplode(starts).alias("pos", "start"))
    return cut.select("doc_id", "pos", F.trim(F.substr("text", F.col("start") + 1, F.lit(size))).alias("chunk")).where("chunk <> ''")


_CHUNKS = "array<struct<text:string,pages:array<int>,section:string>>"


def _chunk(a: Column) -> Column:
    return F.struct(a["cur"].alias("text"), a["pages"].alias("pages"), a["section"].alias("section"))


def _emit(a: Column, ok: Column) -> Column:
    return F.when((a["cur"] != "") & ok, F.concat(a["out"], F.array(_chunk(a)))).otherwise(a["out"])


def _state(cur: Column, pages: Column, section: Column, out: Column) -> Column:
    return F.struct(cur.alias("cur"), pages.alias("pages"), section.alias("section"), out.alias("out"))


def _start(section: str | None) -> Column:
    return _state(F.lit(""), F.array().cast("array<int>"), F.lit(section).cast("string"), F.array().cast(_CHUNKS))


def _tail(a: Column, n: int, whole_if_short: bool = False) -> Column:
    return F.when(F.length(a["cur"]) > n, F.substring(a["cur"], -n, n)).otherwise(a["cur"] if whole_if_short else F.lit(""))


def _folded(ordered: DataFrame, fold) -> DataFrame:
    return ordered.select("path", F.posexplode(fold).alias("chunk_no", "_c")).select("path", "chunk_no", "_c.*")


def page_chunks(sections: DataFrame, cfg: Settings = V1_SECTIONS) -> DataFrame:
    """Pages (path, page_id, text, section) gathered up to the largest size; pages are never split.

    A change of section emits what has more than 100 characters and drops less; an overflow emits anything.
    """
    def step(a: Column, p: Column) -> Column:
        def add(b: Column) -> Column:
            page = F.concat(F.lit("\n[Page "), p["page_id"].cast("string"), F.lit("]\n"), p["text"])
            fits = F.length(b["cur"]) + F.length(p["text"]) <= cfg.max_chunk
            more = _state(F.concat(b["cur"], page), F.concat(b["pages"], F.array(p["page_id"])), p["section"], b["out"])
            full = _state(F.concat(_tail(b, cfg.chunk_overlap), page), F.array(p["page_id"]), p["section"], _emit(b, F.lit(True)))
            return F.when(fits, more).otherwise(full)

        turned = (a["section"].isNull() | (p["section"] != a["section"])) & (a["cur"] != "")
        begun = F.when(turned, _state(F.lit(""), F.array().cast("array<int>"), a["section"], _emit(a, F.length(a["cur"]) > 100))).otherwise(a)
        return F.transform(F.array(begun), add)[0]

    pages = F.array_sort(F.collect_list(F.struct("page_id", "text", "section")))
    ordered = sections.groupBy("path").agg(pages.alias("_p"))
    return _folded(ordered, F.aggregate("_p", _start(None), step, lambda a: _emit(a, F.length(a["cur"]) > 100)))


def hierarchical_chunks(sections: DataFrame, cfg: Settings = V2) -> DataFrame:
    """Pages split at sentences, gathered within a section up to the largest size with overlap, cleaned when emitted."""
    pieces = sections.select("path", "page_id", "section", F.posexplode(sentences(F.col("text"), cfg.chunk_size)).alias("piece", "text"))

    def step(a: Column, p: Column) -> Column:
        def add(b: Column) -> Column:
            fits = F.length(b["cur"]) + F.length(p["text"]) <= cfg.max_chunk
            marked = F.concat(b["cur"], F.lit("\n[Page "), p["page_id"].cast("string"), F.lit("]\n"), p["text"])
            more = _state(F.when(b["cur"] != "", marked).otherwise(p["text"]), F.array_union(b["pages"], F.array(p["page_id"])), p["section"], b["out"])
            full = _state(F.concat(_tail(b, cfg.chunk_overlap), p["text"]), F.array(p["page_id"]), p["section"], _emit(b, F.length(b["cur"]) >= cfg.min_chunk))
            return F.when(fits, more).otherwise(full)

        turned = (a["section"].isNull() | (p["section"] != a["section"])) & (a["cur"] != "")
        begun = F.when(turned, _state(F.lit(""), F.array().cast("array<int>"), a["section"], _emit(a, F.length(a["cur"]) >= cfg.min_chunk))).otherwise(a)
        return F.transform(F.array(begun), add)[0]

    ordered = pieces.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page_id", "piece", "text", "section"))).alias("_p"))
    raw = _folded(ordered, F.aggregate("_p", _start(None), step, lambda a: _emit(a, F.length(a["cur"]) >= cfg.min_chunk)))
    counts = raw.withColumn("char_count", F.length("text")).withColumn("word_count", F.size(words(F.col("text"))))
    named = counts.withColumn("chunk_id", F.format_string("%s_chunk_%d", F.col("path").cast("string"), F.col("chunk_no")))
    return named.withColumn("page_start", F.array_min("pages")).withColumn("page_end", F.array_max("pages")).withColumn("text", clean(F.col("text")))


def element_chunks(elements: DataFrame, cfg: Settings = V2) -> DataFrame:
    """Layout elements (path, ord, element_type, content, page_number): tables alone, headings flush, overlap after a full chunk."""
    def step(a: Column, e: Column) -> Column:
        enough = F.length(a["cur"]) >= cfg.min_chunk
        none = F.array().cast("array<int>")
        flushed = F.when((a["cur"] != "") & enough, _state(F.lit(""), none, a["section"], _emit(a, F.lit(True)))).otherwise(a)
        table = F.struct(e["content"].alias("text"), F.array(e["page_number"]).alias("pages"), a["section"].alias("section"))

        def with_table(b: Column) -> Column:
            return _state(b["cur"], b["pages"], b["section"], F.concat(b["out"], F.array(table)))

        def with_text(b: Column) -> Column:
            section = F.when(e["element_type"] == "heading", e["content"]).otherwise(b["section"])
            over = F.length(b["cur"]) + F.length(e["content"]) + 1 > cfg.max_chunk
            tail = _tail(b, cfg.chunk_overlap, True)
            fresh = _state(F.when(tail != "", F.concat(tail, F.lit("\n"), e["content"])).otherwise(e["content"]), F.array(e["page_number"]), section, _emit(_state(b["cur"], b["pages"], section, b["out"]), F.length(b["cur"]) >= cfg.min_chunk))
            grown = _state(F.when(b["cur"] != "", F.concat(b["cur"], F.lit("\n"), e["content"])).otherwise(e["content"]), F.array_union(b["pages"], F.array(e["page_number"])), section, b["out"])

            def cut(c: Column) -> Column:
                return F.when(F.length(c["cur"]) >= cfg.chunk_size, _state(_tail(c, cfg.chunk_overlap, True), F.array(e["page_number"]), c["section"], _emit(c, F.lit(True)))).otherwise(c)

            return F.transform(F.array(F.when(over, fresh).otherwise(grown)), cut)[0]

        kind = e["element_type"]
        begun = F.when(kind.isin("table", "heading"), flushed).otherwise(a)
        return F.transform(F.array(begun), lambda b: F.when(kind == "table", with_table(b)).otherwise(with_text(b)))[0]

    ordered = elements.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ord", "element_type", "content", "page_number"))).alias("_p"))
    return _folded(ordered, F.aggregate("_p", _start(""), step, lambda a: _emit(a, F.length(a["cur"]) >= cfg.min_chunk)))


def merge_chunks(chunks: DataFrame, most: int = 3000) -> DataFrame:
    """Neighbouring chunks (path, chunk_no, text, pages, section) of one section merged while shorter than ``most`` together."""
    def step(a: Column, c: Column) -> Column:
        last = F.element_at(a, -1)
        joined = F.struct(F.concat(last["text"], F.lit("\n"), c["text"]).alias("text"), F.array_sort(F.array_union(last["pages"], c["pages"])).alias("pages"), last["section"].alias("section"))
        alone = F.concat(a, F.array(F.struct(c["text"], c["pages"], c["section"])))
        fits = (F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["section"] == c["section"]) & (F.length(F.try_element_at(a, F.lit(-1))["text"]) + F.length(c["text"]) < most)
        return F.when(fits, F.concat(F.slice(a, 1, F.size(a) - 1), F.array(joined))).otherwise(alone)

    ordered = chunks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "text", "pages", "section"))).alias("_p"))
    return _folded(ordered, F.aggregate("_p", F.array().cast(_CHUNKS), step))


def carried_sections(elements: DataFrame) -> DataFrame:
    """Layout elements with the heading that they stand under."""
    heading = F.last(F.when(F.col("element_type") == "heading", F.col("content")), ignorenulls=True)
    return elements.withColumn("section", F.coalesce(heading.over(Window.partitionBy("path").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))


def document_summary(docs: DataFrame) -> DataFrame:
    """doc_id, summary: title, vendor, version, specification, topics, sections and the first 1000 characters, one a line."""
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    return docs.select("doc_id", F.concat_ws("\n", part("Title", F.col("title")), part("Vendor", F.col("vendor")), part("Version", F.col("version")), part("Specification", F.col("spec_number")), part("Topics", F.array_join("topics", ", ")), part("Sections", F.array_join(F.slice("sections", 1, 20), "; ")), part("Content preview", F.substring("text", 1, 1000))).alias("summary"))
