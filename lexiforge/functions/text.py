r"""String functions: Column in, Column out, no UDFs.

White space is the ASCII class; a word character is [\p{L}\p{N}_]. Patterns that use \b run over a text in which other
letters and digits became "__" and other signs became spaces, so that boundaries mean the same for every engine.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions import patterns as P

WS = r"[\x09-\x0D\x20]"


def bind(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.transform(F.array(value), body)[0]


def normalise(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), WS + "+", " "))


def clean(text: Column) -> Column:
    """White space collapsed, control characters dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, WS + "+", " "), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]", ""))


def similarity_form(text: Column) -> Column:
    """normalise(), then everything but word characters, white space, - and . deleted."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), WS + "+", " "), r"[^\p{L}\p{N}_\x09-\x0D\x20\-.]", ""))


def words(text: Column) -> Column:
    """Non-empty runs between white space."""
    return F.filter(F.split(text, WS + "+"), lambda w: w != "")


def md5_key(text: Column) -> Column:
    return F.md5(normalise(text))


def sha_key(text: Column, form=normalise) -> Column:
    return F.substring(F.sha2(form(text), 256), 1, 32)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k words of normalise(text); the whole string if there are fewer words."""
    def made(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return bind(words(normalise(text)), made)


def plain(text: Column) -> Column:
    """ASCII only: other letters and digits as "__", other signs as spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}\x00-\x7F]", " "), r"[^\x00-\x7F]", "__")


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def joined_terms() -> list[str]:
    """The telecom patterns: each one that holds a class or a repetition alone, plain words as one alternation.

    Two plain words never match at the same place, and a word within another one has a pattern of its own.
    """
    plain_word = re.compile(r"\\b[A-Za-z0-9]+\\b")
    alone = [p for p in P.TELECOM if not plain_word.fullmatch(p)]
    return [*alone, r"\b(?:" + "|".join(p[2:-2] for p in P.TELECOM if p not in alone) + r")\b"]


def telecom_terms(ascii_text: Column) -> Column:
    """Matches of each pattern. Those that need a digit run only over texts that hold one."""
    def found(patterns: list[str]) -> Column:
        return F.flatten(F.array(*[all_matches(ascii_text, "(?i)" + p) for p in patterns]))

    terms = joined_terms()
    numbered = [p for p in terms[:-1] if r"\d" in p or "5G" in p or "[1-5]" in p]
    digits = F.when(F.rlike(ascii_text, F.lit("[0-9]")), found(numbered)).otherwise(F.array().cast("array<string>"))
    return F.concat(digits, found([p for p in terms if p not in numbered]))


def bm25_tokens(text: Column) -> Column:
    """Distinct tokens of at least two characters, protected terms after the others."""
    def made(low: Column) -> Column:
        split = words(F.regexp_replace(low, r"[^\p{L}\p{N}_\x09-\x0D\x20\-.]", " "))
        return F.array_distinct(F.filter(F.concat(split, bind(plain(low), telecom_terms)), lambda t: (F.length(t) >= 2) | t.isin(*P.SHORT)))

    return bind(F.lower(text), made)


def keywords(text: Column) -> Column:
    """Upper-case distinct keywords: telecom terms, words of three or more capitals, quoted terms over two characters, versions."""
    def made(t: Column) -> Column:
        quoted = F.filter(all_matches(text, r'"([^"]+)"', 1), lambda q: F.length(q) > 2)
        found = F.concat(telecom_terms(t), all_matches(t, r"\b[A-Z]{3,}\b"), quoted, all_matches(t, r"(?i)\bv?\d+\.\d+(?:\.\d+)*\b"))
        return F.array_sort(F.array_distinct(F.transform(found, F.upper)))

    return bind(plain(text), made)


def phrases(text: Column, listed: tuple[str, ...] = P.PHRASES) -> Column:
    """Listed phrases that occur, in the list's order, then titles that end a line with a colon."""
    known = F.array(*map(F.lit, listed))
    listed = bind(F.lower(text), lambda low: F.filter(known, lambda p: F.contains(low, p)))
    titles = F.transform(all_matches(text, r"(?m)^([A-Za-z][^:]{5,50}):$", 1), lambda t: F.trim(F.lower(t)))
    return F.concat(listed, titles)


def either(patterns) -> str:
    """One pattern for any of several; one alone stays as it is."""
    return patterns if isinstance(patterns, str) else "|".join(patterns)


def first_of(text: Column, table) -> Column:
    """Label of the first row (label, pattern or patterns) that is found in text."""
    return reduce(lambda rest, row: F.when(F.rlike(text, F.lit(either(row[1]))), F.lit(row[0])).otherwise(rest), reversed(table), F.lit(None).cast("string"))


def all_of(text: Column, table) -> Column:
    return F.array_compact(F.array(*[F.when(F.rlike(text, F.lit(either(p))), F.lit(label)) for label, p in table]))


def section_type(line: Column) -> Column:
    return first_of(F.trim(F.regexp_replace(line, rf"^{WS}+|{WS}+$", "")), P.SECTIONS)


def header_v1(line: Column) -> Column:
    """First generation: a dotted number and a title, or capitals of three words."""
    t = F.regexp_replace(line, rf"^{WS}+|{WS}+$", "")
    return F.rlike(t, F.lit(r"^\d+\.[\d.]+\s+.{3,}")) | (F.rlike(t, F.lit(r"^[A-Z][A-Z\s]{10,}$")) & (F.size(words(t)) >= 3))


def sentences(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters: whole sentences packed greedily, longer ones cut."""
    def add(a: Column, s: Column) -> Column:
        fits = F.length(a["cur"]) + F.length(s) <= most
        flushed = F.when(a["cur"] != "", F.concat(a["out"], F.array(F.trim(a["cur"])))).otherwise(a["out"])
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / most).cast("int")), lambda i: F.substr(s, i * most + 1, F.lit(most)))
        grown = F.when(a["cur"] != "", F.concat(a["cur"], F.lit(" "), s)).otherwise(s)
        return (
            F.when(fits, F.struct(grown.alias("cur"), a["out"].alias("out")))
            .when(F.length(s) > most, F.struct(F.lit("").alias("cur"), F.concat(flushed, cut).alias("out")))
            .otherwise(F.struct(s.alias("cur"), flushed.alias("out")))
        )

    start = F.struct(F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))
    packed = F.aggregate(F.split(text, rf"(?<=[.!?]){WS}+"), start, add, lambda a: F.when(a["cur"] != "", F.concat(a["out"], F.array(F.trim(a["cur"])))).otherwise(a["out"]))
    return F.when(F.length(text) <= most, F.array(text)).otherwise(packed)


def quoted_terms(text: Column) -> Column:
    return all_matches(text, r'"([^"]+)"', 1)


def technical_ids(text: Column) -> Column:
    return all_matches(plain(text), r"\b[A-Za-z]{2,10}\d{2,10}\b|\b\d{2,10}[A-Za-z]{2,10}\b")


def query_phrases(text: Column) -> Column:
    """Runs of four, three, two words with one that is no stop word; the whole question if it has three to ten words."""
    def made(w: Column) -> Column:
        def runs(n: int) -> Column:
            every = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.slice(w, i, n))
            told = F.filter(every, lambda r: F.exists(r, lambda x: ~x.isin(*P.QUERY_STOP)))
            return F.when(F.size(w) >= n, F.transform(told, lambda r: F.array_join(r, " "))).otherwise(F.array().cast("array<string>"))

        whole = F.when(F.size(w).between(3, 10), F.array(F.lower(text))).otherwise(F.array().cast("array<string>"))
        return F.concat(runs(4), runs(3), runs(2), whole)

    return bind(words(F.lower(text)), made)


def expansions(text: Column) -> Column:
    """The question and at most four variants with a listed term replaced."""
    low = F.lower(text)
    made = [F.when(F.contains(low, F.lit(key)) & ~F.contains(low, F.lit(s)), F.replace(low, F.lit(key), F.lit(s))) for key, options in P.SYNONYMS for s in options]
    return F.slice(F.concat(F.array(low), F.array_compact(F.array(*made))), 1, 5)


def query_ids(text: Column) -> Column:
    """array<struct<term, type, priority>>: identifiers of the upper-cased question, then its capitalised words."""
    up, ascii_text = F.upper(plain(text)), plain(text)

    def of(found: Column, kind: str, priority: float) -> Column:
        return F.transform(found, lambda m: F.struct(F.upper(m).alias("term"), F.lit(kind).alias("type"), F.lit(priority).alias("priority")))

    return F.concat(*[of(all_matches(up, p), kind, 1.0) for p, kind in P.QUERY_IDS], of(all_matches(ascii_text, r"\b[A-Z][A-Za-z]{3,}\b"), "term", 0.8))


def continues(text: Column, by_token: bool = False) -> Column:
    """A short question with a pronoun in it, or a listed word among its first five. by_token: pronouns as whole words."""
    def made(w: Column) -> Column:
        pronoun = F.exists(w, lambda x: x.isin(*P.PRONOUNS)) if by_token else reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in P.PRONOUNS])
        return ((F.size(w) < 4) & pronoun) | F.exists(F.slice(w, 1, 5), lambda x: x.isin(*P.CONTINUATION))

    return bind(words(F.lower(text)), made)


def continues_v2(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(p)) for p in P.CONTINUATION_PARTS])


def section_request(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(F.lower(text), p, 1), F.lit("")) for p in P.SECTION_REQUESTS]
    return F.coalesce(*found)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def truncate_to_tokens(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= 4 * n, text).otherwise(F.concat(F.substring(text, 1, 4 * n), F.lit("...")))


def heading_level(text: Column) -> Column:
    """Number signs in front, or the parts of a leading number, at most 6."""
    marks = F.length(F.regexp_extract(text, r"^(#[^\s]*)", 1))
    number = F.regexp_extract(text, r"^(\d+(?:\.\d+)*)\s", 1)
    return F.when(marks > 0, F.least(marks, F.lit(6))).when(number != "", F.least(F.regexp_count(number, F.lit(r"\.")) + 1, F.lit(6))).otherwise(F.lit(1))


def figure_references(text: Column) -> Column:
    """References to figures and images; figures are listed twice, as two of the three patterns find them."""
    figures, images = all_matches(text, r"(?i)(?:figure|fig\.?)\s*\d+(?:\.\d+)?"), all_matches(text, r"(?i)(?:image|img\.?)\s*\d+(?:\.\d+)?")
    return F.concat(figures, figures, images)


def table_text(caption: Column, headers: Column, rows: Column) -> Column:
    head = F.when(caption.isNotNull(), F.concat(F.lit("Table: "), caption))
    lines = F.transform(rows, lambda r: F.array_join(r, " | "))
    return F.concat_ws("\n", head, F.array_join(headers, " | "), F.lit("-" * 50), lines)


def image_text(caption: Column, alt: Column, ocr: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(name + ": "), c))
    return F.concat_ws("\n", part("Figure", caption), part("Description", alt), part("Content", ocr))


def safe_name(title: Column) -> Column:
    """A file name from a title: signs that file systems refuse become _, at most 150 characters."""
    return F.substring(F.regexp_replace(F.trim(title), r'[<>:"/\\|?*]', "_"), 1, 150)


def keywords_by_section(text: Column) -> Column:
    """Section-aware generation: patterns over upper-cased text (so every word of 3 to 15 letters), capitals, quoted terms.

    Words with letters beyond ASCII give none.
    """
    def made(t: Column) -> Column:
        quoted = F.transform(F.filter(quoted_terms(text), lambda q: F.length(q) > 2), F.upper)
        return F.array_sort(F.array_distinct(F.concat(*[F.transform(all_matches(t, "(?i)" + p), F.upper) for p in P.SECTION_KEYWORDS], quoted)))

    return bind(F.upper(plain(text)), made)


def keywords_first(text: Column) -> Column:
    """First generation: identifiers of the upper-cased text and its first ten capitalised words."""
    def made(t: Column) -> Column:
        capital = F.transform(F.slice(all_matches(t, r"\b[A-Z][A-Za-z]{3,}\b"), 1, 10), F.upper)
        return F.array_sort(F.array_distinct(F.concat(*[all_matches(F.upper(t), p) for p, _ in P.QUERY_IDS], capital)))

    return bind(plain(text), made)


def bm25_tokens_by_section(text: Column, distinct: bool = True) -> Column:
    """Section-aware generation's tokens; without ``distinct`` (for questions) repeats count."""
    def made(low: Column) -> Column:
        split = words(F.regexp_replace(low, r"[^\p{L}\p{N}_\x09-\x0D\x20\-.]", " "))
        every = F.filter(F.concat(split, *[all_matches(plain(low), p) for p in P.SECTION_TOKENS]), lambda t: F.length(t) >= 2)
        return F.array_distinct(every) if distinct else every

    return bind(F.lower(text), made)
