"""Metadata of a path and of a text, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions import patterns as P
from lexiforge.functions.text import all_of, bind, first_of

HEAD = 5000  # characters of a text in which vendor and topics are looked for


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    """The file name without its last suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def vendor(text: Column) -> Column:
    return first_of(F.lower(text), P.VENDORS)


def doc_type(text: Column) -> Column:
    return first_of(F.lower(text), P.DOC_TYPES)


def topics(text: Column) -> Column:
    return all_of(F.lower(text), P.TOPICS)


def version(name: Column) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(F.lower(name), p, 1), F.lit("")) for p in P.VERSIONS])


def release(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(path), r"rel[ease]*[-_]?(\d{1,2})", 1), F.lit("")).try_cast("int")


def series(path: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(path), r"(\d{2})[-_]?series", 1), F.lit(""))


def title(text: Column) -> Column:
    """A first heading with number signs, or a line that is underlined, within the first 1000 characters."""
    head = F.substring(text, 1, 1000)
    marked = F.regexp_extract(head, r"(?m)^#\s*(.+)$", 1)
    under = F.regexp_extract(head, r"(?m)^(.+)\n[=\-]{3,}", 1)
    return F.nullif(F.trim(F.when(marked != "", marked).otherwise(under)), F.lit(""))


def spec_number(text: Column) -> Column:
    """TS or TR and its number; case is ignored."""
    head = F.upper(F.substring(text, 1, HEAD))
    number = F.regexp_extract(head, r"(TS|TR)\s*(\d{2}\.\d{3})", 2)
    return F.when(number != "", F.concat(F.regexp_extract(head, r"(TS|TR)\s*(\d{2}\.\d{3})", 1), F.lit(" "), number))


def version_score(path: Column) -> Column:
    """The largest score over the version families; 0 without a version. Families share one scale."""
    def value(part: Column, w: int | None) -> Column:
        return F.ascii(F.upper(part)).cast("long") if w is None else F.coalesce(part.try_cast("long"), F.lit(0)) * w

    def family_score(low: Column, pattern: str, worth: tuple) -> Column:
        def one(m: Column) -> Column:
            return reduce(lambda a, b: a + b, [value(F.regexp_extract(m, pattern, g), w) for g, w in enumerate(worth, 1)])

        return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)), one)), F.lit(0).cast("long"))

    def best(low: Column) -> Column:
        return F.greatest(*[family_score(low, p, worth) for p, worth in P.VERSION_SCORES])

    return bind(F.lower(path), best)


def family(path: Column) -> Column:
    """The stem without versions, its separators as single underscores."""
    bare = reduce(lambda t, row: F.regexp_replace(t, row[0], ""), P.VERSION_SCORES, F.lower(stem(path)))
    return F.regexp_replace(F.regexp_replace(bare, r"[-_\s]+", "_"), r"^_+|_+$", "")


def delimited_version(name: Column) -> Column:
    """struct<version, base> by the first delimited pattern that matches."""
    plain = F.struct(F.lit("0").alias("version"), F.lower(F.regexp_replace(name, r"[_\-]+$", "")).alias("base"))
    pick = plain
    for p in reversed(P.DELIMITED_VERSIONS):
        found = F.regexp_extract(F.lower(name), p, 1)
        base = F.lower(F.regexp_replace(F.regexp_replace(name, "(?i)" + p, ""), r"[_\-]+$", ""))
        pick = F.when(found != "", F.struct(found.alias("version"), base.alias("base"))).otherwise(pick)
    return pick


def version_parts(version: Column) -> Column:
    """Numbers of a version, for comparison as arrays."""
    return F.transform(F.split(version, r"[.\-_]"), lambda p: F.coalesce(p.try_cast("long"), F.lit(0).cast("long")))


def document_id(vendor_: Column, spec: Column, version_: Column, path: Column) -> Column:
    parts = F.concat_ws("_", vendor_, F.replace(spec, F.lit(" "), F.lit("")), F.when(version_.isNotNull(), F.concat(F.lit("v"), version_)))
    return F.lower(F.when(parts == "", stem(path)).otherwise(parts))
