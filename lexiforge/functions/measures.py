"""Similarity measures and signatures, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def md5_long(text: Column) -> Column:
    """The first 64 bits of md5 as a signed bit pattern."""
    return F.conv(F.substring(F.md5(text), 1, 16), 16, -10).cast("long")


def simhash_of(hash_column: str) -> Column:
    """Aggregate: bit i is set if more hashes have it than not."""
    votes = [F.when(F.sum(F.when(F.col(hash_column).bitwiseAND(F.shiftleft(F.lit(1).cast("long"), i)) != 0, 1).otherwise(-1)) > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(64)]
    return reduce(lambda a, b: a.bitwiseOR(b), votes)


def hamming_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def agreement(a: Column, b: Column) -> Column:
    """Share of equal positions of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def combined(minhash: Column, simhash: Column, length_a: Column, length_b: Column) -> Column:
    """0.5 minhash + 0.3 simhash + 0.2 ratio of lengths."""
    return 0.5 * minhash + 0.3 * simhash + 0.2 * (F.least(length_a, length_b) / F.greatest(length_a, length_b, F.lit(1)))
