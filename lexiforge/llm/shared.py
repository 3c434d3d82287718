"""Where intermediate tables go, and small plan helpers that several operators use."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.session import materialise, scratch_path, ship

__all__ = ["arrow_map", "by_ranges", "exchanged", "join_rules", "materialise", "null_safe", "plan_bytes", "salted_join", "scratch_path"]


BATCH_ROWS = 1000  # of an Arrow batch of texts, where the session has Spark's default of 10,000


def tidy(f: Callable) -> Callable:
    """f, after which the worker gives the memory of its batches back instead of keeping it while idle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except OSError:  # another C library
            pass

    return run


def arrow_map(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """df.mapInArrow(f, schema) with the package at hand, bounded batches and memory given back."""
    spark = df.sparkSession
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(tidy(f), schema)


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of the tables below df as the optimizer knows them; None where it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 60 else None  # Spark's default for an unknown size is 2**63


def by_ranges(df: DataFrame, size: int | None, *keys: str, range_bytes: int = 16 << 20) -> DataFrame:
    """df in ranges of ``keys``, sorted within: one range for each ``range_bytes`` of ``size``, more on idle cores."""
    if size is None:
        return df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    cores = df.sparkSession.sparkContext.defaultParallelism
    n = max(math.ceil(size / range_bytes), min(cores, math.ceil(size / (1 << 20))), 1)
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys meet; the right side's keys are dropped."""
    renamed = right
    cond = None
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_r_{k}")
        c = left[k].eqNullSafe(renamed[f"_r_{k}"])
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def exchanged(table: DataFrame) -> DataFrame:
    """table, to be joined by an exchange however small Spark takes it to be: what is broadcast is built in the driver's memory.

    For tables that grow with the input. Spark goes by files and exchanges, which are compressed and hold a row once before
    it is salted: in memory it is many times as large.
    """
    return table.hint("merge")


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    """Equi-join with a table of distinct keys, each of which many of rows may hold: these are dealt to ``salts`` tasks. No broadcast."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int"))
    return dealt.join(exchanged(table.withColumn("_salt", F.explode(F.array(*map(F.lit, range(salts)))))), [*keys, "_salt"], how).drop("_salt")


#: Rule tables up to so many rows are sent to every executor; larger ones are joined by an exchange with salted keys.
MOST_SENT, SALTS = 20_000, 16


def join_rules(rows: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """rows with the columns of rules, one rule a key (nulls meet). A hot key is never dealt to one task.

    rules should be cheap to count. Keys without a rule are dropped.
    """
    if rules.count() <= MOST_SENT:
        return null_safe(rows, F.broadcast(rules), [key], "inner")  # counted just now
    salted = rules.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind]), F.lit(SALTS)).cast("int"))
    return null_safe(dealt, salted, [key, "_salt"], "inner").drop("_salt")
