"""Mixing sources to target weights by hash-threshold histograms.

Every row has a 60-bit hash of its doc_id and text. Words are summed by source and hash bucket (10 bits at a time); the
bucket in which a source's budget runs out is the only one that is split further, six times at most, and a source's rows are
then taken or left by comparing their hash with its threshold: no sort of rows, and a larger budget takes a superset.

A source whose target exceeds its size takes every row ``repeats`` times and the rest by threshold. On the threshold stand
one row or several equal ones; of these as many are taken as fit, to the nearest, so a source misses its target by half a
row at most, whatever its doc_ids. Which of equal rows these are is open, so a second run gives the same rows.

Null text has no words; a null source comes last; doc_ids may be null or repeated; a text of any length counts whole. An
empty table gives no rows. Extra columns are ignored by ``mix`` and kept by ``mixed``, whatever their names. One row a source
goes through windows of a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiforge.llm.shared import join_rules, materialise, null_safe

WEIGHTS = (5, 2, 1)
MOST = 3
HASH_BITS, LEVEL_BITS = 60, 10


def n_words(text: str = "text"):
    """Runs of characters other than space and \\t \\n \\v \\f \\r."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def row_hash(doc_id: str = "doc_id", text: str = "text"):
    whole = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from sizes (source, size). One row a source goes through its windows.

    Shares are raised together like water until all is poured: a source stops at ``most`` times its size.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("limit", most * F.col("source_size")).withColumn("fills_at", F.col("limit") / F.col("weight"))
    filling = Window.orderBy("fills_at", F.asc_nulls_last("source"))
    before, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "source", "level"))).over(whole)["level"])
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit").cast("double")))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, repeats, last_hash, edge_hash, edge_rows, edge_take.

    A row is taken repeats times, once more up to last_hash; of the edge_rows rows with edge_hash edge_take are. sizes:
    source, size, hash. Each level reads the rows of one bucket a source.
    """
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budgets = materialise(targets(sizes, weights, most).withColumn("repeats", full), "budgets")
    state = budgets.select("source", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("_left"), F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_before"))
    kept = ["source", "_left", "_before"]
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        open_rows = join_rules(sizes, state, "source").where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("_prefix"))
        sums = open_rows.groupBy(*kept, F.shiftright("hash", shift).alias("_bucket")).agg(F.sum("size").alias("_words"), F.count("*").alias("_rows"))
        run = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("_before") + F.coalesce(F.sum("_words").over(run), F.lit(0))
        sums = sums.withColumn("_start", start)
        holds = (F.col("_start") <= F.col("_left")) & (F.col("_start") + F.col("_words") > F.col("_left"))
        if shift:
            state = materialise(sums.where(holds).groupBy("source", "_left").agg(F.min("_bucket").alias("_prefix"), F.min_by("_start", "_bucket").alias("_before")), "level")
        else:
            whole = F.max(F.when(F.col("_start") + F.col("_words") <= F.col("_left"), F.col("_bucket")))
            take = F.floor((F.col("_left") - F.col("_start")) * F.col("_rows") / F.col("_words") + 0.5)
            edge = F.min(F.when(holds, F.struct(F.col("_bucket").alias("hash"), F.col("_rows").alias("rows"), take.cast("long").alias("take"))))
            state = sums.groupBy("source").agg(F.coalesce(whole, F.min("_bucket") - 1).alias("last_hash"), edge.alias("_edge"))
            state = state.select("source", "last_hash", *[F.col(f"_edge.{c}").alias(f"edge_{c}") for c in ("hash", "rows", "take")])
    return null_safe(budgets, state, ["source"], "left").withColumn("last_hash", F.coalesce("last_hash", F.lit(-1).cast("long")))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words().alias("size"), row_hash().alias("hash"))


def with_times(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """rows (source, hash, ...) with the columns of rules and times: how often the mix takes each row.

    Equal rows on a threshold are numbered within the tasks that read them, after the rows of the tasks before.
    """
    ruled = join_rules(rows, rules, "source")
    sure = F.col("repeats") + (F.col("hash") <= F.col("last_hash")).cast("long")
    if rules.where("edge_rows > 1").isEmpty():
        return ruled.withColumn("times", sure + F.coalesce((F.col("hash") == F.col("edge_hash")) & (F.col("edge_take") > 0), F.lit(False)).cast("long"))
    edge = F.coalesce(F.col("hash") == F.col("edge_hash"), F.lit(False))
    numbered = materialise(ruled.where(edge).select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_n")), "edge")
    before = Window.partitionBy("source").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = numbered.groupBy("source", "_task").count().withColumn("_earlier", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    place = F.row_number().over(Window.partitionBy("source", "_task").orderBy("_n")) + F.col("_earlier")
    taken = null_safe(numbered, tasks, ["source", "_task"], "inner").withColumn("times", sure + (place <= F.col("edge_take")).cast("long"))
    return ruled.where(~edge).withColumn("times", sure).unionByName(taken.drop("_task", "_n", "_earlier"))


def rules_for(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    return materialise(thresholds(sizes, weights, most), "rules")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for each row of docs (doc_id, source, text)."""
    sizes = materialise(sized(docs), "mixing")
    timed = with_times(sizes, rules_for(sizes, weights, most))
    return timed.select("doc_id", "source", "size", "source_size", "target", "times").withColumn("taken", F.col("size") * F.col("times"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """docs as the mix takes them: rows that it takes more than once are repeated, others are left out."""
    sizes = materialise(sized(docs), "mixing")
    rules = rules_for(sizes, weights, most).select("source", "repeats", "last_hash", "edge_hash", "edge_rows", "edge_take")
    packed = docs.select("source", row_hash().alias("hash"), F.struct(*docs.columns).alias("row"))
    timed = with_times(packed, rules).where("times > 0")
    return timed.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


#: DuckDB SQL for the same rows: budgets by an ordered running sum where the operator uses histograms.
ORACLE = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS hash
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM sizes GROUP BY source),
rising AS (
  SELECT *, 3 * source_size AS most, (3 * source_size) / CAST(weight AS DOUBLE) AS fills_at FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY fills_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM rising),
aims AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), coalesce((SELECT min_by(level, fills_at) FROM levels WHERE level <= fills_at) * weight, CAST(most AS DOUBLE))) AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM aims),
placed AS (
  SELECT doc_id, source, size, hash, row_number() OVER (PARTITION BY source, hash) AS place, count(*) OVER (PARTITION BY source, hash) AS n,
         sum(size) OVER (PARTITION BY source ORDER BY hash) AS upto, sum(size) OVER (PARTITION BY source, hash) AS words FROM sizes)
SELECT s.doc_id, s.size, b.source_size, b.target,
       CAST(s.size * (b.repeats + CASE WHEN s.upto <= b.target - b.repeats * b.source_size THEN 1
         WHEN s.upto - s.words > b.target - b.repeats * b.source_size THEN 0
         WHEN s.place <= floor((b.target - b.repeats * b.source_size - s.upto + s.words) * s.n / s.words + 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
"""
