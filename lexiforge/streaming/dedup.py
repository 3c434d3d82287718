"""A stream of documents without exact repeats, and near-duplicate registration by micro-batch. An extension: the pipeline is batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.functions import text as T
from lexiforge.operators import dedup as D


def first_arrivals(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """The first row of each normalised text; state is kept as long as the watermark allows a repeat."""
    return stream.withColumn("text_key", T.md5_key(F.col("text"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text_key"])


def counts_by_window(stream: DataFrame, time: str, key: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Rows of each key and window of event time; late rows beyond the delay are dropped."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def register(accepted_folder: str, threshold: float = 0.8) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: of a batch (idx, text) appends what is like nothing accepted before, in order of idx."""
    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(accepted_folder)
        known = spark.read.parquet(accepted_folder) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None
        rows = batch.select("idx", "text")
        every = rows if known is None else rows.unionByName(known.select("idx", "text"))
        pairs = D.jaccard_pairs(every, threshold).select("x", "y").unionByName(D.exact_duplicates(every).select(F.col("primary").alias("x"), F.col("idx").alias("y")))
        state = D.accept_in_order(every.select("idx"), pairs)
        fresh = rows.join(state.where("accepted").select("idx"), "idx", "left_semi")
        fresh = fresh if known is None else fresh.join(known.select("idx"), "idx", "left_anti")
        fresh.write.mode("append").parquet(accepted_folder)

    return run
