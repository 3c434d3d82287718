"""Writers: one table each, resumable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_index(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table of an index as Parquet below a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables that exist; missing ones are left out."""
    jvm = spark._jvm
    found = {}
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            found[name] = spark.read.parquet(f"{folder}/{name}")
    return found


def save_jsonl(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").json(folder)


def save_csv_each(df: DataFrame, folder: str, key: str) -> None:
    """One folder of CSV for each value of key."""
    df.write.mode("overwrite").option("header", True).partitionBy(key).csv(folder)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def append_batch(df: DataFrame, folder: str, key: str) -> None:
    """Appends the rows that the folder lacks: a stopped run goes on where it ended."""
    known = load_index(df.sparkSession, folder.rsplit("/", 1)[0], [folder.rsplit("/", 1)[1]]).values()
    for have in known:
        df = remaining(df, have, key)
    df.write.mode("append").parquet(folder)
