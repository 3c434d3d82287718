"""Sessions: tuned defaults, and the package for the executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(), f"{root.name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def java_function(spark: SparkSession, source: Path, name: str, kind: str) -> str | None:
    """Registers the Java class of the file ``source`` as a function of that name, on driver and executors; gives the name back.

    Spark's own compiler, Janino, makes the class, once a session. None where there is no JVM to ask (Spark Connect).
    """
    if not hasattr(spark, "_jvm"):
        return None
    full = f"{Path(__file__).resolve().parent.name}.{source.stem}"
    key = f"{spark.sparkContext.applicationId} {id(spark)} {full}"
    if key not in _shipped:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(source.read_text())
        path = os.path.join(tempfile.mkdtemp(), f"{source.stem}.jar")
        with zipfile.ZipFile(path, "w") as z:
            for k, code in compiler.getBytecodes().items():
                z.writestr(f"{k.replace('.', '/')}.class", bytes(code))
        spark.sql(f"ADD JAR '{path}'")
        _shipped.add(key)
    gateway, session = spark.sparkContext._gateway, spark._jsparkSession
    made = session.sharedState().jarClassLoader().loadClass(full).getDeclaredConstructor(gateway.new_array(spark._jvm.java.lang.Class, 0))
    session.udf().register(name, made.newInstance(gateway.new_array(spark._jvm.java.lang.Object, 0)), session.parseDataType(f'"{kind}"'))
    return name


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session on this machine; on a cluster the settings come from spark-submit."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lexiforge")
    for k, v in {
        "spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true",
    }.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where the session names none, one in the warehouse, or a local one without a cluster."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = sc._jsc.sc().getCheckpointDir()
        alone = sc.master == "local" or sc.master.startswith("local[")
        root = found.get() if found.isDefined() else f"file://{tempfile.gettempdir()}/checkpoints" if alone else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared root; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/lexiforge-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: the lineage is cut and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int = 10_000) -> DataFrame:
    """df to be broadcast if it has at most ``most`` rows, counted now; else as it is, to be joined by an exchange."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if its files are fewer than these; large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
