"""Session settings and the shared work folder."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("modelwarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder path on storage that the driver and all executors share, deleted when the session's JVM ends.

    The root is the folder that the cluster names in spark.checkpoint.dir. Where that is unset (tests, a laptop) it is the
    warehouse folder, which a session shares as well; a warehouse on a machine's own disk is refused on a cluster.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith(("file:", "/")) and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"{root.rstrip('/')}/work"
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, purpose: str, compression: str = "snappy") -> DataFrame:
    """`df` written as Parquet to the shared folder and read again: cuts lineage, and survives a lost executor."""
    path = work_dir(df.sparkSession, purpose)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that nothing reads any more, and let Spark clean the shuffles of finished steps."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            target = jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    jvm.System.gc()
