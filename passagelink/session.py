"""Session defaults, table loading and durable intermediate results."""

from __future__ import annotations

import gc
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and single-node benches; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application, wherever the driver found it."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        home = Path(__file__).parent
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='passagelink-')}/{home.name}", "zip", home.parent, home.name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One named table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or where it is unset (tests) an own temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if where is None and not sc.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="passagelink-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, *partition_hint: str) -> DataFrame:
    """Write a result to the shared folder as compressed Parquet and read it back.

    Cuts the lineage as checkpoint() does, survives the loss of executors, and is smaller than checkpointed rows.
    With column names given, rows are clustered by them within each written file. Removed when the session ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    if partition_hint:
        df = df.sortWithinPartitions(*partition_hint)
    df.write.option("compression", "zstd").parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(where)


def tidy(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that Spark deletes the shuffle files of what was materialized before. The scheduler
    holds the last job, so a small one comes first."""
    gc.collect()
    spark.range(1).collect()
    spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
