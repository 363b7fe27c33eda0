"""Intermediate tables in the folder that the cluster names.

Operators that use one result more than once, or that iterate, cut the lineage by writing a
table below ``spark.checkpoint.dir``. Every executor can read it, and a task that is lost
later rereads a file instead of recomputing the plan. Nothing here touches a machine-local
folder unless the session is local and names no folder of its own (tests).
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables of this application, created on first use.

    A session without the setting gets a temporary folder, which is only right in local mode,
    so any other master is refused.
    """
    root = spark.conf.get(_SETTING, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_SETTING} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="posthorn-")
        spark.conf.set(_SETTING, root)
    path = f"{root.rstrip('/')}/posthorn/{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where):
        fs.mkdirs(where)
        fs.deleteOnExit(where)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created there."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the table read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, df: DataFrame) -> None:
    """Remove the files of a table that ``materialise`` made and that no plan reads any more."""
    for file in df.inputFiles()[:1]:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished plans that nothing refers to, which else waits for the driver's own garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
