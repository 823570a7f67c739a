"""Intermediate tables in the shared folder: their lineage ends there, and a lost executor loses none of them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MARKED: set[tuple[str, str]] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors see; one of our own only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="meshlens-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, which goes when the application ends."""
    sc = spark.sparkContext
    folder = f"{shared_dir(spark)}/meshlens-{sc.applicationId}"
    if (sc.applicationId, folder) not in _MARKED:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _MARKED.add((sc.applicationId, folder))
    return folder


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it is computed once.

    Nothing else reads the shuffles of that write, so Spark may delete their files when it is done.
    """
    spark = df.sparkSession
    path = f"{own_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
