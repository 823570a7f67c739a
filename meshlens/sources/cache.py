"""Facts kept by content hash, so that a scan parses only what changed.

The cache is the table of facts of the scan before: every file has a row of ord 0 there, one without facts the fact ``none``.
On disk it lies in buckets of a hash of the path; a scan writes the buckets in which a file is new, changed or gone, and no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions.columns import content_hash
from meshlens.plans.staging import staged
from meshlens.sources.tree import FACT_ROWS, facts

#: Raised when extractors give other facts for the same text; part of the cache's path.
VERSION = 2
KEY = ["section", "path", "sha"]
BUCKETS = 64
#: The kind of a row that stands in a bucket without files, so that it is written at all.
EMPTY = "empty"


def stale(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files(section, path, content) with sha that the cache(section, path, sha) does not hold as they are."""
    return files.withColumn("sha", content_hash(F.col("content"))).join(cache.select(*KEY), KEY, "left_anti")


def refreshed(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Facts of files: those of unchanged files from the cache, those of new and changed ones parsed; files that are gone have none."""
    now = files.select("section", "path", content_hash(F.col("content")).alias("sha"))
    return cache.join(now, KEY, "left_semi").unionByName(facts(stale(files, cache.filter("ord = 0"))))


def _bucket(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def held(spark: SparkSession, folder: str) -> DataFrame:
    """The facts in a folder, with their bucket; an empty table where there is none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    shape = f"{FACT_ROWS}, bucket int"
    return spark.read.schema(shape).parquet(folder) if there else spark.createDataFrame([], shape)


def updated(folder: str, files: DataFrame) -> DataFrame:
    """Facts of files, kept in a folder: only buckets with a change are parsed, as far as they changed, and written anew."""
    spark = files.sparkSession
    cache = held(spark, folder)
    now = files.select("section", "path", content_hash(F.col("content")).alias("sha"))
    then = cache.filter((F.col("ord") == 0) & (F.col("kind") != EMPTY)).select(*KEY)
    differing = now.join(then, KEY, "left_anti").unionByName(then.join(now, KEY, "left_anti"))
    buckets = [r["b"] for r in differing.select(_bucket(F.col("path")).alias("b")).distinct().collect()]  # BUCKETS at most
    if buckets:
        place = _bucket(F.col("path"))
        fresh = refreshed(cache.filter(F.col("bucket").isin(buckets) & (F.col("kind") != EMPTY)).drop("bucket"), files.filter(place.isin(buckets)))
        none = spark.createDataFrame([("", "", "", 0, EMPTY, "{}", b) for b in buckets], f"{FACT_ROWS}, bucket int")
        rows = staged(fresh.withColumn("bucket", place), "cache").unionByName(none)  # what is read isn't written over
        rows.repartition(len(buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
    return held(spark, folder).filter(F.col("kind") != EMPTY).drop("bucket")
