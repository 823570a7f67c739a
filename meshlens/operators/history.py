"""Snapshots of graphs over time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.functions.columns import iso_second, round_exact
from meshlens.plans.shipping import ship

CAP = 100
#: So many ids are one text on their way to the digest.
JOINED = 250


def digest(node_ids: DataFrame, flags: DataFrame) -> DataFrame:
    """One row, graph_hash: 16 hex digits over sorted ids and sorted owner-code pairs.

    All ids are sorted and joined into short texts by many tasks. SHA-256 takes its input in order and can't be put together
    from parts, so one task reads these texts one after another; it holds a batch of them and the digest's state.
    """
    spark = node_ids.sparkSession
    ship(spark)
    pair = F.concat("owner_id", F.lit("\x1f"), "code")
    values = node_ids.select(F.lit(0).alias("side"), F.col("id").alias("value")).unionByName(flags.select(F.lit(1).alias("side"), pair.alias("value"))).filter("value is not null")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for side in (0, 1):
                texts = batch.column("value").filter(pc.equal(batch.column("side"), side)).to_pylist()
                parts = ["\x1e".join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([task] * n, pa.int32()), pa.array(range(k, k + n), pa.int64()), pa.array([side] * n, pa.int32()), pa.array(parts, pa.string())], names=["task", "k", "side", "text"])
                k += n

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, at, begun = hashlib.sha256(), 0, False
        for batch in batches:
            for side, text in zip(batch.column("side").to_pylist(), batch.column("text"), strict=True):
                if side < 0:
                    continue
                if side > at:
                    sha.update(b"\x1d")
                    at, begun = side, False
                if begun:
                    sha.update(b"\x1e")
                sha.update(text.as_buffer())
                begun = True
        if not at:
            sha.update(b"\x1d")
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()[:16]])], names=["graph_hash"])

    shape = "task int, k long, side int, text string"
    texts = values.orderBy("side", "value").mapInArrow(join, shape)
    begin = spark.range(1).select(F.lit(-1).alias("task"), F.lit(0).cast("long").alias("k"), F.lit(-1).alias("side"), F.lit("").alias("text"))  # a graph without ids has a hash as well
    return texts.unionByName(begin).repartition(1).sortWithinPartitions("task", "k").mapInArrow(read, "graph_hash string")


def snapshot(nodes: DataFrame, edges: DataFrame, flags: DataFrame, now_ms: int) -> DataFrame:
    """One row about one graph."""
    of_nodes = flags.filter(F.col("owner_kind") == "node")
    a = nodes.agg(round_exact(F.coalesce(F.sum("risk_score"), F.lit(0.0)), 1).alias("total_risk"), F.count("*").alias("nodes"), F.count_if(F.col("type") == "endpoint").alias("endpoints"))
    b = edges.agg(F.count_if(F.col("type") == "http").alias("wires"))
    c = of_nodes.agg(F.count("*").alias("flags_total"), F.count_if(F.col("severity") == "critical").alias("flags_critical"))
    d = of_nodes.groupBy("code").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("by_code"))
    now = F.lit(now_ms)
    return a.join(b).join(c).join(d).join(digest(nodes, of_nodes)).select((now / 1000).alias("ts"), iso_second(now).alias("iso"), "graph_hash", "total_risk", "nodes", "wires", "endpoints", "flags_total", "flags_critical", "by_code")


def recorded(history: DataFrame, cap: int = CAP) -> DataFrame:
    """Snapshots without those equal to the one before; the newest cap of them. A series of one graph is small: one row a scan."""
    before = F.lag("graph_hash").over(Window.orderBy("ts"))
    kept = history.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("graph_hash"))).drop("_b")
    return kept.orderBy(F.desc("ts")).limit(cap).orderBy("ts")


def churn(history: DataFrame) -> DataFrame:
    """One row: codes that rose, codes that fell, and the change of risk between the last two snapshots; empty with fewer."""
    row = F.struct("by_code", "total_risk")
    last = history.orderBy(F.desc("ts")).limit(2).agg(F.min_by(row, "ts").alias("_old"), F.max_by(row, "ts").alias("_new"), F.count("*").alias("_n"))
    if_two, old, new = F.col("_n") == 2, F.col("_old"), F.col("_new")
    count = lambda m, k: F.coalesce(m["by_code"][k], F.lit(0))
    keys = lambda m: F.coalesce(F.map_keys(m["by_code"]), F.array().cast("array<string>"))
    rose = F.array_sort(F.filter(keys(new), lambda k: count(new, k) > count(old, k)))
    fell = F.array_sort(F.filter(keys(old), lambda k: count(old, k) > count(new, k)))
    none = F.array().cast("array<string>")
    return last.select(F.when(if_two, rose).otherwise(none).alias("introduced"), F.when(if_two, fell).otherwise(none).alias("resolved"), F.when(if_two, round_exact(new["total_risk"] - old["total_risk"], 1)).otherwise(0.0).alias("risk_delta"))


def sparkline(history: DataFrame, value: str) -> DataFrame:
    """(ts, y): a series scaled to 0..1."""
    w = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low, span = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return history.select("ts", ((F.col(value) - low) / F.when(span == 0, 1).otherwise(span)).alias("y"))
