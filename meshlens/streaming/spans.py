"""Span payloads as a stream: decoding, routing, retention, and attribution to client spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshlens.functions.columns import canonical_path
from meshlens.operators.runtime import client_index, in_window, last_per_key, split_observations
from meshlens.sources import otlp


def payload_stream(spark: SparkSession, folder: str, files_a_batch: int = 1000) -> DataFrame:
    """Payloads dropped into a folder, a line of JSON or of base64 each, with the time they came."""
    return spark.readStream.option("maxFilesPerTrigger", files_a_batch).text(folder).select(F.col("value").alias("payload"), F.current_timestamp().alias("arrived"))


def span_streams(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(server spans, client spans) with the event time ts."""
    found = otlp.mixed_spans(payloads)
    servers = otlp.server_spans(found).withColumn("ts", F.timestamp_millis("ts_ms"))
    return servers, otlp.client_spans(found.withColumn("ts", F.timestamp_millis(F.expr("start_ns div 1000000")))).filter("ts is not null")


def joined_stream(servers: DataFrame, clients: DataFrame, hours: float = 24, apart: float = 1) -> DataFrame:
    """Server spans with the method and path of each client span of the same trace at most so many hours apart (state.latest_client_stream gives the latest alone).

    The watermark only bounds what is held; what is too old for the window is filtered by retained().
    """
    late = f"{int(hours * 60)} minutes"
    s = servers.withWatermark("ts", late)
    c = clients.select(F.col("trace_id").alias("client_trace"), F.col("method").alias("client_method"), canonical_path(F.col("path")).alias("client_path"), F.col("ts").alias("client_ts")).withWatermark("client_ts", late)
    near = F.expr(f"client_trace = trace_id AND client_ts BETWEEN ts - INTERVAL {int(apart * 3600)} SECONDS AND ts + INTERVAL {int(apart * 3600)} SECONDS")
    return s.join(c, near, "left_outer")


def retained(observations: DataFrame, clients: DataFrame, now_ms: int, window_hours: float = 24, cap: int = 5000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(routed, unrouted, clients) that a store keeps: inside the window, the last cap of each key and of the unrouted, and client spans of traces still there."""
    routed, unrouted = split_observations(in_window(observations, now_ms, window_hours))
    routed, unrouted = last_per_key(routed, "key", cap), last_per_key(unrouted, None, cap)
    live = routed.select("trace_id").unionByName(unrouted.select("trace_id")).distinct()
    return routed, unrouted, client_index(clients).join(live, "trace_id", "left_semi")


def store_stream(payloads: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Appends each micro-batch's server and client spans to tables under a folder, once each: a batch is written to a folder of its own number."""

    def write(batch: DataFrame, number: int) -> None:
        servers, clients = span_streams(batch)
        order = F.monotonically_increasing_id() + F.lit(number) * F.lit(1 << 40)
        servers.withColumn("ord", order).write.mode("overwrite").parquet(f"{store}/servers/batch={number}")
        clients.withColumn("ord", order).write.mode("overwrite").parquet(f"{store}/clients/batch={number}")

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
