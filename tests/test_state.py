"""Stateful span streams: what is kept over restarts, and the latest client span."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from meshlens.plans import cli
from meshlens.streaming import http_receiver, spans, state


def span(kind, ms, trace="t", **attrs):
    return {"kind": kind, "startTimeUnixNano": str(ms * 10**6), "endTimeUnixNano": str((ms + 5) * 10**6), "traceId": trace, "attributes": [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in attrs.items()]}


def drop(folder, number, *found):
    """One file, after all before it."""
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{number:04d}.json"
    with open(path, "w") as f:
        f.write(json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(found)}]}]}) + "\n")
    os.utime(path, (time.time() - 1000 + number, time.time() - 1000 + number))


HOUR = 3_600_000


def test_kept_rows_equal_retained_over_a_restart(spark, tmp_path):
    """Old rows, rows past the cap, unrouted ones and clients of traces that are gone; the stream stops and goes on in between."""
    folder, checkpoint, now, cap = str(tmp_path / "in"), str(tmp_path / "cp"), int(time.time() * 1000), 20
    batches = []
    for b in range(9):
        rows = [span(2, now - 1000 * b - k, f"a{b}-{k}", http__method="get", http__route="/a/{x}") for k in range(10)]
        rows += [span(2, now - 30 * HOUR, f"old{b}", http__method="get", http__route="/a/{x}")]  # too old for the window
        rows += [span(2, now - k, f"u{b}-{k}", http__method="post", url__path=f"/p/{b}/{k}") for k in range(5)]
        if b == 0:
            rows += [span(2, now, f"b{k}", http__method="put", http__route="/b") for k in range(3)]
        rows += [span(3, now + b, t, http__method="get", url__path=f"/c{b}") for t in (f"a{b}-1", f"u{b}-1", "nobody", "b1", f"old{b}")]
        batches.append(rows)
    for start, end in ((0, 5), (5, 9)):
        for b in range(start, end):
            drop(folder, b, *batches[b])
        state.keep_stream(spans.payload_stream(spark, folder, 1), checkpoint, 24, cap).awaitTermination(300)
    payloads = spark.createDataFrame([(b, json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": rows}]}]})) for b, rows in enumerate(batches)], "ord long, payload string")
    servers, clients = spans.span_streams(payloads)
    routed, unrouted, kept_clients = spans.retained(servers, clients, now, 24, cap)
    got, got_clients = state.kept(spark, checkpoint, now, 24, cap)
    line = ["method", "route", "path", "status", "ts_ms", "dur_ms", "trace_id"]
    want = sorted(map(repr, routed.drop("key").unionByName(unrouted).select(*line).collect()))
    assert sorted(map(repr, got.select(*line).collect())) == want and len(want) == cap + 3 + cap
    assert sorted(tuple(r) for r in got_clients.select("trace_id", "method", "path").collect()) == sorted((r["trace_id"], r["client_method"], r["client_path"]) for r in kept_clients.collect())
    assert {r["trace_id"] for r in got_clients.collect()} >= {"b1", "a8-1"} and "nobody" not in {r["trace_id"] for r in got_clients.collect()}
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load()
    most = held.groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 2 * cap


def test_state_of_idle_keys_ends(spark, tmp_path):
    folder, checkpoint, now = str(tmp_path / "in"), str(tmp_path / "cp"), int(time.time() * 1000)
    drop(folder, 0, span(2, now - 60 * HOUR, http__method="get", http__route="/idle"))
    for k in range(1, 4):
        drop(folder, k, span(2, now + k, http__method="get", http__route="/busy"))
    state.keep_stream(spans.payload_stream(spark, folder, 1), checkpoint, 12, 5).awaitTermination(300)
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load()
    assert {r["k"] for r in held.select(F.col("key.key").alias("k")).collect()} == {"GET /busy"}


def test_latest_client_in_the_stream(spark, tmp_path):
    """Of two client spans the later one, whichever came first; one row a request, none before the watermark has passed its range."""
    folder, checkpoint, t0 = str(tmp_path / "in"), str(tmp_path / "cp"), 1_700_000_000_000
    minute = 60_000

    def run():
        servers, clients = spans.span_streams(spans.payload_stream(spark, folder, 1))
        found = state.latest_client_stream(servers, clients, hours=0.5, apart=0.25)
        found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(300)
        return sorted((r["trace_id"], r["path"], r["client_path"], r["ts_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    drop(folder, 0, span(3, t0 + 2 * minute, "two", http__method="get", url__path="/later/7"), span(2, t0, "two", http__method="get", url__path="/s"), span(2, t0 + minute, "two", http__method="get", url__path="/s2"))
    drop(folder, 1, span(3, t0 - minute, "two", http__method="get", url__path="/first"), span(2, t0, "none", http__method="get", url__path="/s"), span(3, t0 + 30 * minute, "none", http__method="get", url__path="/far"))
    assert run() == []
    drop(folder, 2, span(2, t0 + 300 * minute, "end", http__method="get", url__path="/s"))
    drop(folder, 3, span(2, t0 + 301 * minute, "end", http__method="get", url__path="/s"))
    assert run() == [("none", "/s", None, t0), ("two", "/s", "/later/:p", t0), ("two", "/s2", "/later/:p", t0 + minute)]


@pytest.mark.parametrize("shares", [1, 8])
def test_latest_client_of_many_traces(spark, tmp_path, shares):
    """Spans around the bounds of slots and of the range, over a restart, as a comparison of all pairs has them; state keys are few, however many the traces."""
    folder, checkpoint, t0, minute = str(tmp_path / "in"), str(tmp_path / "cp"), 1_700_000_000_000 // HOUR * HOUR, 60_000
    apart, late = 15 * minute, 30 * minute
    rng = random.Random(7)
    found, top = [], t0
    for b in range(4):
        low, top = top - 20 * minute, t0 + (b + 1) * 40 * minute
        rows = [(rng.choice((2, 2, 3)), t0 + rng.randrange(low - t0, top - t0), f"t{rng.randrange(60)}", f"/{b}x{k}") for k in range(90)]
        rows += [(2, top, "top", f"/top{b}")]
        for k, at in enumerate((top - late - apart - 2, top - late - apart - 1, top - late - apart)):  # over, just over, not yet
            rows += [(2, at, f"edge{b}{k}", "/edge"), (3, at + apart, f"edge{b}{k}", "/in"), (3, at - apart, f"edge{b}{k}", "/early"), (3, at + apart + 1, f"edge{b}{k}", "/out")]
        found.append([r for r in rows if r[1] > top - late - 40 * minute + 1])  # none behind the watermark of the file before
    for b, rows in enumerate(found):
        drop(folder, b, *[span(kind, ms, trace, http__method="get", url__path=path) for kind, ms, trace, path in rows])
        servers, clients = spans.span_streams(spans.payload_stream(spark, folder, 1))
        sent = state.latest_client_stream(servers, clients, hours=0.5, apart=0.25, **({} if shares == 8 else {"shares": shares}))
        sent.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination(300)
        seen = [r for rows in found[: b + 1] for r in rows]
        mark = max(r[1] for r in seen) - late
        want = []
        for kind, ms, trace, path in seen:
            if kind == 2 and ms + apart + 1 <= mark:
                near = max(((m, p) for k, m, t, p in seen if k == 3 and t == trace and abs(m - ms) <= apart), default=(None, None))
                want.append((trace, ms, path, near[0], near[1]))
        got = [(r["trace_id"], r["ts_ms"], r["path"], r["at"], r["client_path"]) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("at", F.unix_millis("client_ts")).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr) and want
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting").load()
    assert held.select("key").distinct().count() <= 3 * shares


@pytest.mark.parametrize("hours", [None, 12])
def test_ingest_command(spark, tmp_path, hours):
    folder, store, now = str(tmp_path / "in"), str(tmp_path / "store"), int(time.time() * 1000)
    for k, age in enumerate((0, 30 * HOUR)):
        http_receiver.accept(folder, json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [span(2, now - age, http__method="get", http__route=f"/r{k}"), span(3, now, "t", http__method="get", url__path=f"/c{k}")]}]}]}).encode(), "application/json")
    cli.run_ingest(folder, store, hours)
    assert cli.stored_window(spark, store) == (hours or 24)
    servers, clients = state.kept(spark, f"{store}/checkpoint", now, cli.stored_window(spark, store))
    assert [r["route"] for r in servers.collect()] == ["/r0"] and clients.count() == 1
