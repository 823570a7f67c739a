"""Stateful operators of the span stream: what a store keeps of each key, and the latest client span of each request.

Both keep their rows in RocksDB under the stream's checkpoint, one commit a micro-batch, so a stream that is cut short goes
on where its last batch ended. The kept rows are read from that state itself; no table is written beside it.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ListState
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructType

from meshlens.functions.columns import canonical_path
from meshlens.operators.runtime import in_window, last_per_key
from meshlens.plans.shipping import ship
from meshlens.streaming.spans import span_streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Parts of a key in the state: a key that holds much of the traffic is met by so many tasks.
PARTS = 8
HELD = reduce(lambda t, c: t.add(*c), [("ord", LongType()), ("method", StringType()), ("route", StringType()), ("path", StringType()), ("status", IntegerType()), ("ts_ms", LongType()), ("dur_ms", DoubleType()), ("trace_id", StringType())], StructType())
ABOUT = StructType().add("rows", LongType()).add("latest_ms", LongType())
#: Spans held as lines of JSON, at most so many a block where blocks are written anew.
BLOCK_ROWS = 2000
BLOCK = StructType().add("lines", StringType())
DUE = StructType().add("ms", LongType())
NEVER = (1 << 63) - 1
_HOUR = 3_600_000


def _rocks(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    # the driver reads a processor's state variables in a Python of its own, which has no shipped files
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    ship(spark)


class Keep(StatefulProcessor):
    """The latest arrivals of each part of a key: twice the cap at most, those out of the window first. A timer ends what the watermark has left behind."""

    def __init__(self, cap: int, window_hours: float) -> None:
        self.cap, self.window_ms = cap, int(window_hours * _HOUR)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getListState("kept", HELD)
        self.about = handle.getValueState("about", ABOUT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        cap = 1 if key[0] == "client" else self.cap
        held, latest = tuple(self.about.get()) if self.about.exists() else (0, 0)
        new, k = deque(maxlen=cap), 0
        for r in rows:
            new.append(((r["arrived"] << 20) + k, *(r[c] for c in HELD.names[1:])))
            k += 1
            latest = max(latest, r["ts_ms"])
        if held + len(new) > 2 * cap:
            old = [tuple(r) for r in self.kept.get()]
            cut = r["arrived"] - self.window_ms
            every = [x for x in old if key[0] == "client" or x[5] >= cut] + list(new)
            self.kept.put(every[-cap:])
            held = min(cap, len(every))
        else:
            self.kept.appendList(list(new))
            held += len(new)
        self.about.update((held, latest))
        self.handle.registerTimer(latest + self.window_ms)
        yield Row(kind=key[0], key=key[1], kept=held)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        """All that a key holds is out of the window, unless rows came since the timer was set; these set their own."""
        if self.about.exists() and self.about.get()[1] + self.window_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.kept.clear()
            self.about.clear()
            yield Row(kind=key[0], key=key[1], kept=0)

    def close(self) -> None:
        """Nothing is open."""


class LatestClient(StatefulProcessor):
    """Requests of a share of traces and a slot of time wait until the watermark has left their range behind, and go out once, with the latest client span in it.

    Rows are held as blocks of JSON lines, so that a call and a read of the state serve many traces; only the client spans of a
    key are in memory as objects. One timer stands at the earliest request's end, one at the end of the slot and its range, when
    nothing of it can be asked for; a timer goes off when the watermark has come to it.
    """

    def __init__(self, apart_ms: int, slot_ms: int) -> None:
        self.apart_ms, self.slot_ms = apart_ms, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", BLOCK)
        self.clients = handle.getListState("clients", BLOCK)
        self.due = handle.getValueState("due", DUE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        end = self._end(key)
        known = self.due.get()[0] if self.due.exists() else None
        first = end if known is None else known
        for batch in rows:
            due, sent = batch["due"], batch["due"] == NEVER
            first = min(first, int(due.min()))
            for held, lines in ((self.waiting, batch["line"][~sent]), (self.clients, batch["line"][sent])):
                if len(lines):
                    held.appendValue(("\n".join(lines),))
        if known is None:
            self.handle.registerTimer(end)
        self._next(first, known, end)
        yield from ()

    def _end(self, key: tuple) -> int:
        return int(key[1]) + self.slot_ms + self.apart_ms

    def _next(self, first: int, known: int | None, end: int) -> None:
        if first != known:
            self.due.update((first,))
            if first < end:
                self.handle.registerTimer(first)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        mark, end = timerValues.getCurrentWatermarkInMs(), self._end(key)
        known = self.due.get()[0] if self.due.exists() else None
        if known is None or known > mark:
            return
        by_trace: dict[str, list[tuple]] = {}
        live, left, ready, first = [], [], [], end
        for line in _lines(self.clients):
            c = json.loads(line)
            by_trace.setdefault(c.get("trace_id"), []).append((c["ts_ms"], c.get("client_method"), c.get("client_path")))
            if c["ts_ms"] + 2 * self.apart_ms >= mark:
                live.append(line)
        for found in by_trace.values():
            found.sort(key=lambda c: (c[0], c[1] or "", c[2] or ""))
        for line in _lines(self.waiting):
            r = json.loads(line)
            if r["ts_ms"] + self.apart_ms >= mark:
                left.append(line)
                first = min(first, r["ts_ms"] + self.apart_ms + 1)
                continue
            trace = r.get("trace_id")
            ready.append((trace, r["server"], *self._latest(by_trace.get(trace, ()), r["ts_ms"])))
            if len(ready) == BLOCK_ROWS:
                yield _frame(ready)
                ready = []
        if ready:
            yield _frame(ready)
        for held, lines in ((self.waiting, left), (self.clients, live)):
            if lines and end > mark:
                held.put([("\n".join(lines[k : k + BLOCK_ROWS]),) for k in range(0, len(lines), BLOCK_ROWS)])
            else:
                held.clear()
        if end > mark:
            self._next(first, known, end)
        else:
            self.due.clear()

    def _latest(self, found: Sequence[tuple], ts: int) -> tuple:
        """(time, method, path) of the last of these client spans in the range of a request."""
        k = bisect_left(found, (ts + self.apart_ms + 1,)) - 1
        return found[k] if k >= 0 and found[k][0] >= ts - self.apart_ms else (None, None, None)

    def close(self) -> None:
        """Nothing is open."""


def _lines(held: ListState) -> Iterator[str]:
    return (line for (block,) in held.get() for line in block.split("\n"))


def _frame(ready: list[tuple]) -> pd.DataFrame:
    """Rows (trace, server, time, method, path) of client spans as the processor gives them out."""
    kinds = {"trace_id": "object", "server": "object", "client_ts_ms": "Int64", "client_method": "object", "client_path": "object"}
    return pd.DataFrame({name: pd.Series(values, dtype=kinds[name]) for name, values in zip(kinds, zip(*ready))})


def latest_client_stream(servers: DataFrame, clients: DataFrame, hours: float = 24, apart: float = 1, shares: int = PARTS) -> DataFrame:
    """One row a server span, in append mode: its columns with the method, path and time of the latest client span of its trace at most so many hours apart.

    A request goes out when the watermark has passed the end of its range, so no later span can change it. A key of the state is
    one of so many shares of the traces in a slot of four ranges, so calls to Python don't grow with the traces; client spans go
    to each slot that their range meets. Spans of a key are read by one task at once: streams of very many need more shares.
    """
    spark = servers.sparkSession
    _rocks(spark)
    apart_ms = int(apart * _HOUR)
    slot_ms = max(4 * apart_ms, _HOUR // 6)
    slot = lambda at: at - F.pmod(at, F.lit(slot_ms))
    ms = F.unix_millis("ts")
    columns = [c for c in servers.columns if c not in ("trace_id", "ts")]
    late = f"{int(hours * 60)} minutes"
    body = F.to_json(F.struct(*columns))
    share = F.pmod(F.xxhash64("trace_id"), F.lit(shares)).cast("int").alias("share")
    line = lambda *held: F.to_json(F.struct("trace_id", ms.alias("ts_ms"), *held)).alias("line")
    asked = servers.filter("ts is not null").select(share, slot(ms).alias("slot"), "ts", (ms + apart_ms + 1).alias("due"), line(body.alias("server")))
    slots = F.explode(F.sequence(slot(ms - apart_ms), slot(ms + apart_ms), F.lit(slot_ms).cast("long")))
    sent = clients.select(share, slots.alias("slot"), "ts", F.lit(NEVER).alias("due"), line(F.col("method").alias("client_method"), canonical_path(F.col("path")).alias("client_path")))
    dealt = asked.unionByName(sent).withWatermark("ts", late).groupBy("share", "slot")
    out = "trace_id string, server string, client_ts_ms long, client_method string, client_path string"
    found = dealt.transformWithStateInPandas(LatestClient(apart_ms, slot_ms), out, "Append", "EventTime")
    shape = servers.select(*columns).schema.simpleString()
    named = found.withColumn("_s", F.from_json("server", shape))
    return named.select("trace_id", "_s.*", "client_method", "client_path", F.timestamp_millis("client_ts_ms").alias("client_ts"))


def keep_stream(payloads: DataFrame, checkpoint: str, window_hours: float = 24, cap: int = 5000) -> StreamingQuery:
    """Takes span payloads into the state under a checkpoint, once each.

    Rows behind the watermark, a window before the latest, are out of the window and don't come in. Keys are method and route; requests without a route are one key, and each trace's client span is a key that keeps the
    last. Every key is dealt to parts by a hash of the span, each of which keeps as many rows as the key may.
    """
    _rocks(payloads.sparkSession)
    servers, clients = span_streams(payloads)
    routed = F.coalesce("route", F.lit("")) != ""
    key = F.when(routed, F.concat("method", F.lit(" "), canonical_path(F.col("route"))))
    shape = lambda df, kind, key, part, **made: df.select(kind.alias("kind"), key.alias("key"), part.alias("part"), "ts", F.unix_millis(F.current_timestamp()).alias("arrived"), "method", *[made.get(c, F.col(c)).alias(c) for c in ("route", "path", "status", "ts_ms", "dur_ms", "trace_id")])
    part = F.pmod(F.xxhash64("trace_id", "ts_ms", "path", "dur_ms"), F.lit(PARTS)).cast("int")
    known = servers.filter(routed | (F.coalesce("path", F.lit("")) != ""))
    rows = shape(known, F.when(routed, "routed").otherwise("unrouted"), F.coalesce(key, F.lit("")), part)
    none = lambda kind: F.lit(None).cast(kind)
    sent = shape(clients, F.lit("client"), F.col("trace_id"), F.lit(0), route=none("string"), status=none("int"), ts_ms=F.unix_millis("ts"), dur_ms=none("double"))
    dealt = rows.unionByName(sent).withWatermark("ts", f"{int(window_hours * 60)} minutes").groupBy("kind", "key", "part")
    kept = dealt.transformWithState(Keep(cap, window_hours), "kind string, key string, kept long", "Update", "EventTime")
    return kept.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def kept(spark: SparkSession, checkpoint: str, now_ms: int, window_hours: float = 24, cap: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(servers, clients) of the state: in the window, the last cap of each key by arrival, and the last client span of traces still there."""
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "kept").load()
    rows = held.select("key.kind", "key.key", "list_element.*")
    routed = last_per_key(in_window(rows.filter("kind = 'routed'"), now_ms, window_hours), "key", cap)
    unrouted = last_per_key(in_window(rows.filter("kind = 'unrouted'"), now_ms, window_hours), None, cap)
    servers = routed.unionByName(unrouted).drop("kind", "key")
    live = servers.select("trace_id").distinct()
    clients = last_per_key(rows.filter("kind = 'client'"), "key", 1).select("ord", "trace_id", "method", "path")
    return servers, clients.join(live, "trace_id", "left_semi")
