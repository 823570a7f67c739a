"""Substring dedup by recompression: words that stand in a repeated 20-word window are removed, all but the first time.

Recompression renames a word sequence in rounds. In a round, runs of one symbol and then pairs of neighbours become new
symbols: a pair if a bit of the left one's name is 0 and of the right one's is 1. Names are 64-bit hashes of what they
stand for, so the same run or pair has the same name everywhere without any table, and how a symbol came about depends on
itself and one symbol to either side only. Equal windows therefore hold the same interior symbols: those whose words, and
the words they depend on, all lie inside the window.

Each window takes as its key the highest-level interior symbol of least hash; neighbouring windows mostly take the same one
and make a unit. Spark rounds bring units of one key together. A unit whose words also stand earlier, by a 128-bit name that
is independent of the symbols' names, is a repeat as a whole. Only where one key has units of different words (edges of
passages, edited copies), or a unit repeats inside itself, are the windows of the earliest units compared one by one, by
128-bit names of their own.

Equal units of a slice of text are brought together once, and units of the most frequent keys go on under key and words, so
the edges of a passage that very many documents hold don't meet in one task.

Defined cases: null and empty texts, and those of fewer than 20 words, have no window and lose nothing; rows of equal
doc_id and text are one document and share their decisions; different texts under one id, or none, are documents of their
own, in the order of a hash of their texts, those without id last; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.llm.shared import Words, frequent, mix64, pooled, powers, ship, slices, staged, told_apart, words_of

WINDOW, LEVELS = 20, 2
#: Bytes of text in which equal units are reduced to one.
SLICE = 1 << 21
#: So many of the most frequent keys at most have their units told apart by their words; any other key is about as rare as the last of these.
FREQUENT_KEYS = 10_000


def _follow(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of ranges of values."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64), 3)


def rounds(hashes: np.ndarray, first: np.ndarray, levels: int = LEVELS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level: names of its symbols, and the range of words that each depends on (past a text's ends: one beyond)."""
    n = len(hashes)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    name, lo, hi = hashes, np.arange(n), np.arange(1, n + 1)
    out = [(name, lo, hi)]
    for level in range(levels):
        if not len(name):
            out.append((name, lo, hi))
            continue
        new_text = np.concatenate([[True], text[1:] != text[:-1]])
        last_text = np.append(new_text[1:], True)
        # what the neighbour depends on; a text's end is never inside a window
        left = np.where(new_text, lo - WINDOW - 1, np.concatenate([[0], lo[:-1]]))
        right = np.where(last_text, hi + WINDOW + 1, np.append(hi[1:], 0))
        run = np.flatnonzero(new_text | np.concatenate([[True], name[1:] != name[:-1]]))
        run_end = np.append(run[1:], len(name))
        base, size = name[run], run_end - run
        named = np.where(size > 1, mix64(base + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 100 + level), base)
        lo, hi, text = left[run], right[run_end - 1], text[run]
        bit = (mix64(base, 200 + level) >> np.uint64(63)).astype(bool)
        opens = np.zeros(len(base), bool)
        opens[:-1] = ~bit[:-1] & bit[1:] & (text[:-1] == text[1:])
        closes = np.concatenate([[False], opens[:-1]])
        at = np.flatnonzero(~closes)
        paired = opens[at]
        second = np.minimum(at + 1, len(base) - 1)
        name = np.where(paired, mix64(mix64(named[at], 300 + level) + named[second], 400 + level), named[at])
        lo, hi, text = lo[at], np.where(paired, hi[second], hi[at]), text[at]
        out.append((name, lo, hi))
    return out


def window_keys(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Key of the 20-word window that starts at each word (those across texts' ends mean nothing), and the words' hashes."""
    hashes = w.hashes()
    n = len(hashes)
    if n < WINDOW:
        return np.zeros(0, np.uint64), hashes
    by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    best = None
    for level, (name, lo, hi) in enumerate(rounds(hashes, w.first)):
        rank = np.uint64(LEVELS - level) << np.uint64(62)
        if not level:
            best = rank | (mix64(name, 1) >> np.uint64(2))
            continue
        size = hi - lo
        fits = np.flatnonzero(size <= WINDOW)
        order = fits[np.argsort(size[fits], kind="stable")]
        value = rank | (mix64(_follow(hashes, lo[order], hi[order]) + name[order], 2) >> np.uint64(2))
        cuts = np.searchsorted(size[order], np.arange(WINDOW + 2))
        for k in range(1, WINDOW + 1):
            if cuts[k + 1] > cuts[k]:
                by_length.setdefault(k, []).append((lo[order[cuts[k] : cuts[k + 1]]], value[cuts[k] : cuts[k + 1]]))
    for k in range(2, WINDOW + 1):  # best[s]: least key of the symbols that lie in words s to s + k
        best = np.minimum(best[:-1], best[1:])
        for at, value in by_length.get(k, []):
            best[at] = np.minimum(best[at], value)
    return best, hashes


UNITS = "key long, content long, content2 long, doc_id {kind}, part long, at int, n int, sure boolean, inner boolean"


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            h, n = np.unique(window_keys(words_of(part.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 2].view(np.int64)), pa.array(n[n > 2])], names=["key", "n"])


def frequent_keys(docs: DataFrame) -> np.ndarray:
    """The most frequent window keys, ascending. They decide where units meet, not what is a repeat."""
    counts = staged(docs.select("text").mapInArrow(_frequent, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "frequent-keys")
    return np.sort(np.array([r["key"] for r in frequent(counts, FREQUENT_KEYS)[0].collect()], np.int64).view(np.uint64))


def _documents(part: pa.RecordBatch) -> np.ndarray:
    """A number for each row's document, in the order of documents."""
    ids, parts = part.column("doc_id"), part.column("_part").to_numpy()
    place = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense").to_numpy().astype(np.int64)
    _, number = np.unique(np.stack([place, parts], 1), axis=0, return_inverse=True)
    return number.ravel()


def _repeats_inside(windows: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether a unit holds one window twice."""
    unit = np.full(len(windows), -1, np.int64)
    unit[np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(count.sum())] = np.repeat(np.arange(len(begin)), count)
    out = np.zeros(len(begin), bool)
    for lag in range(1, min(WINDOW, len(windows))):
        hit = np.flatnonzero(windows[lag:] == windows[:-lag])
        hit = hit[(unit[hit] == unit[hit + lag]) & (unit[hit] >= 0)]
        out[unit[hit]] = True
    return out


def _units(batches: Iterator[pa.RecordBatch], hot_keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=SLICE):
            w = words_of(part.column("text"))
            keys, hashes = window_keys(w)
            if not len(keys):
                continue
            text = w.text_of()[: len(keys)]
            valid = np.arange(len(keys)) + WINDOW <= w.first[1:][text]
            begin = np.flatnonzero(valid & np.concatenate([[True], (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])]))
            place = np.flatnonzero(valid)
            if not len(place):
                continue
            count = np.diff(np.append(np.searchsorted(place, begin), len(place)))
            parts = -(-count // WINDOW)  # periodic words make long units; no unit has more windows than a window has words
            step = (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * WINDOW
            begin, count = np.repeat(begin, parts) + step, np.minimum(np.repeat(count, parts) - step, WINDOW)
            inner = _repeats_inside(pooled(hashes, WINDOW, 5), begin, count)
            own = w.hashes(11)
            content, content2 = (_follow(x, begin, begin + count + WINDOW - 1) for x in (own, mix64(own, 12)))
            key, row, at = keys[begin], text[begin], begin - w.first[:-1][text[begin]]
            # of equal units in one slice only the earliest has to be brought together with others
            document = _documents(part)[row]
            order = np.lexsort((at, document, content2, content, key))
            again = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            again[a] = (key[a] == key[b]) & (content[a] == content[b]) & (content2[a] == content2[b]) & ((document[a] != document[b]) | (at[a] != at[b]))
            if len(hot_keys):
                hot = hot_keys[np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)] == key
                key, inner = np.where(hot, mix64(key + content, 10), key), inner | hot
            key = np.where(again, mix64(mix64(key, 8) + row.astype(np.uint64) * np.uint64(1 << 32) + at.astype(np.uint64), 9), key)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x.view(np.int64)) for x in (key, content, content2)), part.column("doc_id").take(row), part.column("_part").take(row), pa.array(at.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again), pa.array(inner)],
                names=["key", "content", "content2", "doc_id", "part", "at", "n", "sure", "inner"],
            )


def _with_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object, np.ndarray]]:
    """(document, payload, ranges) of each row, from rows (doc_id, part, kind, at, n, payload) sorted by the first three: a document's ranges, then its rows."""
    here, ranges = object(), []
    for batch in batches:
        ids, parts, kinds, ats, ns = (batch.column(i).to_pylist() for i in range(5))
        payload = batch.column(5)
        for i, (key, kind) in enumerate(zip(zip(ids, parts, strict=True), kinds, strict=True)):
            if key != here:
                here, ranges = key, []
            if kind:
                yield key, payload[i].as_py(), np.array(ranges, np.int64).reshape(-1, 2)
            else:
                ranges.append((ats[i], ns[i]))


def _windows(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(a, b, doc_id, part, at, sure) of every window in the ranges: 128-bit names; sure where an earlier equal one is at hand."""

    def flushed(held: list[tuple[object, str, np.ndarray]]) -> pa.RecordBatch:
        w = words_of(pa.array([x for _, x, _ in held], pa.large_string()))
        one, two = pooled(w.hashes(), WINDOW, 5), pooled(w.hashes(11), WINDOW, 7)
        place = [np.repeat(r[:, 0], r[:, 1]) + np.arange(r[:, 1].sum()) - np.repeat(np.cumsum(r[:, 1]) - r[:, 1], r[:, 1]) for _, _, r in held]
        row = np.repeat(np.arange(len(held)), [len(p) for p in place])
        at = np.concatenate(place)
        x, y = one[at + w.first[row]], two[at + w.first[row]]
        document = np.cumsum([k and held[k][0] != held[k - 1][0] for k in range(len(held))])[row]
        order = np.lexsort((at, document, y, x))  # documents come in order
        again = np.zeros(len(order), bool)
        i, j = order[1:], order[:-1]
        again[i] = (x[i] == x[j]) & (y[i] == y[j]) & ((document[i] != document[j]) | (at[i] != at[j]))
        x = np.where(again, mix64(x + row.astype(np.uint64) * np.uint64(1 << 32) + at.astype(np.uint64), 9), x)
        ids, parts = (pa.array([k[i] for k, _, _ in held], t).take(pa.array(row)) for i, t in ((0, kind), (1, pa.int64())))
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), ids, parts, pa.array(at.astype(np.int32)), pa.array(again)], names=["a", "b", "doc_id", "part", "at", "sure"])

    held, size = [], 0
    for key, text, ranges in _with_ranges(batches):
        if len(ranges):
            held.append((key, text or "", ranges))
            size += len(held[-1][1])
            if size > 1 << 20:
                yield flushed(held)
                held, size = [], 0
    if held:
        yield flushed(held)


def removed_mask(n_words: int, ranges: np.ndarray) -> np.ndarray:
    """Which words the windows starting in the ranges cover."""
    cover = np.zeros(n_words + WINDOW + 1, np.int64)
    inside = ranges[ranges[:, 0] + ranges[:, 1] + WINDOW - 1 <= n_words] if len(ranges) else ranges
    np.add.at(cover, inside[:, 0], 1)
    np.add.at(cover, inside[:, 0] + inside[:, 1] + WINDOW - 1, -1)
    return np.cumsum(cover[:n_words]) > 0


def _meeting(docs: DataFrame, ranges: DataFrame, payload: str) -> DataFrame:
    """Rows of documents and of their ranges side by side: one shuffle, no join."""
    rows = docs.select("doc_id", F.col("_part").alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("int").alias("n"), F.col(payload).alias("payload"))
    kind = dict(rows.dtypes)["payload"]
    marks = ranges.select("doc_id", "part", F.lit(0).alias("kind"), "at", "n", F.lit(None).cast(kind).alias("payload"))
    return rows.unionByName(marks).repartition("doc_id", "part").sortWithinPartitions(F.asc_nulls_last("doc_id"), "part", "kind")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, part, at, n): n windows from word at on that also stand earlier, of docs(doc_id, text, _part)."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    kind, arrow = dict(docs.dtypes)["doc_id"], to_arrow_type(docs.schema["doc_id"].dataType)
    held = spark.sparkContext.broadcast(frequent_keys(docs))  # FREQUENT_KEYS numbers at most
    units = docs.select("doc_id", "_part", "text").mapInArrow(lambda b: _units(b, held.value), UNITS.format(kind=kind))
    earlier = [F.asc_nulls_last("doc_id"), "part", "at"]
    same = F.rank().over(Window.partitionBy("key", "content", "content2").orderBy(*earlier))
    whole = Window.partitionBy("key")
    different = (F.min("content").over(whole) != F.max("content").over(whole)) | (F.min("content2").over(whole) != F.max("content2").over(whole))
    judged = units.withColumn("order", same).withColumn("mixed", different)
    found = judged.select("doc_id", "part", "at", "n", (F.col("sure") | (F.col("order") > 1)).alias("repeat"), "mixed", "inner").filter("repeat or mixed or inner")
    found = staged(found.select("doc_id", "part", "at", "n", "repeat"), "units")
    open_ = found.filter("not repeat")
    windows = _meeting(docs, open_, "text").mapInArrow(lambda b: _windows(b, arrow), f"a long, b long, doc_id {kind}, part long, at int, sure boolean")
    order = F.rank().over(Window.partitionBy("a", "b").orderBy(*earlier))
    single = windows.withColumn("order", order).filter("sure or order > 1").select("doc_id", "part", "at", F.lit(1).alias("n"))
    return found.filter("repeat").select("doc_id", "part", "at", "n").unionByName(staged(single, "windows"))


def _cut(docs: DataFrame, payload: str, make: Callable[[object, object, np.ndarray], dict | None], schema: str | object) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for (key, _), row, ranges in _with_ranges(batches):
            made = make(key, row, ranges)
            if made is not None:
                out.append(made)
                size += len(made.get("text") or "")
            if len(out) >= 2000 or size > 1 << 22:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return _meeting(docs, repeats(docs), payload).mapInArrow(run, shape)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, of every row."""

    def make(key: object, text: str | None, ranges: np.ndarray) -> dict:
        words = (text or "").encode().split()
        if len(ranges):
            gone = removed_mask(len(words), ranges)
            kept = [x for x, g in zip(words, gone.tolist(), strict=True) if not g]
        else:
            kept = words
        return {"doc_id": key, "n_words": len(words), "n_removed": len(words) - len(kept), "kept_sha256": hashlib.sha256(b" ".join(kept)).hexdigest()}

    return _cut(told_apart(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "text", make, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows with repeated passages cut out of their text; what is left keeps its own white space. A row of which nothing is left goes."""

    def make(key: object, row: dict, ranges: np.ndarray) -> dict | None:
        if not len(ranges):
            return row
        text = (row["text"] or "").encode()
        w = words_of(pa.array([row["text"]], pa.large_string()))
        gone = removed_mask(len(w.start), ranges)
        if gone.all():
            return None
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        cut, back = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        parts, at = [], 0
        for a, b in zip(cut.tolist(), back.tolist(), strict=True):
            parts.append(text[at : w.start[a]])
            at = w.start[b] if b < len(w.start) else len(text)
        made = row | {"text": b"".join([*parts, text[at:]]).decode("utf-8", "replace")}
        if "n_chars" in row:
            made["n_chars"] = len(made["text"])
        return made

    rows = told_apart(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_row")))
    return _cut(rows, "_row", make, docs.schema)
