"""Connected components of a link table, and links found inside buckets without writing all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import staged


def connected(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): component is the least node reachable.

    Each round, every node takes its least neighbour (or itself) as parent, parents are followed twice, and links are
    drawn anew between parents; all nodes but local minima go, so the table at least halves. Minima are taken by partial
    aggregation and parents joined by shuffles that Spark can split, so a node with very many links is no hot spot.
    Rounds end in the shared folder; a lost executor costs at most one round. An empty table gives an empty result.
    """
    edges = staged(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    named = None
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
        parent = staged(ends.groupBy("v").agg(F.min("w").alias("w")).select("v", F.least("v", "w").alias("p")), "parents")
        for _ in range(2):
            above = parent.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(above, "p").select("v", F.col("pp").alias("p"))
        parent = staged(parent, "parents")
        pa_, pb_ = parent.select(F.col("v").alias("a"), F.col("p").alias("x")), parent.select(F.col("v").alias("b"), F.col("p").alias("y"))
        edges = staged(edges.join(pa_, "a").join(pb_, "b").filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if named is None:
            named = parent.select(F.col("v").alias("node"), F.col("p").alias("component"))
        else:
            up = parent.select(F.col("v").alias("component"), F.col("p"))
            named = staged(named.join(up, "component", "left").select("node", F.coalesce("p", "component").alias("component")), "components")
    if named is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return named


def row_key(docs: DataFrame) -> DataFrame:
    """docs with _row: 128 bits of id and text, so that rows of no or of one id with different texts are told apart."""
    part = lambda c: F.when(F.col(c).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(c).cast("string"), F.lit("\0")))
    return docs.withColumn("_row", F.unhex(F.md5(F.concat(part("doc_id"), part("text")).cast("binary"))))


def first_rows(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One row of docs for each component of groups(_row, doc_id, component): that of the least doc_id (null last), then of the least key. The texts move once."""
    place = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row"))
    first = staged(groups.groupBy("component").agg(F.min_by("_row", place).alias("_row")).select("_row"), "first-rows")
    named = row_key(docs.select("doc_id", "text", F.struct(*docs.columns).alias("_all"))).select("_row", "_all")
    return named.join(first, "_row", "left_semi").groupBy("_row").agg(F.first("_all").alias("_all")).select("_all.*")


def code_trees(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """trees() for 64-bit codes linked at so many differing bits at most."""
    left = codes[1:]
    queue, a, b = [codes[0]], [], []
    while queue or len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        x = queue.pop()
        if len(left):
            hit = np.bitwise_count(left ^ x) <= most
            if hit.any():
                found = left[hit]
                a.append(np.full(len(found), x, np.uint64))
                b.append(found)
                queue.extend(found)
                left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


LINKS = "a long, b long, refine boolean"
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("refine", pa.bool_())])


def code_links(batches: Iterator[pa.RecordBatch], most: int, largest: int, lag: int = 24) -> Iterator[pa.RecordBatch]:
    """Links between 64-bit codes in one bucket, from rows (key, code) sorted by both.

    Small buckets are compared at each lag at once, larger ones by a spanning forest; of a bucket of more than ``largest``
    different codes each code is given back with refine set, so that nothing unbounded is held.
    """

    def batch_of(a: np.ndarray, b: np.ndarray, refine: bool = False) -> pa.RecordBatch:
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0].astype(np.int64)), pa.array(both[:, 1].astype(np.int64)), pa.array(np.full(len(both), refine))], schema=_LINKS)

    def within(keys: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(begin, len(keys)))
        small = np.repeat((sizes > 1) & (sizes <= lag), sizes)
        k, c, a, b = keys[small], codes[small], [], []
        for step in range(1, min(lag, int(sizes.max()))):
            hit = (k[step:] == k[:-step]) & (np.bitwise_count(c[step:] ^ c[:-step]) <= most)
            a.append(c[:-step][hit])
            b.append(c[step:][hit])
        if a:
            yield batch_of(np.concatenate(a), np.concatenate(b))
        for i in np.flatnonzero(sizes > lag):
            yield batch_of(*code_trees(codes[begin[i] : begin[i] + sizes[i]], most))

    held_keys, held, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        keys, codes = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
        if over is not None:  # the rest of a bucket that is too large
            rest = keys == over
            if rest.any():
                yield batch_of(codes[rest], codes[rest], True)
                keys, codes = keys[~rest], codes[~rest]
            if len(keys):
                over = None
        keys, codes = np.concatenate([held_keys, keys]), np.concatenate([held, codes])
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (codes[1:] != codes[:-1])]) if len(keys) else np.zeros(0, bool)
        keys, codes = keys[new], codes[new]
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from within(keys[:last], codes[:last])
        held_keys, held = keys[last:], codes[last:]
        if len(held) > largest:
            over = held_keys[0]
            yield batch_of(held, held, True)
            held_keys, held = held_keys[:0], held[:0]
    if len(held):
        yield from within(held_keys, held)
