"""MinHash fingerprints: universal hash permutations over word shingles, in numpy.

A text's shingles are its runs of five consecutive words (the whole sequence if it has fewer). Each of 128 hash functions
``(a * x + b) mod 2**64 >> 32`` keeps its least value over the shingles; the shares of equal values of two fingerprints
estimate the Jaccard likeness of their shingle sets. ``near_duplicates`` joins bands of the signatures in Spark; ``likeness``
verifies the Jaccard likeness on the texts and finds the links that bands miss; one row a document has the id of its class.

Defined cases: null is the empty text; all texts without words share one fingerprint (every value at its maximum) and
are alike at 1; equal texts have equal fingerprints; repeated ids go by text, then the order is arbitrary among equals.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm import likeness
from meshlens.llm.components import first_rows, row_key
from meshlens.llm.shared import mix64, ship, staged

PERMUTATIONS = 128
_RNG = np.random.default_rng(8)
MULTIPLY = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
ADD = _RNG.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
NONE = np.uint32(2**32 - 1)


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of 128 32-bit values a text."""
    return signed(*likeness.shingle_sets(texts))


def signed(shingles: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.full((len(first) - 1, PERMUTATIONS), NONE, np.uint32)
    filled = np.flatnonzero(np.diff(first))
    if len(filled):
        begin = first[:-1][filled]
        for k in range(PERMUTATIONS):
            values = ((shingles * MULTIPLY[k] + ADD[k]) >> np.uint64(32)).astype(np.uint32)
            out[filled, k] = np.minimum.reduceat(values, begin)
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1) if len(a) else np.zeros(0)


def as_hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u4").tobytes().hex() for r in rows]


# ------------------------------------------------------------- fingerprints of texts, edited texts and neighbours


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """Rows for all but the last text, each of which has the one after it as its neighbour."""
    edited = [_edit(a, b) for a, b in zip(texts, texts[1:], strict=False)]
    own, other = signatures(pa.array(texts, pa.large_string())), signatures(pa.array(edited, pa.large_string()))
    n = len(edited)
    return pa.RecordBatch.from_arrays(
        [pa.array(v, t) for v, (_, t) in zip((ids[:n], [len(x) for x in texts[:n]], [hashlib.sha256(x.encode()).hexdigest() for x in edited], as_hex(own[:n]), as_hex(other), agreement(own[:n], other), agreement(own[:n], own[1:])), FIELDS, strict=True)],
        names=[f for f, _ in FIELDS],
    )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, ghost, doc_id, text) sorted by range and id: a ghost is the first row of the next range and only looked at."""
    ids: list[int] = []
    texts: list[str] = []
    size, here = 0, None
    for batch in batches:
        for number, ghost, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here is not None and number != here:
                if len(texts) > 1:
                    yield _compared(ids, texts)
                ids, texts, size = [], [], 0
            here = number
            ids.append(key)
            texts.append(text or "")
            size += len(texts[-1])
            if size > 1 << 21 and len(texts) > 1:
                yield _compared(ids, texts)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield _compared(ids, texts)


def with_neighbours(docs: DataFrame, rows_a_range: int = 500, most_ranges: int = 1 << 14) -> DataFrame:
    """Every row beside the next one by doc_id (after the last: the first), from ranges of ids sorted by themselves: one shuffle of the texts.

    Only the ranges' bounds and least ids go to the driver, two numbers a range, of which there are at most most_ranges.
    A range is read as a sorted stream, so its length is no matter of memory.
    """
    spark = docs.sparkSession
    ship(spark)
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))  # null ids come first
    ids = docs.select(place.alias("place"))
    n = ids.count()
    if not n:
        return spark.createDataFrame([], DDL)
    ranges = min(most_ranges, n // rows_a_range + 1)
    cuts = ids.approxQuantile("place", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    heads = sorted((r, least) for r, least in ids.groupBy(_range_of(F.col("place"), cuts).alias("r")).agg(F.min("place")).collect())
    # the least row of each range, by (doc_id, text), is also shown at the end of the range before it
    shown = spark.createDataFrame([(least, heads[i - 1][0]) for i, (_, least) in enumerate(heads)], "least long, shown_in int")
    base = docs.select(_range_of(place, cuts).alias("r"), place.alias("place"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ghosts = base.join(F.broadcast(shown), base["place"] == shown["least"]).groupBy("place", "shown_in").agg(F.min("text").alias("text"))
    ghosts = ghosts.select(F.col("shown_in").alias("r"), F.lit(True).alias("ghost"), "place", F.col("place").alias("doc_id"), "text")
    dealt = base.select("r", F.lit(False).alias("ghost"), "place", "doc_id", "text").unionByName(ghosts)
    return dealt.repartition("r").sortWithinPartitions("r", "ghost", "place", "text").drop("place").mapInArrow(_neighbours, DDL)


def _range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the value, by halving."""
    if not cuts:
        return F.lit(0)
    table = F.lit(cuts)

    def halve(at: Column, _: Column) -> Column:
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        above = F.get(table, mid) <= value
        return F.when(at["lo"] >= at["hi"], at).when(above, F.struct((mid + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(F.struct(at["lo"].alias("lo"), mid.alias("hi")))

    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi")), halve, lambda at: at["lo"])


# ------------------------------------------------------------- near duplicates


def _bands(shingles: np.ndarray, first: np.ndarray, bands: int) -> list[np.ndarray]:
    """One hash for each band of each text's signature."""
    values = signed(shingles, first).reshape(len(first) - 1, bands, -1).astype(np.uint64)
    h = np.zeros(values.shape[:2], np.uint64)
    for k in range(values.shape[2]):
        h = mix64(h + values[:, :, k], k)
    return list((h + np.arange(bands, dtype=np.uint64)[None, :]).view(np.int64))


def _met(nodes: DataFrame) -> DataFrame:
    """Each member of a band's bucket with the least one."""
    banded = nodes.select("node", F.explode("keys").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1").select("band", "a")
    return banded.join(least, "band").filter("a != node").select("a", F.col("node").alias("b"))


def near_groups(docs: DataFrame, threshold: float = likeness.THRESHOLD, bands: int = 16) -> DataFrame:
    """(_row, doc_id, component) of every different row: bands joined in Spark, Jaccard verified, and the links that bands miss."""
    return likeness.groups(docs, lambda shingles, first: _bands(shingles, first, bands), _met, threshold)


def near_duplicates(docs: DataFrame, threshold: float = likeness.THRESHOLD, bands: int = 16) -> DataFrame:
    """(doc_id, class_id) of every row: class_id is the least doc_id of its component (of one without ids: the component)."""
    groups = staged(near_groups(docs, threshold, bands), "minhash-groups")
    named = groups.join(groups.groupBy("component").agg(F.min("doc_id").alias("class_id")), "component").select("_row", F.coalesce("class_id", "component").alias("class_id"))
    return row_key(docs.select("doc_id", "text")).select("_row", "doc_id").join(named, "_row").select("doc_id", "class_id")


def keep_first(docs: DataFrame, threshold: float = likeness.THRESHOLD) -> DataFrame:
    """One row of each component."""
    return first_rows(docs, staged(near_groups(docs, threshold), "minhash-groups"))
