"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A fingerprint is cut into three segments of 23, 23 and 18 bits. The perfect (23, 12) Golay code names every 23-bit word
by its nearest codeword; a word at distance 3 has five more codewords at distance 4. Words that differ in one bit have a
codeword in common among these one or six, so a segment with at most one error still gives an equal 12-bit key.

Three errors over three segments leave either one segment without error and a second with at most one, or one error in
each. Keys are therefore (exact segment, fuzzy segment) for the six ordered pairs, and (fuzzy, fuzzy, exact half of the
third) twice: one half of the third segment holds no error. Codes that share a key are compared in full. A bucket of more
codes than fit a task goes on under exact keys of 13 of 16 nibbles, of which at most 2**12 different codes share one.

Defined cases: null and empty texts, and texts without words, have fingerprint zero and are linked like any other; fewer
than three words count as one shingle; equal fingerprints are one node, so copies need no pairs; repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm import likeness
from meshlens.llm.components import LINKS, code_links, connected, first_rows
from meshlens.llm.shared import bytes_of, ship, slices, staged

SHINGLE, SEED, MOST_BITS, LARGEST = 3, 42, 3, 20_000
#: Generator polynomial of the binary Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


@cache
def _remainders() -> np.ndarray:
    """Syndromes of all 23-bit words."""
    r = np.arange(1 << 23, dtype=np.int32)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r.astype(np.int16)


@cache
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome: what to add to a word to reach its codewords within 4 bits (nearest first), and how many there are."""
    single = [int(_remainders()[1 << i]) for i in range(23)]
    table, count = np.zeros((2048, 6), np.int32), np.zeros(2048, np.int64)
    for weight in range(5):
        for places in combinations(range(23), weight):
            s = e = 0
            for p in places:
                s ^= single[p]
                e |= 1 << p
            if weight < 4 or count[s]:
                table[s, count[s]] = e
                count[s] += 1
    return table, count


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword numbers (12 bits) of 23-bit words: six columns, of which the first so many count."""
    table, count = _patterns()
    s = _remainders()[words]
    return (words[:, None] ^ table[s]) >> 11, count[s]


def golay_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, position of its code) of all codes."""
    u = codes.astype(np.uint64)
    seg = [(u >> np.uint64(a) & np.uint64((1 << b) - 1)).astype(np.int64) for a, b in ((0, 23), (23, 23), (46, 18))]
    near = [nearby(s) for s in seg]
    every = np.arange(len(u))
    keys, at = [], []
    kind = 0
    for y in range(3):
        names, count = near[y]
        for j in range(6):
            use = every[count > j] if j else every
            for k, x in enumerate(i for i in range(3) if i != y):
                keys.append((np.int64(kind + k) << 58) | seg[x][use] << 12 | names[use, j])
                at.append(use)
        kind += 2
    (na, ca), (nb, cb) = near[0], near[1]
    for i in range(6):
        for j in range(6):
            use = every[(ca > i) & (cb > j)]
            both = na[use, i].astype(np.int64) << 12 | nb[use, j]
            for half in range(2):
                keys.append((np.int64(kind + half) << 58) | both << 9 | (seg[2][use] >> (9 * half) & 511))
                at.append(use)
    return np.concatenate(keys), np.concatenate(at)


NIBBLES = list(combinations(range(16), 13))


def exact_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 13 nibbles out of 16: codes at most three bits apart share one, and at most 2**12 codes share any."""
    u = codes.astype(np.uint64)
    keys = []
    for n, kept in enumerate(NIBBLES):
        mask = np.uint64(sum(15 << (4 * i) for i in kept))
        h = u & mask
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n * 0xBF58476D1CE4E5B9 % 2**64)
        keys.append(h.view(np.int64))
    return np.concatenate(keys), np.tile(np.arange(len(u)), len(NIBBLES))


def _keyed(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column(0).to_numpy()
        for i in range(0, len(every), 500 if exact else 4000):
            part = every[i : i + (500 if exact else 4000)]
            keys, at = (exact_keys if exact else golay_keys)(part)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[at])], names=["key", "code"])


def code_pairs(codes: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(a, b): links of different 64-bit codes within three bits, as spanning forests of buckets."""
    ship(codes.sparkSession)

    def found(df: DataFrame, exact: bool) -> DataFrame:
        keyed = df.mapInArrow(lambda b: _keyed(b, exact), "key long, code long")
        return keyed.repartition("key").sortWithinPartitions("key", "code").mapInArrow(lambda b: code_links(b, MOST_BITS, 1 << 62 if exact else largest), LINKS)

    links = staged(found(codes, False), "golay-links")
    again = links.filter("refine").select(F.col("a").alias("code")).distinct()
    return links.filter("not refine").select("a", "b").unionByName(found(again, True).select("a", "b"))


def code_components(codes: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(node, component) of the different 64-bit codes that have a neighbour within three bits."""
    return connected(code_pairs(codes, largest))


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes."""
    out = np.zeros(len(first) - 1, np.uint64)
    if len(hashes):
        counts = np.diff(first)
        lanes = np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        row = np.repeat(np.arange(len(out)) * 256, counts)
        # how often each byte value stands in each lane of a text, times the bits of that value
        ones = np.concatenate([np.bincount(row + lanes[:, k], minlength=256 * len(out)).reshape(-1, 256) @ BYTE_BITS for k in range(8)], axis=1)
        out[:] = np.packbits(2 * ones > counts[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(texts)
    raw = data.tobytes().lower()  # of bytes: A-Z only
    digest = xxhash.xxh64_intdigest
    hashes, first = [], [0]
    for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
        words = raw[a:b].split()
        if len(words) > SHINGLE:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            hashes += [digest(line[s:e], SEED) for s, e in zip([0, *ends[: -SHINGLE].tolist()], (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
        elif words:
            hashes.append(digest(b" ".join(words), SEED))
        first.append(len(hashes))
    return majority(np.array(hashes, np.uint64), np.array(first))


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(part.column("text")).view(np.int64))], names=["doc_id", "code"])


def near_groups(docs: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(doc_id, code, component_id) of every row: component_id is the least doc_id reachable over links of three bits."""
    ship(docs.sparkSession)
    prints = staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_fingerprinted, "doc_id long, code long"), "simhash")
    codes = staged(prints.groupBy("code").agg(F.min("doc_id").alias("rep")), "simhash-codes")
    labels = code_components(codes.select("code"), largest).withColumnRenamed("node", "code")
    named = codes.join(labels, "code", "left").withColumn("component", F.coalesce("component", "code"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = staged(named.join(least, "component").select("code", "component_id"), "simhash-named")
    return prints.join(named, "code").select("doc_id", "code", "component_id")


def _codes(shingles: np.ndarray, first: np.ndarray) -> list[list[int]]:
    return majority(shingles, first).view(np.int64)[:, None].tolist()


def _linked(nodes: DataFrame) -> DataFrame:
    """Nodes of one code with the least one of it, and these of codes within three bits."""
    coded = nodes.select("node", F.element_at("keys", 1).alias("code"))
    least = staged(coded.groupBy("code").agg(F.min("node").alias("a")), "simhash-least")
    same = coded.join(least, "code").filter("a != node").select("a", F.col("node").alias("b"))
    pairs = code_pairs(least.select("code"))
    ends = [least.select(F.col("code").alias(c), F.col("a").alias(n)) for c, n in (("a", "x"), ("b", "y"))]
    return same.unionByName(pairs.join(ends[0], "a").join(ends[1], "b").select(F.col("x").alias("a"), F.col("y").alias("b")))


def keep_first(docs: DataFrame, threshold: float = likeness.THRESHOLD) -> DataFrame:
    """One row of each group of texts alike on five-word shingles: that of the least doc_id (null last).

    Fuzzy keys find the candidates within three bits; at a likeness of 0.8, where about ten bits differ, they find one in a
    hundred, so ``likeness`` verifies them and finds the rest exactly.
    """
    return first_rows(docs, staged(likeness.groups(docs, _codes, _linked, threshold), "simhash-groups"))
