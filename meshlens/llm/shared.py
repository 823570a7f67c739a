"""What the operators of this package share: staged tables, shipping the package, words as numpy arrays.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the regular expression
``[^\\x20\\x09-\\x0D]+`` over code points.
"""

from __future__ import annotations

import ctypes
import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED: set[str] = set()
_BATCH_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; one of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="meshlens-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there and it is computed once.

    Nothing else reads the shuffles of that write, so Spark may delete their files when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each Spark application, and bounds the bytes of a batch that goes to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", _BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    made = io.BytesIO()
    with zipfile.ZipFile(made, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    path = os.path.join(tempfile.mkdtemp(prefix="meshlens-"), "meshlens.zip")
    Path(path).write_bytes(made.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def told_apart(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) with _part: 0, but for rows without id, or whose id stands with different texts: a hash of the text.

    Such ids are found by an aggregation of one number a row; only where there are any do the texts meet them in a join.
    """
    own = docs.select("doc_id", F.xxhash64(F.lit(1), "text", F.col("text").isNull()).alias("_h")).filter("doc_id is not null")
    many = staged(own.groupBy("doc_id").agg(F.min("_h").alias("a"), F.max("_h").alias("b")).filter("a != b").select(F.col("doc_id").alias("_many")), "many-texts")
    if not many.isEmpty():
        docs = docs.join(many, F.col("doc_id") == F.col("_many"), "left")
        several = F.col("_many").isNotNull() | F.col("doc_id").isNull()
    else:
        several = F.col("doc_id").isNull()
    return docs.withColumn("_part", F.when(several, F.xxhash64(F.lit(1), "text", F.col("text").isNull())).otherwise(F.lit(0).cast("long"))).drop("_many")


def frequent(counts: DataFrame, most: int, least: int = 0) -> tuple[DataFrame, int]:
    """Rows of counts(..., n) from a power of two of n on, and that power: the least that ``most`` rows at most reach, or else the largest that ``least`` rows do.

    Found from one number for each power of two, so nothing is sorted and no task or driver sees more than the rows given back.
    """
    bins = {r["b"]: r["rows"] for r in counts.groupBy(F.length(F.bin("n")).alias("b")).agg(F.count("*").alias("rows")).collect()}  # 64 rows at most
    held, cut = 0, 65
    for b in range(64, 0, -1):
        if held + bins.get(b, 0) > most and held >= least:
            break
        held, cut = held + bins.get(b, 0), b
        if least and held >= least:
            break
    return counts.filter(F.length(F.bin("n")) >= cut), cut


def word_count(text: Column) -> Column:
    """Number of words of a text, in the JVM (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- words in numpy

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Words of more bytes are named by one digest.
_LONG = 64
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            made = np.full(max(n, 1 << 16), base, np.uint64)
            made[0] = 1
            _POWERS[k] = np.multiply.accumulate(made)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pooled(values: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hashes of all windows of so many consecutive values (one fewer for each extra element)."""
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix64((total[length:] - total[:n]) * down[:n], salt + length)


@dataclass
class Words:
    """Words of some texts: byte ranges in data, and where each text's words begin (first has one more entry than there are texts)."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    def _lanes(self) -> np.ndarray:
        """The eight bytes from each byte on, as one number."""
        return np.ndarray((len(self.data) + 1,), "<u8", np.concatenate([self.data, np.zeros(8, np.uint8)]), strides=(1,))

    def hashes(self, salt: int = 0) -> np.ndarray:
        """64-bit names: eight bytes after eight are mixed in, so words of equal length up to eight bytes never collide."""
        size, lanes = self.end - self.start, self._lanes()
        out = mix64(mix64(lanes[self.start] & _MASK[np.minimum(size, 8)], salt) + size.astype(np.uint64), salt + 1)
        for step in range(8, _LONG, 8):
            at = np.flatnonzero(size > step)
            if not len(at):
                return out
            out[at] = mix64(out[at] ^ (lanes[self.start[at] + step] & _MASK[np.minimum(size[at] - step, 8)]), salt + 1)
        for i in np.flatnonzero(size > _LONG):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i] : self.end[i]], salt)
        return out

    def numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """A number for each word, equal for equal words only (names are confirmed on the bytes), and a place where each number stands."""
        _, at, number = np.unique(self.hashes(), return_index=True, return_inverse=True)
        size, lanes, one = self.end - self.start, self._lanes(), at[number]
        differ = size != size[one]
        for step in range(0, _LONG, 8):
            i = np.flatnonzero((size > max(step, 8)) & ~differ)
            if not len(i):
                break
            differ[i] = (lanes[self.start[i] + step] ^ lanes[self.start[one[i]] + step]) & _MASK[np.minimum(size[i] - step, 8)] != 0
        for i in np.flatnonzero((size > _LONG) & ~differ & (np.arange(len(size)) != one)):
            differ[i] = not np.array_equal(self.data[self.start[i] : self.end[i]], self.data[self.start[one[i]] : self.end[one[i]]])
        again: dict[bytes, int] = {}
        places = at.tolist()
        for i in np.flatnonzero(differ).tolist():
            word = self.data[self.start[i] : self.end[i]].tobytes()
            if word not in again:
                again[word] = len(places)
                places.append(i)
            number[i] = again[word]
        return number, np.array(places, np.int64)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and their offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array) -> Words:
    data, offsets = bytes_of(texts)
    solid = ~_SPACE[data]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[filled] = False
    after[:-1] = solid[1:]
    after[filled[1:] - 1] = False
    start = np.flatnonzero(solid & ~before)
    return Words(data, offsets, start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(start, offsets))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about so many bytes of text, one row at least: bounds the arrays made from them."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    begun, held = 0, 0
    for i, n in enumerate(sizes):
        if i > begun and held + n > most:
            yield batch.slice(begun, i - begun)
            begun, held = i, 0
        held += n
    if begun < len(sizes):
        yield batch.slice(begun)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task would else keep it beside the JVM's."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)
