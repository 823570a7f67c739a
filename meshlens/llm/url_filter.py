"""URL rules in a sorted digest array.

Every rule is a key ``host + path``. The 64-bit xxhash of the keys, sorted, lie in one file with the keys themselves;
executors map that file into memory. A URL is probed with the host suffixes and path prefixes whose lengths some rule has,
so with no more keys than the rules have pairs of lengths, however long it is, by vectorised binary search; a hit counts only if the stored string equals the probed one, so collisions do no harm.

Defined cases: a null URL, or one without ``://``, has empty host and path and meets no rule. The longest rule (host and
path together) wins; of equal rules the later one given. URLs that no rule fits get the default verdict.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.llm.shared import ship

_OPEN: dict[str, DigestArray] = {}


def write_digests(path: str, rules: Iterable[tuple[str, str, str]]) -> None:
    """The file for rules of (verdict, host, path): counts, digests ascending, offsets, verdicts, strings."""
    last = {f"{host}{at}": (verdict == "allow", len(host), len(at)) for verdict, host, at in rules}
    rows = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), *v) for k, v in last.items())
    shapes = sorted({(r[3], r[4]) for r in rows})  # lengths of host and path
    with open(path, "wb") as f:
        f.write(struct.pack("<3q", len(rows), len(shapes), sum(len(r[1]) for r in rows)))
        f.write(np.array([r[0] for r in rows], "<u8").tobytes())
        f.write(np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<i8").tobytes())
        f.write(np.array([r[2] for r in rows], "<i8").tobytes())
        f.write(np.array(shapes, "<i8").reshape(-1, 2).tobytes())
        f.write(b"".join(r[1] for r in rows))


class DigestArray:
    """The mapped file; find() takes byte strings and gives rule numbers, -1 where there is none."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, shapes, _ = struct.unpack_from("<3q", self.map, 0)
        at = 24
        self.digests = np.frombuffer(self.map, "<u8", n, at)
        self.offsets = np.frombuffer(self.map, "<i8", n + 1, at + 8 * n)
        self.allows = np.frombuffer(self.map, "<i8", n, at + 16 * n + 8)
        self.lengths: dict[int, list[int]] = {}
        for host, path_ in np.frombuffer(self.map, "<i8", 2 * shapes, at + 24 * n + 8).reshape(-1, 2).tolist():
            self.lengths.setdefault(host, []).append(path_)
        self.strings = at + 24 * n + 8 + 16 * shapes

    def string(self, i: int) -> bytes:
        return self.map[self.strings + int(self.offsets[i]) : self.strings + int(self.offsets[i + 1])]

    def find(self, keys: list[bytes]) -> np.ndarray:
        if not len(self.digests) or not keys:
            return np.full(len(keys), -1)
        probes = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, probes)
        found = np.full(len(keys), -1)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == probes):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == probes[i]:  # equal digests lie side by side
                if self.string(j) == keys[i]:
                    found[i] = j
                    break
                j += 1
        return found


def probes(host: str, path: str, lengths: dict[int, list[int]]) -> list[bytes]:
    """Every key that a rule fitting this host and path could have, from the path lengths of each host length."""
    fit = [n for n in lengths if 0 < n <= len(host) and (n == len(host) or host[-n - 1] == ".")]
    return [(host[-n:] + path[:m]).encode() for n in fit for m in lengths[n] if m <= len(path)]


def _opened(name: str) -> DigestArray:
    if name not in _OPEN:
        _OPEN[name] = DigestArray(SparkFiles.get(name))
    return _OPEN[name]


def _verdicts(batches: Iterator[pa.RecordBatch], name: str, default: str) -> Iterator[pa.RecordBatch]:
    table = _opened(name)
    for batch in batches:
        hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        keys: dict[tuple[str, str], list[bytes]] = {}
        for pair in zip(hosts, paths, strict=True):
            if pair not in keys:
                keys[pair] = probes(*pair, table.lengths)
        flat = list(dict.fromkeys(k for ks in keys.values() for k in ks))
        hit = {k: int(i) for k, i in zip(flat, table.find(flat), strict=True) if i >= 0}
        rules, verdicts = [], []
        for pair in zip(hosts, paths, strict=True):
            best = max((k for k in keys[pair] if k in hit), key=lambda k: len(k.decode()), default=None)
            rules.append(best.decode() if best is not None else None)
            verdicts.append(default if best is None else "allow" if table.allows[hit[best]] else "block")
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=[*batch.schema.names, "rule", "verdict"])


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row. Narrow: no shuffle. The rule file goes once to each executor."""
    spark: SparkSession = pages.sparkSession
    ship(spark)
    path = os.path.join(tempfile.mkdtemp(prefix="meshlens-"), f"digests-{uuid.uuid4().hex}.bin")
    write_digests(path, rules)
    spark.sparkContext.addFile(path)
    url = F.col(url_col)
    rest = F.when(url.contains("://"), F.expr(f"substring(`{url_col}`, locate('://', `{url_col}`) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    cut = pages.select(F.col(id_col), F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))
    name = os.path.basename(path)
    kind = dict(pages.dtypes)[id_col]
    return cut.mapInArrow(lambda batches: _verdicts(batches, name, default), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
