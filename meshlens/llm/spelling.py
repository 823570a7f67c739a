"""Spelling variants: words one edit apart, found by bands of letter-parity masks.

A word's mask has a bit for each of 63 letter classes, set if the word holds an odd number of its letters. One inserted or
deleted letter flips one bit; a replaced one flips two, or none where both letters share a class. The mask is split into
three bands of 21 bits, so two words one edit apart agree in one band at least. Words meet in cells of an equal band, of the
band after it and of equal length, in one of three ways, by which each near pair meets in exactly one cell:

* 0 stored: both words stand in the cell itself; nothing or two bits of the third band differ (replaced).
* 1 replaced: one bit of the second band and one of the third differ. The word that holds the replaced letter of the second
  band comes to the other's cell by flipping the bits of its own letters there, one at a time.
* 2 shorter: a word comes to the cell of words one letter longer; one bit of the third band differs.

Cells are compared as sorted streams, masks first, then letters; a cell of more than ``largest`` stored words is dealt to
slices, to which the others come as kind 3. Only a word's count and best partner of a cell leave it, never its pairs.

Defined cases: a null text has no words, a null id is written as the empty text before the colon; repeated rows count as
often as they stand; an empty table, or one without words that are long and frequent enough, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import give_back, ship, staged

#: What a run of letters is, which share of runs loses a letter, and which words take part.
RUN, EVERY, SHORTEST, LEAST, FACTOR = "[A-Za-zÀ-ÿ]+", 31, 7, 2, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS, LARGEST = 21, 1 << 16
_LONGEST = (1 << 20) - 1


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Band and bit in its band of each Latin-1 code point: letters are dealt to the bands in turn."""
    band, bit = np.zeros(256, np.int64), np.zeros(256, np.int64)
    for i, point in enumerate([*range(97, 123), *range(0xC0, 0x100)]):
        band[point], bit[point] = i % 3, i // 3 % BITS
    return band, bit


_BAND, _BIT = _letters()
_FLIP = np.uint64(1) << (_BAND * BITS + _BIT).astype(np.uint64)
_LOW = np.uint64((1 << BITS) - 1)


def words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of every word of at least 7 letters that stands twice or more. Counted map-side first; one shuffle of different words."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("_run"))
    runs = runs.filter(F.char_length("_run") >= SHORTEST).withColumn("_run", F.translate("_run", UPPER, LOWER))
    h = F.crc32(F.concat("_id", F.lit(":"), "_run"))
    at = (h % F.char_length("_run")).cast("int")
    cut = F.concat(F.substring("_run", F.lit(1), at), F.substring(F.col("_run"), at + 2, F.char_length("_run")))
    counted = runs.select(F.when(h % EVERY == 0, cut).otherwise(F.col("_run")).alias("word")).filter(F.char_length("word") >= SHORTEST)
    return counted.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST)


# ------------------------------------------------------------- cells


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all words end to end, and where each begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def _cell(z: int, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for a band, its value, the next band's value and a length."""
    return ((np.uint64(z) << np.uint64(62)) | (first << np.uint64(41)) | (second << np.uint64(20)) | np.minimum(size, _LONGEST).astype(np.uint64)).view(np.int64)


def _to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cells that each word (Latin-1 letters, n) stands in or comes to."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, at = _flat(batch.column(0))
        size = np.diff(at)
        mask = np.bitwise_xor.reduceat(_FLIP[data], at[:-1])
        bands = [(mask >> np.uint64(BITS * k)) & _LOW for k in range(3)]
        # each word's different letter classes: (word, band, bit)
        owner = np.repeat(np.arange(len(size)), size)
        own = np.unique(owner * 63 + _BAND[data] * BITS + _BIT[data])
        owner, band, flip = own // 63, own % 63 // BITS, np.uint64(1) << (own % BITS).astype(np.uint64)
        for z in range(3):
            x, y = (z + 1) % 3, (z + 2) % 3
            row = owner[band == x]
            keys = [_cell(z, bands[z], bands[x], size), _cell(z, bands[z][row], bands[x][row] ^ flip[band == x], size[row]), _cell(z, bands[z], bands[x], size + 1)]
            rows = np.concatenate([np.arange(len(size)), row, np.arange(len(size))])
            kind = np.repeat(np.arange(3, dtype=np.int8), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.zeros(len(rows), np.int32)), pa.array(kind), pa.array(bands[y][rows].astype(np.int32)), *(c.take(pa.array(rows)) for c in batch.columns)],
                names=["cell", "slice", "kind", "rest", "letters", "n"],
            )


CELLS = "cell long, slice int, kind byte, rest int, letters binary, n long"


def _sliced(rows: DataFrame, largest: int) -> DataFrame:
    """Cells with more stored words than ``largest`` are dealt to slices by a hash; what comes to such a cell comes to each slice, and its own words to the later ones."""
    sizes = rows.filter("kind = 0").groupBy("cell").agg(F.count("*").alias("_held")).filter(F.col("_held") > largest)
    large = staged(sizes.select(F.col("cell").alias("_cell"), F.ceil(F.col("_held") / largest).cast("int").alias("_slices")), "spelling-large")
    if large.isEmpty():
        return rows
    met = rows.join(large, F.col("cell") == F.col("_cell"), "left")
    own = F.pmod(F.xxhash64("letters"), F.col("_slices")).cast("int")
    shown = F.when(F.col("kind") == 0, F.struct(own.alias("slice"), F.col("kind").alias("kind")))
    later = F.when((F.col("kind") == 0) & (own < F.col("_slices") - 1), F.transform(F.sequence(own + 1, F.col("_slices") - 1), lambda s: F.struct(s.alias("slice"), F.lit(3).cast("byte").alias("kind"))))
    every = F.transform(F.sequence(F.lit(0), F.col("_slices") - 1), lambda s: F.struct(s.alias("slice"), F.col("kind").alias("kind")))
    places = F.when(F.col("_slices").isNull(), F.array(F.struct("slice", "kind"))).when(F.col("kind") == 0, F.concat(F.array(shown), F.coalesce(later, F.array().cast("array<struct<slice:int,kind:tinyint>>")))).otherwise(every)
    return met.withColumn("_p", F.explode(places)).select("cell", "_p.slice", "_p.kind", "rest", "letters", "n")


def _differ_once(own: np.ndarray, stored: np.ndarray, band: int | None = None) -> np.ndarray:
    """Whether the words differ in one place, and there, if a band is given, own's letter is of it: of two words, only one came for this pair."""
    other = own != stored
    once = other.sum(axis=1) == 1
    return once if band is None else once & (_BAND[own[np.arange(len(own)), other.argmax(axis=1)]] == band)


def _one_longer(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each long word is the short one with one letter more: what agrees from the front and from the end covers the short one."""
    front = np.logical_and.accumulate(short == long[:, :-1], axis=1).sum(axis=1)
    end = np.logical_and.accumulate((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + end >= short.shape[1]


class _Cell:
    """The words of one cell, its stored ones first, and the near pairs found."""

    def __init__(self, cell: int, rest: np.ndarray, letters: list[bytes], n: np.ndarray) -> None:
        self.band = (cell >> 62 & 3) + 1  # the second band, from 1 on
        self.size = cell & _LONGEST
        self.first = self.band == 1  # equal masks meet in the cells of all three bands: only those of the first count
        self.rest, self.letters, self.n = rest, letters, n
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def matrix(self, rows: np.ndarray, size: int) -> np.ndarray:
        return np.frombuffer(b"".join(self.letters[i] for i in rows), np.uint8).reshape(len(rows), size)

    def meet(self, kind: int, own: np.ndarray, stored: np.ndarray) -> None:
        """Pairs of one row of own and one stored row that differ as the kind says."""
        if self.size < _LONGEST:  # longer words share a cell whatever their length
            self._same_size(kind, own, stored, self.size - (kind == 2), self.size)
            return
        by_size: dict[int, list[int]] = {}
        for i in own.tolist():
            by_size.setdefault(len(self.letters[i]), []).append(i)
        held: dict[int, list[int]] = {}
        for i in stored.tolist():
            held.setdefault(len(self.letters[i]), []).append(i)
        for size, rows in by_size.items():
            longer = size + (kind == 2)
            if longer in held:
                self._same_size(kind, np.array(rows), np.array(held[longer]), size, longer)

    def _same_size(self, kind: int, own: np.ndarray, stored: np.ndarray, size: int, longer: int) -> None:
        step = max(1, (1 << 20) // len(stored))
        whole = None
        for at in range(0, len(own), step):
            part = own[at : at + step]
            bits = np.bitwise_count(self.rest[part][:, None] ^ self.rest[stored][None, :])
            hit = bits == 1 if kind in (1, 2) else (bits == 2) | (bits == 0) if self.first else bits == 2
            if kind == 0:
                hit &= part[:, None] < stored[None, :]
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            if whole is None:
                whole = self.matrix(stored, longer)
            mine = self.matrix(part, size)
            many = max(1, (1 << 22) // longer)
            for k in range(0, len(i), many):
                p, q = i[k : k + many], j[k : k + many]
                near = _one_longer(mine[p], whole[q]) if kind == 2 else _differ_once(mine[p], whole[q], self.band % 3 if kind == 1 else None)
                self.a.append(part[p[near]])
                self.b.append(stored[q[near]])

    def found(self) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
        """Each word with a near one: how many, and the most frequent (the first by letters among equals)."""
        if not self.a:
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64), []
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        owner, other = np.concatenate([a, b]), np.concatenate([b, a])
        if not len(owner):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64), []
        met = np.unique(other).tolist()
        rank = np.zeros(len(self.letters), np.int64)
        rank[sorted(met, key=self.letters.__getitem__)] = np.arange(len(met))
        order = np.lexsort((rank[other], -self.n[other], owner))
        owners, at, many = np.unique(owner[order], return_index=True, return_counts=True)
        best = other[order][at]
        return [self.letters[i] for i in owners], many, self.n[best], [self.letters[i] for i in best]


FOUND = "letters binary, near long, best_n long, best binary"
_FOUND = pa.schema([("letters", pa.binary()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.binary())])


class _Stream:
    """The cell at hand of a sorted stream: its stored words, and what came to it and isn't compared yet."""

    def __init__(self) -> None:
        self.out: tuple[list, list, list, list] = ([], [], [], [])
        self.begin(None)

    def begin(self, here: tuple[int, int] | None) -> None:
        self.here, self.met = here, False
        self.stored: tuple[list, list, list] = ([], [], [])
        self.came: tuple[list, list, list] = ([], [], [])
        self.kinds: list[int] = []

    def add(self, kinds: np.ndarray, rest: np.ndarray, letters: pa.Array, n: np.ndarray) -> None:
        stored = int(np.searchsorted(kinds, 1))  # kinds ascend
        for rows, part in ((self.stored, slice(0, stored)), (self.came, slice(stored, None))):
            if self.stored[0] or rows is self.stored:  # where nothing is stored, nothing can be met
                for column, values in zip(rows, (rest[part].tolist(), letters[part].to_pylist(), n[part].tolist()), strict=True):
                    column.extend(values)
        if self.stored[0]:
            self.kinds.extend(kinds[stored:].tolist())
        if len(self.kinds) > 1 << 14:
            self.settle()

    def settle(self) -> None:
        """Compares the stored words with each other, once, and with all that came; words and counts go out."""
        if len(self.stored[0]) + len(self.kinds) > 1 and self.stored[0]:
            rest, letters, n = (a + b for a, b in zip(self.stored, self.came, strict=True))
            cell = _Cell(self.here[0], np.array(rest, np.int32), letters, np.array(n, np.int64))
            stored = np.arange(len(self.stored[0]))
            if not self.met:
                cell.meet(0, stored, stored)
            kinds = np.array(self.kinds, np.int8)
            for kind in (1, 2, 3):
                came = np.flatnonzero(kinds == kind) + len(stored)
                if len(came):
                    cell.meet(kind, came, stored)
            for column, values in zip(self.out, cell.found(), strict=True):
                column.extend(values)
            self.met = True
        self.came, self.kinds = ([], [], []), []

    def taken(self) -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(self.out, _FOUND, strict=True)], schema=_FOUND)
        self.out = ([], [], [], [])
        return made


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, slice and kind."""
    at = _Stream()
    for batch in batches:
        if not batch.num_rows:
            continue
        cells, parts, kinds, rest = (batch.column(i).to_numpy() for i in range(4))
        letters, n = batch.column(4), batch.column(5).to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (parts[1:] != parts[:-1])]))
        ends = np.append(edges[1:], len(cells))
        # a cell without stored words, or with one word alone, has no pairs; the first and the last may go on beyond the batch
        worth = (kinds[edges] == 0) & (ends - edges > 1)
        worth[[0, -1]] = True
        for begin, end in zip(edges[worth].tolist(), ends[worth].tolist(), strict=True):
            here = int(cells[begin]), int(parts[begin])
            if here != at.here:
                at.settle()
                at.begin(here)
            at.add(kinds[begin:end], rest[begin:end], letters[begin:end], n[begin:end])
        if len(at.out[0]) > 1 << 14:
            yield at.taken()
    at.settle()
    if at.out[0]:
        yield at.taken()
    give_back()


def near(counted: DataFrame, largest: int = LARGEST) -> DataFrame:
    """(word, n_near, best_n, best) of each word of counted(word, n) that has a near one."""
    ship(counted.sparkSession)
    coded = counted.select(F.encode("word", "ISO-8859-1").alias("letters"), "n")
    cells = _sliced(coded.mapInArrow(_to_cells, CELLS), largest)
    dealt = cells.repartition("cell", "slice").sortWithinPartitions("cell", "slice", "kind")
    found = dealt.mapInArrow(_compared, FOUND).groupBy("letters").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("_b"))
    return found.select(F.decode("letters", "ISO-8859-1").alias("word"), "n_near", (-F.col("_b.less")).alias("best_n"), F.decode("_b.best", "ISO-8859-1").alias("best"))


def grouped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR, largest: int = LARGEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word.

    A form is at least ``factor`` times as frequent as its word, so a chain of forms has at most 19 words and is followed
    in a few rounds, each of which doubles the steps taken.
    """
    counted = staged(words(docs, id_col, text_col), "spelling-words")
    met = near(counted, largest).withColumnRenamed("word", "_word")
    formed = F.col("best_n") >= F.col("n") * factor
    named = counted.join(met, F.col("word") == F.col("_word"), "left").select("word", F.when(formed, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best_n")).alias("form_n"))
    named = staged(named, "spelling-forms")
    above = named.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = above.select(F.col("word").alias("_at"), F.col("root").alias("_up"))
        step = staged(above.join(up, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "spelling-roots")
        above = step.select("word", "root")
        if step.filter("moved").isEmpty():
            break
    above = above.withColumnRenamed("word", "_word")
    return named.join(above, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
