"""Quality rules: base rules on counts, then a hashed n-gram logistic regression against a fixed threshold.

The model reads word 1- and 2-grams and code point 2- and 4-grams, each hashed to one of 2**15 buckets. A text's logit is
a bias plus the mean bucket weight of each kind of n-gram, so scoring is a table lookup and a running sum over Arrow
batches. It is trained in numpy on at most ``max_rows`` labelled rows (the bound is a parameter; which rows is fixed by
a hash of doc_id), four fifths of them for the weights and one fifth for Platt's calibration of the probability.

Defined cases: a null text has no words and fails the base rules; without labels of both kinds every probability is 0.5
and the base rules decide alone; of labels that disagree on an id the worse counts; repeated rows are judged alike; extra columns pass through ``keep_good`` unchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import bytes_of, mix64, pooled, powers, ship, slices, staged, words_of

BITS = 15
WORD_GRAMS, CHAR_GRAMS = (1, 2), (2, 4)
KINDS = len(WORD_GRAMS) + len(CHAR_GRAMS)
#: A text of fewer words, or with a larger share (in percent) of words in repeated windows, fails.
MIN_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
THRESHOLD = 0.5
BYTE_HASH = mix64(np.arange(256, dtype=np.uint64), 77)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _ranges(running: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return running[np.maximum(end, begin)] - running[begin]


def _running(values: np.ndarray, kind: type = np.int64) -> np.ndarray:
    out = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=out[1:])
    return out


def gram_buckets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of n-gram: its bucket at every place, and each text's range of places."""
    w = words_of(texts)
    hashes, out = w.hashes(), []
    for n in WORD_GRAMS:
        h = pooled(hashes, n, 11)
        begin = np.minimum(w.first[:-1], len(h))
        out.append(((h >> np.uint64(64 - BITS)).astype(np.int32), begin, np.maximum(begin, w.first[1:] - n + 1)))
    points = np.frombuffer(w.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = _running((w.data & 0xC0) != 0x80)[w.offsets]
    salted = mix64(points.astype(np.uint64))
    for n in CHAR_GRAMS:
        h = pooled(salted, n, 23)
        begin = np.minimum(starts[:-1], len(h))
        out.append(((h >> np.uint64(64 - BITS)).astype(np.int32), begin, np.maximum(begin, starts[1:] - n + 1)))
    return out


def _confirmed(names: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], bool], whole: Callable[[int], tuple]) -> np.ndarray:
    """The names as they are if all places of equal names are alike; else numbers by whole values."""
    order = np.argsort(names, kind="stable")
    same = np.flatnonzero(names[order[1:]] == names[order[:-1]])
    if not len(same) or alike(order[same], order[same + 1]):
        return names
    numbers: dict[tuple, int] = {}
    return np.array([numbers.setdefault(whole(i), len(numbers)) for i in range(len(names))], np.uint64)


def base_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    w = words_of(texts)
    n_texts = len(w.offsets) - 1
    hashes, per_text = w.hashes(), w.text_of()
    solid = np.zeros(len(w.data) + 1, np.int64)
    np.add.at(solid, w.start, 1)
    np.add.at(solid, w.end, -1)
    in_word = np.cumsum(solid[:-1]).astype(bool)
    chars = _running(in_word & ((w.data & 0xC0) != 0x80))
    # lines: a text's bytes cut at each \n
    breaks = np.flatnonzero(w.data == 10)
    line_start = np.sort(np.concatenate([w.offsets[:-1], breaks + 1]), kind="stable")
    line_text = np.searchsorted(w.offsets[1:], line_start, side="right")
    line_end = np.append(line_start[1:], len(w.data))
    keep = line_text < n_texts
    line_start, line_text, line_end = line_start[keep], line_text[keep], line_end[keep]
    line_end = np.minimum(line_end, w.offsets[1:][line_text])
    line_end = line_end - ((line_end > line_start) & (w.data[np.maximum(line_end - 1, 0)] == 10) if len(w.data) else 0)
    worded = _ranges(_running(in_word), line_start, line_end) > 0
    line_start, line_end, line_text = line_start[worded], line_end[worded], line_text[worded]
    up, down = powers(len(w.data) + 1)
    total = np.zeros(len(w.data) + 1, np.uint64)
    np.cumsum(BYTE_HASH[w.data] * up[: len(w.data)], out=total[1:])
    lines = mix64((total[line_end] - total[line_start]) * down[line_start] + (line_end - line_start).astype(np.uint64)) + mix64(line_text.astype(np.uint64), 5)
    raw = w.data.tobytes()
    lines = _confirmed(lines, lambda i, j: all(line_text[a] == line_text[b] and raw[line_start[a] : line_end[a]] == raw[line_start[b] : line_end[b]] for a, b in zip(i.tolist(), j.tolist(), strict=True)), lambda i: (line_text[i], raw[line_start[i] : line_end[i]]))
    single, at = np.unique(lines, return_index=True)
    dup_lines = np.bincount(line_text, minlength=n_texts) - np.bincount(line_text[at], minlength=n_texts)
    # windows of words found twice in one text
    numbers = w.numbered()[0]
    h = pooled(hashes, WINDOW)
    valid = np.flatnonzero(np.arange(len(h)) + WINDOW <= w.first[1:][per_text[: len(h)]]) if len(h) else np.zeros(0, np.int64)
    alike = lambda i, j: bool((per_text[valid[i]] == per_text[valid[j]]).all()) and all((numbers[valid[i] + k] == numbers[valid[j] + k]).all() for k in range(WINDOW))
    key = _confirmed(h[valid] + mix64(per_text[valid].astype(np.uint64), 7), alike, lambda i: (per_text[valid[i]], *numbers[valid[i] : valid[i] + WINDOW].tolist()))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    cover = np.zeros(len(hashes) + 1, np.int64)
    if len(twice):
        hit = valid[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
    covered = _running(np.cumsum(cover[:-1]) > 0)
    return {"n_words": w.counts(), "word_chars": _ranges(chars, w.offsets[:-1], w.offsets[1:]), "n_symbols": _ranges(_running(_SYMBOL[w.data]), w.offsets[:-1], w.offsets[1:]), "n_dup_lines": dup_lines, "n_repeat_words": covered[w.first[1:]] - covered[w.first[:-1]]}


@dataclass
class GramModel:
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        z = np.full(len(texts), self.bias)
        for k, (buckets, begin, end) in enumerate(gram_buckets(texts)):
            z += _ranges(_running(self.weights[k][buckets], np.float64), begin, end) / np.maximum(end - begin, 1)
        return z

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -30, 30)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            grams, ids, values = gram_buckets(part.column("text")), [], []
            for i in range(part.num_rows):
                found = [np.unique(b[s:e], return_counts=True) for b, s, e in ((b, s[i], e[i]) for b, s, e in grams)]
                ids.append(np.concatenate([u + (k << BITS) for k, (u, _) in enumerate(found)]).astype(np.int32))
                values.append(np.concatenate([c / max(c.sum(), 1) for _, c in found]).astype(np.float32))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["doc_id", "quality", "ids", "shares"])


def fit(ids: list[np.ndarray], shares: list[np.ndarray], labels: np.ndarray, calibration: np.ndarray, rounds: int = 80, ridge: float = 1e-4) -> GramModel:
    """Ridge logistic regression by accelerated gradient steps over sparse rows; Platt's calibration on the rows marked so."""
    size = KINDS << BITS
    flat, held = np.concatenate([np.zeros(0, np.int32), *ids]), np.concatenate([np.zeros(0, np.float32), *shares])
    row = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    seen = np.bincount(flat, minlength=size)
    scale = np.where(seen >= 3, 1 / (np.sqrt(np.bincount(flat, held.astype(float) ** 2, minlength=size) / max(len(ids), 1)) + 1e-3), 0)
    x = (held * scale[flat]).astype(np.float32)
    flat, row, x = flat[x != 0], row[x != 0], x[x != 0]
    use = ~calibration
    y = labels.astype(float)
    times = lambda v: np.bincount(row, x * v[flat], minlength=len(ids))
    back = lambda r: np.bincount(flat, x * r[row].astype(np.float32), minlength=size)
    v = np.ones(size)
    for _ in range(8):
        v = back(times(v) * use)
        top = np.linalg.norm(v)
        v /= top or 1
    step = 1 / (0.25 * top / max(use.sum(), 1) + ridge + 0.25)
    w, look, bias, t = np.zeros(size), np.zeros(size), 0.0, 1.0
    for _ in range(rounds):
        r = (1 / (1 + np.exp(-np.clip(times(look) + bias, -30, 30))) - y) * use / max(use.sum(), 1)
        new, t_new = look - step * (back(r) + ridge * look), (1 + np.sqrt(1 + 4 * t * t)) / 2
        bias -= r.sum()
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    z = times(w) + bias
    at = calibration if 0 < y[calibration].sum() < calibration.sum() else use
    slope, shift = 1.0, 0.0
    goal = np.where(y[at] > 0, (y[at].sum() + 1) / (y[at].sum() + 2), 1 / ((1 - y[at]).sum() + 2))
    loss = lambda a, c: (np.logaddexp(0, a * z[at] + c) - goal * (a * z[at] + c)).sum()
    for _ in range(30):  # Newton's method in two unknowns, halving steps that overshoot
        p = 1 / (1 + np.exp(-np.clip(slope * z[at] + shift, -30, 30)))
        g, h = p - goal, p * (1 - p) + 1e-9
        m = np.array([[(h * z[at] ** 2).sum() + 1e-6, (h * z[at]).sum()], [(h * z[at]).sum(), h.sum() + 1e-6]])
        d = np.linalg.solve(m, [(g * z[at]).sum(), g.sum()])
        while loss(slope - d[0], shift - d[1]) > loss(slope, shift) and abs(d).max() > 1e-9:
            d /= 2
        slope, shift = slope - d[0], shift - d[1]
    return GramModel((w * scale).reshape(KINDS, -1).astype(np.float32), float(bias), float(slope), float(shift))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 2000, seed: int = 7) -> GramModel:
    """Learns from at most max_rows labelled rows; those with crc32(doc_id) % 4 = 2 are left for a test."""
    ship(docs.sparkSession)
    marked = labels.filter(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = staged(marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows), "op9-labels")
    # at most max_rows rows of two numbers, and of each id one text: the least features
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality").mapInArrow(_features, "doc_id long, quality int, ids array<int>, shares array<float>")
    rows = found.groupBy("doc_id").agg(F.min(F.struct("quality", "ids", "shares")).alias("f")).select("doc_id", "f.*").toArrow().sort_by("doc_id")
    y = rows.column("quality").to_numpy()
    if len(set(y.tolist())) < 2:
        return GramModel(np.zeros((KINDS, 1 << BITS), np.float32), 0.0)
    ids = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in rows.column("ids")]
    shares = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in rows.column("shares")]
    return fit(ids, shares, y, mix64(rows.column("doc_id").to_numpy().astype(np.uint64)) % np.uint64(5) == 0)


def verdicts(texts: pa.Array, model: GramModel) -> dict[str, np.ndarray]:
    out = base_counts(texts)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    out["probability"] = model.probabilities(texts)
    out["kept"] = ~out["base_failed"] & (out["probability"] >= THRESHOLD)
    return out


FIELDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "probability": pa.float64()}


def judge(docs: DataFrame, model: GramModel) -> DataFrame:
    """Counts and verdict of every row; narrow."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)  # 2**15 weights for each kind of n-gram: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = verdicts(part.column("text"), held.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[k], t) for k, t in FIELDS.items())], names=["doc_id", *FIELDS])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, model: GramModel) -> DataFrame:
    """The rows that pass, as they are; narrow."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(verdicts(part.column("text"), held.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
