"""Hard-negative mining by ball trees: branch and bound over inner products, exact.

Rows are dealt by a hash to as many trees as keep each near ``tree_rows`` rows. A tree's nodes are balls; for an anchor q and
a ball of centre c and radius r every inner product lies in ``q.c - |q| r .. q.c + |q| r``. Anchors travel in packed blocks,
one row a block, and each block visits every tree; the whole block goes down a tree together, and at each node the anchors go
on whose bounds reach the wanted range of scores and don't lie strictly beneath their current k-th best (nor at it, where the
node holds no smaller id). One pass finds each anchor's positives, and a second the negatives in the ranges that these set;
of each block and tree only the k best a query come back, packed, and blocks are merged as sorted streams.

Scores are inner products of whole numbers, taken exactly: in floating point where no sum can reach 2**53, else in 64-bit
integers. Defined cases: rows with a null label or vector, or a null or non-finite component, take no part, nor those whose
squared length, scaled, reaches 2**62, whose scores a long can't hold; a shorter vector is read with zeros after its end;
rows equal in id, label and vector are one row, and rows of one id with other labels or vectors are rows of their own (ties
beyond the id go by label, then by a hash of the vector); null ids are neither anchors nor found; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import give_back, ship, staged

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 3, 50, 95
TREE_ROWS, BLOCK_ROWS, LEAF = 1 << 13, 512, 64
_SMALLEST, _LARGEST = -(2**63) + 1, 2**63 - 1
#: Trees whose results for a block one task merges.
FAN = 64


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, tie, q) of the rows that take part, each once: components are floor(scale * x), tie is a hash of them."""
    x = F.col(vec_col).cast("array<double>")
    scaled = F.transform(x, lambda v: F.floor(v * scale))
    fits = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.floor(v * scale).cast("double") * F.floor(v * scale).cast("double")) < float(2**62)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull()).filter(finite).filter(fits)
    named = sound.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), scaled.cast("array<bigint>").alias("q"))
    return named.withColumn("tie", F.xxhash64("q")).select("id", "label", "tie", "q").distinct()


# ------------------------------------------------------------- packed rows


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_list(pa.int64()))
    at = column.offsets.to_numpy()
    sizes, flat = np.diff(at), column.values.to_numpy()[at[0] :] if len(column) else np.zeros(0, np.int64)
    width = max(width, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat[: width * len(sizes)].reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], sizes)] = flat[: len(row)]
    return out


def _wide(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<i8").tobytes()


def _rows(raw: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(rows, -1)


BLOCKS = "block long, anchors binary, q binary"


def _to_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Anchors (id, label, tie, q), sorted, in packed blocks of so many rows: (id, label, tie) by columns, and their vectors."""
    part = TaskContext.get().partitionId() << 32
    number = 0
    held: list[pa.RecordBatch] = []

    def packed(t: pa.Table) -> pa.RecordBatch:
        nonlocal number
        number += 1
        named = np.stack([t.column(i).to_numpy() for i in range(3)])
        return pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), pa.array([_pack(named)], pa.binary()), pa.array([_pack(_matrix(t.column(3)))], pa.binary())], names=["block", "anchors", "q"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            t = pa.Table.from_batches(held)
            for at in range(0, t.num_rows - rows + 1, rows):
                yield packed(t.slice(at, rows))
            held = t.slice(t.num_rows // rows * rows).to_batches()
    if sum(b.num_rows for b in held):
        yield packed(pa.Table.from_batches(held))


# ------------------------------------------------------------- the tree


@dataclass
class Wanted:
    """What each query of a block looks for: the k best scores in low..high among rows of the anchor's label, or of another."""

    anchor: np.ndarray  # the anchor's place in the block, ascending
    low: np.ndarray
    high: np.ndarray
    k: int
    same: bool


class BallTree:
    """A ball tree over whole vectors, as arrays: rows in tree order, and for each node its rows, children, ball and least id."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ties: np.ndarray, q: np.ndarray, leaf: int = LEAF) -> None:
        order = np.arange(len(ids))
        real = q.astype(np.float64)
        self.begin, self.end, self.left, self.right = [], [], [], []
        centre, radius, least = [], [], []
        todo = [(0, len(ids), -1, False)]
        while todo:
            begin, end, parent, is_right = todo.pop()
            node, rows = len(self.begin), order[begin:end]
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            points = real[rows]
            middle = points.mean(axis=0)
            self.begin.append(begin), self.end.append(end), self.left.append(-1), self.right.append(-1)
            centre.append(middle), radius.append(np.sqrt(((points - middle) ** 2).sum(axis=1).max())), least.append(ids[rows].min())
            if end - begin > leaf and radius[-1] > 0:
                # along the line between two rows that are far from each other
                far = points[((points - middle) ** 2).sum(axis=1).argmax()]
                other = points[((points - far) ** 2).sum(axis=1).argmax()]
                order[begin:end] = rows[np.argsort(points @ (other - far), kind="stable")]
                cut = (begin + end) // 2
                todo += [(begin, cut, node, False), (cut, end, node, True)]
        self.ids, self.labels, self.ties, self.q = ids[order], labels[order], ties[order], q[order]
        self.centre, self.radius, self.least = np.array(centre), np.array(radius), np.array(least)
        self.length = float(np.sqrt((real**2).sum(axis=1).max()))

    def search(self, named: np.ndarray, q: np.ndarray, w: Wanted) -> np.ndarray:
        """Scores, ids, labels and ties of the k best of each query, one line a query; the smallest score is none. named holds the anchors' ids, labels and ties."""
        width = max(q.shape[1], self.q.shape[1])
        mine, theirs = _wide(q, width), _wide(self.q, width)
        lengths = np.sqrt((mine.astype(np.float64) ** 2).sum(axis=1))
        exact = float(lengths.max(initial=0.0)) * self.length < 2**52
        if exact:
            mine, theirs = mine.astype(np.float64), theirs.astype(np.float64)
        # bounds are widened by what floating point may lose
        slack = 1e-9 * (1 + lengths * self.length)
        middle = mine.astype(np.float64) @ _wide(self.centre, width).T
        reach = np.outer(lengths, self.radius) * (1 + 1e-9) + slack[:, None]
        best = nothing(len(w.anchor), w.k)
        if not len(w.anchor):
            return best
        low, high = w.low.astype(np.float64), w.high.astype(np.float64)
        todo = [(0, np.arange(len(w.anchor)))]
        while todo:
            node, on = todo.pop()
            a = w.anchor[on]
            top, bottom = middle[a, node] + reach[a, node], middle[a, node] - reach[a, node]
            kth, last = best[0][on, -1], best[1][on, -1]
            keep = (top >= low[on]) & (bottom <= high[on]) & (top >= kth.astype(np.float64) * (1 - 1e-15))
            keep &= ~((np.floor(top) == kth) & (np.abs(kth) < 2**50) & (self.least[node] > last))
            on = on[keep]
            if not len(on):
                continue
            if self.left[node] < 0:
                self._leaf(node, on, named, mine, theirs, w, best)
            else:
                sides = [(float(middle[w.anchor[on], c].mean()), c) for c in (self.left[node], self.right[node])]
                todo += [(c, on) for _, c in sorted(sides)]  # the nearer one is taken first
        return best

    def _leaf(self, node: int, on: np.ndarray, named: np.ndarray, mine: np.ndarray, theirs: np.ndarray, w: Wanted, best: np.ndarray) -> None:
        for begin in range(self.begin[node], self.end[node], 1 << 12):  # a ball of equal rows is one leaf of any size
            rows = slice(begin, min(begin + (1 << 12), self.end[node]))
            a, place = np.unique(w.anchor[on], return_inverse=True)
            scores = (mine[a] @ theirs[rows].T).astype(np.int64)
            alike = named[1][a][:, None] == self.labels[rows][None, :]
            if w.same:  # all but the anchor itself
                alike &= (named[0][a][:, None] != self.ids[rows][None, :]) | (named[2][a][:, None] != self.ties[rows][None, :])
            of = scores[place]
            hit = (alike if w.same else ~alike)[place] & (of >= w.low[on][:, None]) & (of <= w.high[on][:, None]) & (of >= best[0][on, -1][:, None])
            i, j = np.nonzero(hit)
            if len(i):
                row, met = j + begin, np.unique(i)
                made = np.stack([of[i, j], self.ids[row], self.labels[row], self.ties[row]])
                line = np.concatenate([np.repeat(met, w.k), i])
                best[:, on[met]] = _first(line, np.concatenate([best[:, on[met]].reshape(4, -1), made], axis=1), w.k)


def nothing(queries: int, k: int) -> np.ndarray:
    return np.broadcast_to(np.array([_SMALLEST, _LARGEST, 0, 0], np.int64)[:, None, None], (4, queries, k)).copy()


def _first(line: np.ndarray, made: np.ndarray, k: int) -> np.ndarray:
    """The k first of each line, of which it holds k at least: by score descending, id, label and tie."""
    score, ids, labels, ties = made
    order = np.lexsort((ties, labels, ids, -score, line))
    _, at = np.unique(line[order], return_index=True)
    return made[:, order[at[:, None] + np.arange(k)[None, :]]]


# ------------------------------------------------------------- blocks meet trees

FOUND = "block long, tree int, best binary"


def _found(block: list[int], tree: list[int], best: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(tree, pa.int32()), pa.array([_pack(b) for b in best], pa.binary())], names=["block", "tree", "best"])


def positives_wanted(n: int, k: int) -> Wanted:
    return Wanted(np.arange(n), np.full(n, _SMALLEST), np.full(n, _LARGEST), k, True)


def negatives_wanted(positives: np.ndarray, k: int, low: int, high: int) -> Wanted:
    """A query for each anchor and positive there is: low * p <= 100 * score <= high * p."""
    anchor, place = np.nonzero(positives[0] > _SMALLEST)
    p = positives[0][anchor, place].tolist()
    return Wanted(anchor, np.array([-(-low * x // 100) for x in p], np.int64), np.array([high * x // 100 for x in p], np.int64), k, False)


def _visits(batches: Iterator[pa.RecordBatch], wanted: Callable[[int, np.ndarray | None], Wanted]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree and block: a tree's own rows (block null) come first, then the blocks that visit it."""
    here, members, tree = None, [], None

    def grown() -> BallTree | None:
        if not members:
            return None
        t = pa.Table.from_batches(members)
        return BallTree(*(t.column(i).to_numpy() for i in range(3)), _matrix(t.column(3)))

    for batch in batches:
        trees, blocks = batch.column(0).to_numpy(), batch.column(1)
        edges = np.flatnonzero(np.concatenate([[True], trees[1:] != trees[:-1]])) if len(trees) else []
        for begin, end in zip(edges, [*edges[1:], len(trees)], strict=True):
            if trees[begin] != here:
                here, members, tree = trees[begin], [], None
            part = batch.slice(begin, end - begin)
            own = part.column(1).null_count  # nulls come first
            if own:
                members.append(pa.RecordBatch.from_arrays([part.column(i).slice(0, own) for i in range(2, 6)], names=["id", "label", "tie", "q"]))
            for i in range(own, part.num_rows):
                if members:
                    tree, members = grown(), []
                if tree is None:
                    continue  # no row was dealt to this tree
                named = _rows(part.column(6)[i].as_py(), 3)
                met = part.column(8)[i].as_py()
                w = wanted(named.shape[1], None if met is None else _rows(met, 4).reshape(4, named.shape[1], -1))
                yield _found([blocks[begin + i].as_py()], [int(here)], [tree.search(named, _rows(part.column(7)[i].as_py(), named.shape[1]), w)])
    give_back()


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block and tree: one row for each (block, tree) from the k best of each of its rows."""
    here, best = None, None
    for batch in batches:
        for block, tree, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            made = np.frombuffer(raw, "<i8").reshape(4, -1, k)
            if (block, tree) == here:
                both = np.concatenate([best, made], axis=2).reshape(4, -1)
                best = _first(np.repeat(np.arange(made.shape[1]), 2 * k), both, k) if made.shape[1] else made
            else:
                if here is not None:
                    yield _found([here[0]], [here[1]], [best])
                here, best = (block, tree), made
    if here is not None:
        yield _found([here[0]], [here[1]], [best])


def _met(rows: DataFrame, blocks: DataFrame, trees: int, k: int, wanted: Callable[[int, np.ndarray | None], Wanted]) -> DataFrame:
    """(block, best) of blocks(block, anchors, q, met) after each has visited every tree."""
    own = rows.select(F.pmod(F.xxhash64("id", "label", "tie"), F.lit(trees)).cast("int").alias("tree"), F.lit(None).cast("long").alias("block"), "id", "label", "tie", F.col("q").alias("vec"))
    visits = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "block", "anchors", "q", "met")
    both = own.unionByName(visits, allowMissingColumns=True).select("tree", "block", "id", "label", "tie", "vec", "anchors", "q", "met")
    found = both.repartition(trees, "tree").sortWithinPartitions("tree", F.asc_nulls_first("block")).mapInArrow(lambda b: _visits(b, wanted), FOUND)
    while True:
        found = found.withColumn("tree", F.floor(F.col("tree") / FAN).cast("int"))
        found = found.repartition("block", "tree").sortWithinPartitions("block", "tree").mapInArrow(lambda b: _merged(b, k), FOUND)
        trees = -(-trees // FAN)
        if trees == 1:
            return found.select("block", "best")


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def _ranked(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """One row for each negative of (anchors, met, best)."""
    for batch in batches:
        for anchors, met, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            named, found = _rows(anchors, 3), np.frombuffer(best, "<i8").reshape(4, -1, k)
            positives = _rows(met, 4).reshape(4, named.shape[1], -1)
            anchor, place = np.nonzero(positives[0] > _SMALLEST)
            query, rank = np.nonzero(found[0] > _SMALLEST)
            a, p = anchor[query], place[query]
            columns = [named[0][a], positives[1][a, p], (rank + 1).astype(np.int32), found[1][query, rank], positives[0][a, p], found[0][query, rank]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


def mined(rows: DataFrame, anchor: Column, id_col: str = "id", vec_col: str = "vec", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, tree_rows: int = TREE_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (a condition on ``id``) and each of its
    first positives, the first negatives whose score is between low and high hundredths of the positive's."""
    ship(rows.sparkSession)
    whole = staged(whole_vectors(rows, id_col, vec_col, label_col), "mining-rows")
    chosen = whole.filter(anchor)
    trees, deals = -(-max(1, whole.count()) // tree_rows), -(-max(1, chosen.count()) // block_rows)
    packed = chosen.repartition(deals, "id", "label", "tie").sortWithinPartitions("id", "label", "tie")
    blocks = staged(packed.mapInArrow(lambda b: _to_blocks(b, block_rows), BLOCKS), "mining-blocks").withColumn("met", F.lit(None).cast("binary"))
    first = staged(_met(whole, blocks, trees, positives, lambda n, _: positives_wanted(n, positives)), "mining-positives")
    known = staged(blocks.drop("met").join(first.withColumnRenamed("best", "met"), "block"), "mining-known")
    last = _met(whole, known, trees, negatives, lambda n, met: negatives_wanted(met, negatives, low, high))
    return known.join(last, "block").select("anchors", "met", "best").mapInArrow(lambda b: _ranked(b, negatives), OUT)
