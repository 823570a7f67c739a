"""Groups of texts alike by the Jaccard likeness of their word shingles, from candidates that an operator names, and exactly for the rest.

A text's shingles are its runs of five consecutive words (the whole sequence if it has fewer). Equal sets are one node.
Candidates, and one member of each bucket of an index prefix against all its others, are verified on the texts, which
meet at a hub: its members are dealt out in shares of bounded size, the hub's text goes with each share. What that misses
is found by prefixes. In any global order of shingles, two sets alike at the threshold t share a shingle among the first
n - ceil(t n) + 1 of the larger one and the first m - ceil(2t / (1 + t) m) + 1 of the smaller one. Shingles there whose nodes
are of one component are done with; the nodes of any other are compared in blocks, across components only.

Defined cases: null is the empty text; texts without words are one node; rows of equal or no id are told apart by their
texts, and equal rows are one row; an empty table has no groups.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.components import connected, row_key
from meshlens.llm.shared import frequent, pooled, ship, slices, staged, words_of

SHINGLE, THRESHOLD = 5, 0.8
#: Members of a hub that one task compares at a time.
SHARE = 500
#: Nodes of a key that make a block, and shingles of them.
BLOCK, BLOCK_SHINGLES = 500, 1 << 20
#: Shingles that are put last in the order of prefixes, most frequent last; the order decides on cost alone.
COMMON = 100_000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit shingle hashes of all texts end to end, and where each text's begin (one more entry than texts)."""
    w = words_of(texts)
    hashes, counts = w.hashes(), w.counts()
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per_text)])
    out = np.zeros(first[-1], np.uint64)
    whole = pooled(hashes, size)
    place = np.arange(first[-1]) - np.repeat(first[:-1], per_text) + np.repeat(w.first[:-1], per_text)
    long = np.repeat(counts >= size, per_text)
    out[long] = whole[place[long]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        part = hashes[w.first[i] : w.first[i + 1]]
        out[first[i]] = pooled(part, len(part), 1)[0]
    return out, first


def distinct(shingles: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Each text's different shingles, ascending."""
    return [np.unique(shingles[a:b]) for a, b in zip(first, first[1:], strict=False)]


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, most=1 << 21):
            h, n = np.unique(np.concatenate(distinct(*shingle_sets(part.column(0)))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[n > 2].view(np.int64)), pa.array(n[n > 2])], names=["shingle", "n"])


def common_shingles(docs: DataFrame, most: int = COMMON) -> np.ndarray:
    """Shingles of many texts, rarest first."""
    counts = staged(docs.select("text").mapInArrow(_common, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")), "like-common")
    found = frequent(counts, most)[0].toArrow().sort_by([("n", "ascending"), ("shingle", "ascending")])
    return found.column("shingle").to_numpy().view(np.uint64)


def prefix(own: np.ndarray, common: np.ndarray, order: np.ndarray, threshold: float) -> np.ndarray:
    """The first shingles of a set in the global order: sets alike at the threshold share one. common: ascending; order: their places."""
    place = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        place = np.where(common[at] == own, order[at] + 1, 0)
    most = len(own) - math.ceil(threshold * len(own) - 1e-9) + 1
    return own[np.lexsort((own, place))[:most]]


def _described(batches: Iterator[pa.RecordBatch], keys: Callable[[np.ndarray, np.ndarray], list], threshold: float, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(common)
    common, longs = common[order], pa.list_(pa.int64())
    for batch in batches:
        for part in slices(batch):
            shingles, first = shingle_sets(part.column("text"))
            sets = distinct(shingles, first)
            same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            prefixes = [prefix(x, common, order, threshold).view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("_row"), part.column("doc_id"), pa.array(same, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array(keys(shingles, first), longs), pa.array(prefixes, longs)],
                names=["_row", "doc_id", "same", "n", "keys", "prefix"],
            )


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) from rows (a, share, member, node, text) sorted by share, the hub's own row first."""
    here, hub = None, np.zeros(0, np.uint64)
    for batch in batches:
        for part in slices(batch):
            sets = distinct(*shingle_sets(part.column("text")))
            found: list[tuple[int, int]] = []
            for a, share, member, node, own in zip(*(part.column(c).to_pylist() for c in ("a", "share", "member", "node")), sets, strict=True):
                if not member:
                    here, hub = (a, share), own
                    continue
                if here != (a, share):
                    raise ValueError(f"share {share} of {a} came without its hub")
                both = len(np.intersect1d(hub, own, assume_unique=True))
                if both + 1e-9 >= threshold * (len(hub) + len(own) - both):
                    found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=["a", "b"])


def verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: float, tag: str) -> DataFrame:
    """The pairs (hub a, member b) of nodes whose texts are alike. Texts go once to their nodes, and from there to the hubs."""
    pairs = staged(pairs.distinct(), f"{tag}-pairs")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / SHARE).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"), "b")
    members = dealt.select("a", "share", F.lit(True).alias("member"), F.col("b").alias("node"))
    asked = dealt.select("a", "share").distinct().select("a", "share", F.lit(False).alias("member"), F.col("a").alias("node")).unionByName(members)
    asked = staged(asked.join(reps.select("node", "_row"), "node"), f"{tag}-asked")
    texts = rows.join(asked.select("_row").distinct(), "_row", "left_semi").select("_row", "text").dropDuplicates(["_row"])
    met = texts.join(asked, "_row").select("a", "share", "member", "node", "text")
    met = met.repartition("a", "share").sortWithinPartitions("a", "share", "member")
    return staged(met.mapInArrow(lambda b: _compared(b, threshold), "a long, b long"), f"{tag}-links")


MET = "key long, i long, j long, block long, node long, n long, c long, at int, indexed boolean, before array<long>"


#: Groups of so many rows at most are compared row against following row, all groups at once.
SMALL = 24


def may_link(met: pa.RecordBatch, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger, smaller) of rows of one (key, i, j), whole groups at hand, that could be links: of different components, near in size, with enough left after the key, and without an earlier key in common, where they would meet as well."""
    key, i, j, block, node, n, c, at, indexed = (met.column(k).to_numpy(zero_copy_only=False) for k in ("key", "i", "j", "block", "node", "n", "c", "at", "indexed"))
    before, flat = met.column("before").offsets.to_numpy(), met.column("before").values.to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    size = np.diff(np.append(begin, len(key)))
    group = np.repeat(np.arange(len(begin)), size)

    def could(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.where((n[y] < n[x]) | (n[y] == n[x]) & (node[y] < node[x]), (x, y), (y, x))
        hit = (c[x] != c[y]) & indexed[y] & (n[y] + 1e-9 >= threshold * n[x]) & ((i[x] == j[x]) | (block[x] != block[y]))
        hit &= np.minimum(n[x] - at[x], n[y] - at[y]) + 1e-9 >= threshold / (1 + threshold) * (n[x] + n[y])
        x, y = x[hit], y[hit]
        new = [not set(flat[before[a] : before[a + 1]].tolist()) & set(flat[before[b] : before[b + 1]].tolist()) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
        return x[new], y[new]

    def within(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = np.triu_indices(len(rows), 1)
        x, y = rows[x], rows[y]
        parts = [before[r + 1] - before[r] for r in rows]
        _, number = np.unique(np.concatenate([flat[before[r] : before[r + 1]] for r in rows]), return_inverse=True)
        early = np.zeros((len(rows), int(number.max(initial=0)) + 1), np.float32)
        early[np.repeat(np.arange(len(rows)), parts), number] = 1
        shared = early @ early.T
        apart = shared[x - rows[0], y - rows[0]] == 0
        return x[apart], y[apart]

    some: list[tuple[np.ndarray, np.ndarray]] = [could(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    little = np.flatnonzero(size[group] <= SMALL)
    for lag in range(1, SMALL):
        x = little[little + lag < len(key)]
        x = x[group[x] == group[x + lag]]
        if not len(x):
            break
        some.append(could(x, x + lag))
    some += [could(*within(np.arange(begin[g], begin[g] + size[g]))) for g in np.flatnonzero(size > SMALL)]
    return tuple(np.concatenate(e).astype(np.int64) for e in zip(*some, strict=True))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of whole groups of equal (key, i, j), which come first; one batch and one group are held."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(k)[-1].as_py() != int(keys[k][0]) for k in range(3)):
            new = np.concatenate([[0], new])
        if len(new):
            held.append(batch.slice(0, new[-1]))
            yield pa.concat_batches(held)
            held = [batch.slice(new[-1])]
        else:
            held.append(batch)
    if held:
        yield pa.concat_batches(held)


def _open(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """The rows that are in a pair which could be a link."""
    for met in _whole_groups(batches):
        use = np.zeros(met.num_rows, bool)
        for end in may_link(met, threshold):
            use[end] = True
        yield met.filter(pa.array(use))


def _rest(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    for met in _whole_groups(batches):
        node, found = met.column("node").to_numpy(), []
        larger, smaller = may_link(met, threshold)
        sets = [x for part in slices(met) for x in distinct(*shingle_sets(part.column("text")))]
        for x, y in zip(larger.tolist(), smaller.tolist(), strict=True):
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both + 1e-9 >= threshold * (len(sets[x]) + len(sets[y]) - both):
                found.append((x, y))
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def between(rows: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Links between nodes of different components that share a key, from nodes(node, _row, n, c, open).

    A key's nodes are dealt into blocks, and each pair of blocks is compared by one task: rows grow with a key's nodes times
    its blocks, and no pair is a row. Texts go only where their sizes and places leave a link possible.
    """
    keyed = nodes.select("node", "n", "c", "open", F.posexplode("open").alias("pos", "o"))
    keyed = keyed.select("node", "n", "c", "o.*", F.slice("open.key", F.lit(1), F.col("pos")).alias("before"))
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("key", "node"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = keyed.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "c", "at", "indexed", "before")
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    met = staged(dealt(met).mapInArrow(lambda b: _open(b, threshold), MET), "like-met")
    asked = staged(met.join(nodes.select("node", "_row"), "node"), "like-asked")
    texts = rows.join(asked.select("_row").distinct(), "_row", "left_semi").select("_row", "text").dropDuplicates(["_row"])
    met = asked.join(texts, "_row").select(*met.columns, "text")
    return staged(dealt(met).mapInArrow(lambda b: _rest(b, threshold), "a long, b long"), "like-rest-links")


def groups(docs: DataFrame, keys: Callable[[np.ndarray, np.ndarray], list], candidates: Callable[[DataFrame], DataFrame], threshold: float = THRESHOLD) -> DataFrame:
    """(_row, doc_id, component) of every different row: components over all links of a Jaccard likeness of the threshold.

    keys: numbers that stand for a text's likeness, from its shingles. candidates: pairs (a, b) of nodes, given (node, keys).
    """
    spark = docs.sparkSession
    ship(spark)
    common = common_shingles(docs)
    held = spark.sparkContext.broadcast(common)  # COMMON numbers at most
    rows = row_key(docs.select("doc_id", "text"))
    kind = dict(docs.dtypes)["doc_id"]
    sets = staged(rows.mapInArrow(lambda b: _described(b, keys, threshold, held.value), f"_row binary, doc_id {kind}, same binary, n long, keys array<long>, prefix array<long>"), "like-sets")
    # numbers are given once: all that follows reads them from the written table
    reps = staged(sets.dropDuplicates(["same"]).select(F.monotonically_increasing_id().alias("node"), "same", "_row", "n", "keys", "prefix"), "like-nodes")
    cut = F.col("n") - F.ceil(F.col("n") * (2 * threshold / (1 + threshold)) - 1e-9) + 1
    placed = reps.select("node", "n", cut.alias("cut"), F.posexplode("prefix").alias("at", "key")).select("key", "node", F.col("n").cast("int").alias("n"), "at", (F.col("at") < F.col("cut")).alias("indexed"))
    keys_ = placed.groupBy("key").agg(F.min(F.when(F.col("indexed"), F.col("node"))).alias("hub"), F.count("*").alias("met"), F.sum("n").alias("shingles")).filter("met > 1 and hub is not null")
    placed = staged(placed.join(keys_, "key"), "like-keys")  # those that several nodes share
    sized = lambda n, m: F.least(n, m) + 1e-9 >= threshold * F.greatest(n, m)
    star = placed.filter("indexed and node != hub").select("hub", "node", "n").distinct()
    star = star.join(reps.select(F.col("node").alias("hub"), F.col("n").alias("m")), "hub").filter(sized(F.col("n"), F.col("m"))).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    near = candidates(reps.select("node", "keys")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = verified(rows, reps, near.unionByName(star), threshold, "like-near")
    # the rest: nodes of different components that share a shingle of their prefixes
    named = reps.select("node", "same").join(connected(links), "node", "left").select("node", "same", F.coalesce("component", "node").alias("c"))
    named = staged(named, "like-named")
    keyed = placed.join(named.select("node", "c"), "node")
    open_ = keyed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x != y").select("key")
    blocks = F.ceil(F.greatest(F.col("met") / BLOCK, F.col("shingles") / BLOCK_SHINGLES)).alias("blocks")
    keyed = staged(keyed.join(open_, "key").select("key", "node", F.col("n").cast("long").alias("n"), "c", "at", "indexed", blocks), "like-open")
    held_keys = keyed.groupBy("node", "n", "c").agg(F.array_sort(F.collect_list(F.struct("at", "key", "indexed", "blocks"))).alias("open"))  # a prefix at most
    held_keys = held_keys.join(reps.select("node", "_row"), "node").select("_row", "node", "n", "c", "open")
    more = between(rows, staged(held_keys, "like-rest"), threshold)
    labels = connected(links.unionByName(more)).withColumnRenamed("node", "label_of")
    named = named.join(labels, named["node"] == labels["label_of"], "left").select("same", F.coalesce("component", "node").alias("component"))
    return sets.select("_row", "doc_id", "same").join(named, "same").select("_row", "doc_id", "component").distinct()
