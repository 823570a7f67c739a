"""LM scoring by masked pseudo-likelihood.

A small network predicts each token from the two tokens before and the two after it, never from itself: embeddings by
position are summed, squashed, and mapped to a distribution over the tokens, factored into 32 groups of 32. A document's
score is the sum of the log-probabilities of its words, and that sum over their number.

Tokens are the 768 most frequent words of the corpus, exactly counted over all documents, and 256 hash classes of the rest.
A class's probability, which depends on the words around, is multiplied by the word's share of its class. Shares are exact
counts of all words that stand LEAST times or more, a table that grows with the corpus: its most frequent words, BROADCAST
at most, go to every executor, the others meet the words of documents in a join. Rarer words have their class's share of
such words times their spelling's probability, by exact counts of byte pairs over all words.

Training is in numpy where the data lie. Documents are dealt into shards of about SHARD tokens by a hash, so what is
learnt depends on the corpus and not on the number of tasks. In each of ``stride`` rounds every shard takes steps through
its documents on every ``stride``-th token, another residue each round, so that all tokens are targets once. Shards'
weights are averaged by tokens seen, first in SLOTS tasks, then on the driver, and the next round starts from there.

Defined cases: null and texts without words have no tokens and score 0; an empty corpus leaves the first weights; extra
columns don't matter; repeated rows train and score each.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import Words, ship, slices, staged, words_of
from meshlens.llm.shared import frequent as frequent_rows

FREQUENT, CLASSES, GROUP, WIDTH, CONTEXT, CHUNK = 768, 256, 32, 16, (-2, -1, 1, 2), 1 << 13
SIZE = FREQUENT + CLASSES
GROUPS = SIZE // GROUP
#: Embeddings by position, their bias, groups and their prior, and for each group its tokens and their prior.
SHAPES = [(len(CONTEXT), SIZE + 1, WIDTH), (WIDTH,), (WIDTH, GROUPS), (GROUPS,), (GROUPS, WIDTH, GROUP), (GROUPS, GROUP)]
CLIP, STEP = 4.0, 4096
LEAST, EDGE = 5, 256
#: Words whose shares every executor holds, at 18 bytes each; tokens of a shard; tasks that sum up weights.
BROADCAST, SHARD, SLOTS = 1 << 20, 1 << 22, 32
#: Tokens of whole documents that a shard has at hand at a time.
AT_HAND = 1 << 17


class Model(NamedTuple):
    """frequent: names of the most frequent words, ascending, and number: their tokens. words, share: names of more words, ascending,
    and log-shares of their classes; rare: log-share of all rarer words in each class; spelling: log-probabilities of bytes by the byte
    before (EDGE: a word's ends)."""

    frequent: np.ndarray
    number: np.ndarray
    words: np.ndarray
    share: np.ndarray
    rare: np.ndarray
    spelling: np.ndarray
    weights: list[np.ndarray]


def first_weights(seed: int = 5) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.1, s).astype(np.float32) if k in (0, 2, 4) else np.zeros(s, np.float32) for k, s in enumerate(SHAPES)]


def flat(weights: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights])


def shaped(values: np.ndarray) -> list[np.ndarray]:
    cuts = np.cumsum([int(np.prod(s)) for s in SHAPES])[:-1]
    return [p.reshape(s).astype(np.float32) for p, s in zip(np.split(values, cuts), SHAPES, strict=True)]


def places(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Where each hash stands among words (ascending); -1 where it doesn't."""
    if not len(words):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1)


def tokens_of(hashes: np.ndarray, frequent: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Token numbers. frequent: hashes of the most frequent words, ascending; number: their token numbers."""
    out = (FREQUENT + hashes % np.uint64(CLASSES)).astype(np.int64)
    at = places(hashes, frequent)
    out[at >= 0] = number[at[at >= 0]]
    return out


def byte_pairs(w: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring bytes (before * 257 + after) of some words, ends included, and where each word's begin."""
    size = w.end[which] - w.start[which] + 1
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    at = np.repeat(w.start[which], size) + step
    before = np.where(step == 0, EDGE, w.data[at - 1].astype(np.int64))
    after = np.where(step == np.repeat(size - 1, size), EDGE, w.data[np.minimum(at, len(w.data) - 1)].astype(np.int64))
    return before * (EDGE + 1) + after, first


def contexts(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each place in CONTEXT, the token there (SIZE past a text's ends)."""
    n = len(tokens)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, end, at = first[:-1][text], first[1:][text], np.arange(n)
    out = np.full((len(CONTEXT), n), SIZE, np.int64)
    for k, step in enumerate(CONTEXT):
        inside = (at + step >= begin) & (at + step < end)
        out[k, inside] = tokens[at[inside] + step]
    return out


def hidden_of(weights: list[np.ndarray], around: np.ndarray) -> np.ndarray:
    total = weights[0][0][around[0]]
    for k in range(1, len(CONTEXT)):
        total += weights[0][k][around[k]]
    return np.tanh(total + weights[1])


def by_group(tokens: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, places of its tokens)."""
    groups = (tokens // GROUP).astype(np.int16)
    order = np.argsort(groups, kind="stable")
    cuts = np.searchsorted(groups[order], np.arange(GROUPS + 1))
    for g in range(GROUPS):
        if cuts[g + 1] > cuts[g]:
            yield g, order[cuts[g] : cuts[g + 1]]


def log_probabilities(weights: list[np.ndarray], tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Weights are clipped, so no logit is out of the exponential's range."""
    _, _, top, prior, inner, inner_prior = weights
    out = np.empty(len(tokens))
    for i in range(0, len(tokens), CHUNK):
        goal, hidden = tokens[i : i + CHUNK], hidden_of(weights, around[:, i : i + CHUNK])
        logits = hidden @ top + prior
        here = logits[np.arange(len(goal)), goal // GROUP] - np.log(np.exp(logits).sum(1))
        for g, at in by_group(goal):
            logits = hidden[at] @ inner[g] + inner_prior[g]
            here[at] += logits[np.arange(len(at)), goal[at] % GROUP] - np.log(np.exp(logits).sum(1))
        out[i : i + CHUNK] = here
    return out


def train_step(weights: list[np.ndarray], speed: list[np.ndarray], tokens: np.ndarray, around: np.ndarray, rate: float = 0.1) -> None:
    """One step with rates by coordinate (squared gradients so far); in place."""
    _, _, top, prior, inner, inner_prior = weights
    hidden, share = hidden_of(weights, around), np.float32(1 / len(tokens))

    def miss(logits: np.ndarray, goal: np.ndarray) -> np.ndarray:
        p = np.exp(logits)
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(goal)), goal] -= 1
        p *= share
        return p

    p = miss(hidden @ top + prior, tokens // GROUP)
    back = p @ top.T
    grads = [np.zeros_like(w) for w in weights]
    grads[2], grads[3] = hidden.T @ p, p.sum(0)
    for g, at in by_group(tokens):
        p = miss(hidden[at] @ inner[g] + inner_prior[g], tokens[at] % GROUP)
        back[at] += p @ inner[g].T
        grads[4][g], grads[5][g] = hidden[at].T @ p, p.sum(0)
    back *= 1 - hidden**2
    grads[1] = back.sum(0)
    for k in range(len(CONTEXT)):
        for j in range(WIDTH):
            grads[0][k, :, j] = np.bincount(around[k], back[:, j], minlength=SIZE + 1)
    for w, s, g in zip(weights, speed, grads, strict=True):
        s += g * g
        w -= np.float32(rate) * g / (np.sqrt(s) + np.float32(1e-4))
        np.clip(w, -CLIP, CLIP, out=w)


def word_counts(docs: DataFrame) -> DataFrame:
    """(spelled, word, n): exact counts over all documents of words by their 64-bit names, and of pairs of bytes (spelled); summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros((EDGE + 1) ** 2, np.int64)
        rows = lambda spelled, word, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(word), spelled)), pa.array(word), pa.array(n)], names=["spelled", "word", "n"])
        for batch in batches:
            for part in slices(batch, most=1 << 22):
                w = words_of(part.column(0))
                code, word = pd.factorize(w.hashes())
                n = np.bincount(code, minlength=len(word))
                at = np.zeros(len(word), np.int64)
                at[code] = np.arange(len(code))
                found, first = byte_pairs(w, at)  # each different word once, times its number
                pairs += np.bincount(found, np.repeat(n, np.diff(np.append(first, len(found)))), minlength=len(pairs)).astype(np.int64)
                yield rows(False, word.view(np.int64), n)
        seen = np.flatnonzero(pairs)
        yield rows(True, seen, pairs[seen])

    return docs.select("text").mapInArrow(run, "spelled boolean, word long, n long").groupBy("spelled", "word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, most: int = BROADCAST) -> tuple[Model, DataFrame, int]:
    """A model without weights, (word, share) of the words that it doesn't hold, and the number of tokens."""
    every = staged(word_counts(docs), "lm-words")
    counts, pairs = every.filter("not spelled").select("word", "n"), np.ones((EDGE + 1) ** 2)
    spelled = every.filter("spelled").select("word", "n").toArrow()  # one row a pair of bytes
    pairs[spelled.column("word").to_numpy()] += spelled.column("n").to_numpy()
    pairs = pairs.reshape(EDGE + 1, EDGE + 1)
    top = frequent_rows(counts, FREQUENT, FREQUENT)[0].orderBy(F.desc("n"), "word").limit(FREQUENT)
    names = np.array([r["word"] for r in top.collect()], np.int64)
    number = np.argsort(names.view(np.uint64))
    frequent = names.view(np.uint64)[number]
    rest = counts.filter(~F.col("word").isin(names.tolist())).withColumn("k", F.col("word").bitwiseAND(CLASSES - 1))
    total, below = np.ones(CLASSES), np.zeros(CLASSES)  # one for words not seen
    sums = rest.groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") < LEAST, F.col("n")).otherwise(0)).alias("below")).collect()
    for r in sums:
        total[r["k"]] += r["n"]
        below[r["k"]] = r["below"]
    shares = rest.filter(F.col("n") >= LEAST).withColumn("share", F.log(F.col("n") / F.element_at(F.array(*map(F.lit, total.tolist())), (F.col("k") + 1).cast("int"))))
    held, cut = frequent_rows(shares, most)
    held = held.select("word", "share").toArrow()  # most rows at most
    words, share = held.column("word").to_numpy().view(np.uint64), held.column("share").to_numpy()
    order = np.argsort(words)
    shares = shares.filter(F.length(F.bin("n")) < cut)
    model = Model(frequent, number, words[order], share[order], np.log((below + 1) / total), np.log(pairs / pairs.sum(1, keepdims=True)), [])
    tokens = counts.agg(F.sum("n")).first()[0] or 0
    return model, staged(shares.select("word", "share"), "lm-tail"), tokens


def picked(first: np.ndarray, stride: int, turn: int) -> np.ndarray:
    """Positions of the tokens that are targets in a round: each of a text's tokens in one of stride rounds."""
    size = np.diff(first)
    return np.flatnonzero((np.arange(first[-1]) - np.repeat(first[:-1] - size, size) + turn) % stride == 0)


def dealt(docs: DataFrame, model: Model, n_tokens: int, shard: int = SHARD) -> DataFrame:
    """(shard, place, tokens): the token numbers of every row, shard by shard."""
    held = docs.sparkSession.sparkContext.broadcast((model.frequent, model.number))  # FREQUENT words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"))
                code, word = pd.factorize(w.hashes())
                tokens = tokens_of(word, *held.value)[code].astype(np.int16)
                lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(tokens))
                yield pa.RecordBatch.from_arrays([part.column("shard"), part.column("place"), lists], names=["shard", "place", "tokens"])

    place = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    rows = docs.select(F.pmod(place, F.lit(n_tokens // shard + 1)).alias("shard"), place.alias("place"), "text")
    rows = rows.mapInArrow(run, "shard long, place long, tokens array<short>")
    return staged(rows.repartition("shard").sortWithinPartitions("shard", "place"), "lm-tokens")


def _trained(batches: Iterator[pa.RecordBatch], begun: np.ndarray, stride: int, turn: int) -> Iterator[pa.RecordBatch]:
    """(slot, shard, seen, weights) of each shard, whose rows come together."""

    def learn(texts: list[np.ndarray]) -> int:
        tokens = np.concatenate(texts).astype(np.int64)
        first = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        around, pick = contexts(tokens, first), picked(first, stride, turn)
        for i in range(0, len(pick), STEP):
            at = pick[i : i + STEP]
            train_step(own, speed, tokens[at], around[:, at])
        return len(pick)

    def finished() -> pa.RecordBatch:
        values = flat(own).astype(np.float64) * seen
        return pa.RecordBatch.from_arrays([pa.array([here % SLOTS]), pa.array([here]), pa.array([float(seen)]), pa.array([values.tobytes()], pa.binary())], names=["slot", "shard", "seen", "total"])

    here, held, size, seen = None, [], 0, 0
    for batch in batches:
        tokens = batch.column("tokens")
        ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy()
        for k, shard in enumerate(batch.column("shard").to_pylist()):
            if shard != here:
                if here is not None:
                    seen += learn(held) if size else 0
                    yield finished()
                here, held, size, seen = shard, [], 0, 0
                own = shaped(begun.copy())
                speed = [np.zeros_like(w) for w in own]
            held.append(values[ends[k] : ends[k + 1]])
            size += len(held[-1])
            if size >= AT_HAND:
                seen += learn(held)
                held, size = [], 0
    if here is not None:
        seen += learn(held) if size else 0
        yield finished()


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slot, from rows sorted by slot and shard."""
    out = lambda: pa.RecordBatch.from_arrays([pa.array([here]), pa.array([here]), pa.array([seen]), pa.array([total.tobytes()], pa.binary())], names=["slot", "shard", "seen", "total"])
    here = None
    for batch in batches:
        for slot, n, values in zip(*(batch.column(c) for c in ("slot", "seen", "total")), strict=True):
            if slot.as_py() != here:
                if here is not None:
                    yield out()
                here, seen, total = slot.as_py(), 0.0, 0.0
            seen, total = seen + n.as_py(), total + np.frombuffer(values.as_buffer(), np.float64)
    if here is not None:
        yield out()


WEIGHTS = "slot long, shard long, seen double, total binary"


def train(docs: DataFrame, rounds: int = 2, stride: int = 2, shard: int = SHARD, most: int = BROADCAST) -> tuple[Model, DataFrame]:
    """The model, and (word, share) of the words that it doesn't hold. Rounds are a multiple of stride, so that every token trains."""
    if rounds % stride:
        raise ValueError(f"{rounds} rounds of stride {stride} leave tokens out")
    ship(docs.sparkSession)
    model, tail, n_tokens = vocabulary(docs, most)
    tokens = dealt(docs, model, n_tokens, shard)
    weights = flat(first_weights())
    for turn in range(rounds):
        held = docs.sparkSession.sparkContext.broadcast(weights)  # of fixed size
        own = tokens.mapInArrow(lambda b, held=held, turn=turn: _trained(b, held.value, stride, turn), WEIGHTS)
        sums = own.repartition(SLOTS, "slot").sortWithinPartitions("slot", "shard").mapInArrow(_summed, WEIGHTS)
        rows = sorted(sums.collect(), key=lambda r: r["slot"])  # SLOTS rows of the weights' size
        if seen := sum(r["seen"] for r in rows):
            weights = (sum(np.frombuffer(r["total"], np.float64) for r in rows) / seen).astype(np.float32)
    return model._replace(weights=shaped(weights)), tail


def word_scores(model: Model, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts' words: a number of each, and by number: name, token, log-probability given the token, and whether that is by spelling."""
    code, word = pd.factorize(w.hashes())
    tokens, at = tokens_of(word, model.frequent, model.number), places(word, model.words)
    inside = np.zeros(len(word))
    inside[at >= 0] = model.share[at[at >= 0]]
    rare = (at < 0) & (tokens >= FREQUENT)
    if rare.any():
        place = np.zeros(len(word), np.int64)
        place[code] = np.arange(len(code))
        pairs, first = byte_pairs(w, place[rare])
        inside[rare] = model.rare[tokens[rare] - FREQUENT] + np.add.reduceat(model.spelling.ravel()[pairs], first)
    return code, word, tokens, inside, rare


def scored(docs: DataFrame, model: Model, tail: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_probability, score) of every row.

    Narrow where the model holds all words' shares; else words that it doesn't hold meet the rest of the table.
    """
    spark = docs.sparkSession
    ship(spark)
    held, joined = spark.sparkContext.broadcast(tuple(model)), not tail.isEmpty()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*held.value)
        for batch in batches:
            for part in slices(batch):
                w = words_of(part.column("text"))
                code, word, tokens, inside, rare = word_scores(model, w)
                each = log_probabilities(model.weights, tokens[code], contexts(tokens[code], w.first)) + inside[code]
                total = np.concatenate([[0.0], np.cumsum(each)])
                columns = [part.column("doc_id"), pa.array(w.counts()), pa.array(total[w.first[1:]] - total[w.first[:-1]])]
                if joined:
                    at = np.flatnonzero(rare[code])
                    ends = pa.array(np.searchsorted(at, w.first).astype(np.int32))
                    columns += [pa.ListArray.from_arrays(ends, pa.array(word[code[at]].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(inside[code[at]]))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, log_probability double" + ", words array<long>, spelled array<double>" * joined
    names = ["doc_id", "n_tokens", "log_probability", "words", "spelled"][: 5 if joined else 3]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
    if joined:
        found = staged(found.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
        rare = found.select("row", F.explode(F.arrays_zip("words", "spelled")).alias("e")).select("row", F.col("e.words").alias("word"), F.col("e.spelled").alias("spelled"))
        better = rare.join(tail, "word").groupBy("row").agg(F.sum(F.col("share") - F.col("spelled")).alias("more"))
        found = found.join(better, "row", "left").select("doc_id", "n_tokens", (F.col("log_probability") + F.coalesce("more", F.lit(0.0))).alias("log_probability"))
    return found.withColumn("score", F.col("log_probability") / F.greatest("n_tokens", F.lit(1)))
