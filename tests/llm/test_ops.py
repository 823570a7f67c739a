"""The ten operators against brute force on small inputs: nulls, empty and long texts, ties, repeated rows, empty tables."""

import collections
import hashlib
import inspect
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meshlens.llm import bpe, chat, components, minhash, mixing, pseudo_lm, quality_ngrams, recompress, rule_ensemble, shared, simhash, url_filter
from tests.llm.conftest import ODD, column

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(n, seed=1, words=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioutnrs") for _ in range(r.randint(1, 6))) for _ in range(200)]
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, words))) for _ in range(n)]
    return [*out, *out[: n // 10], *[t.replace(t.split()[0], "zz", 1) for t in out[: n // 5]]]


# ------------------------------------------------------------------ shared


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\n\r\x0b\x0c\x1cab é漢", max_size=20)), max_size=6))
def test_words(texts):
    w = shared.words_of(column(texts))
    raw = w.data.tobytes()
    got = [[raw[w.start[k] : w.end[k]].decode() for k in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [WORD.findall(t or "") for t in texts]
    flat = [x for t in got for x in t]
    assert len(set(w.hashes().tolist())) == len(set(flat))


def thue_morse(n):
    """Two words of n letters whose polynomial hashes modulo powers of two are equal."""
    w = "a"
    while len(w) < n:
        w += w.translate({97: 98, 98: 97})
    return w, w.translate({97: 98, 98: 97})


def test_words_of_equal_names_are_told_apart(model, monkeypatch):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = [" ".join(thue_morse(n)) for n in (1024, 2048, 4096)] + ["\n".join(thue_morse(2048)), " ".join([*(f"w{k}" for k in range(6))] * 2), "abcdefghij abcdefghik abcdefgh1 abcdefgh2 x", None]
    texts += ["one line\none lino\none line", " ".join([*(f"longerword{k}" for k in range(4)), "x"] * 2 + [*(f"longerword{k}" for k in range(5, 9)), "x"])]
    named = shared.Words.hashes
    for collide in (False, True):
        if collide:  # all longer words of one length have one name
            monkeypatch.setattr(shared.Words, "hashes", lambda self, salt=0: np.where(self.end - self.start > 8, (self.end - self.start).astype(np.uint64), named(self, salt)))
        for t in texts[:6]:
            assert model.encode(pa.array([t]))[0].tolist() == library.encode(t, add_special_tokens=False).ids
        got = quality_ngrams.base_counts(column(texts))
        assert [tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [brute_counts(t or "") for t in texts]


def test_very_long_word(model):
    w = "etaoin" * 50_000
    assert model.encode(pa.array([w]))[0].tolist() == Tokenizer.from_file(P.path("word_bpe_49k.json")).encode(w, add_special_tokens=False).ids


def test_frequent_rows_are_bounded(spark):
    numbers = [1, 1, 2, 3, 3, 4, 7, 8, 8, 100]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "word long, n long")
    for most in range(12):
        found, cut = shared.frequent(df, most)
        kept = sorted(r["n"] for r in found.collect())
        assert len(kept) <= most and kept == [n for n in numbers if n >= 2 ** (cut - 1)]
        more = [n for n in numbers if n >= 2 ** max(cut - 2, 0)]
        assert len(more) > most or len(kept) == len(numbers)
        assert shared.frequent(df, most, most)[0].count() >= min(most, len(numbers))
    assert shared.frequent(df.limit(0), 5)[0].count() == 0


# ------------------------------------------------------------------ 1: mixing


def test_mix_targets_and_bounds(spark):
    rows = [(i, "w " * n, s, len("w " * n)) for i, (n, s) in enumerate([(100, "a"), (0, "a"), (900, "b"), (50, "c"), (70, None), (70, None), (1, "d")])] + [(6, "w", "d", 1), (9, None, "e", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = mixing.taken(d).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes = {"a": 100, "b": 900, "c": 50, "d": 2, "e": 0, None: 140}
    order = ["a", "b", "c", "d", "e", None]
    weights = dict(zip(order, [5, 2, 1, 5, 2, 1], strict=True))
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        rest = {s: weights[s] for s in order if s not in capped}
        level = (total - sum(capped.values())) / sum(rest.values())
        over = [s for s in rest if weights[s] * level > 2 * sizes[s]]
        if not over:
            break
        capped |= {s: 2.0 * sizes[s] for s in over}
    target = {s: capped.get(s, weights[s] * level) for s in order}
    by_size = {v: k for k, v in sizes.items()}
    taken = collections.Counter()
    for r in got:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 17 for s in order)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.taken(d).collect()))
    assert mixing.taken(d.limit(0)).count() == 0
    made = mixing.mixed(d)
    assert made.columns == d.columns and made.select(F.sum(shared.word_count(F.col("text")))).first()[0] == sum(taken.values())


@pytest.mark.parametrize(("weights", "most", "seats"), [([5.0, 2.0, 1.0], [99, 99, 99], 8), ([3.0, 3.0, 3.0], [9, 9, 9], 4), ([7.3, 2.2, 0.5, 0.0], [5, 9, 9, 9], 10), ([1.0], [1], 1), ([0.0, 0.0], [0, 0], 0)])
def test_highest_quotients(spark, weights, most, seats):
    got, left = [0] * len(weights), seats
    while left:
        i = min((i for i in range(len(weights)) if got[i] < most[i] and weights[i] > 0), key=lambda i: (-weights[i] / (2 * got[i] + 1), i))
        got[i] += 1
        left -= 1
    df = spark.createDataFrame([(seats, [(i, w, m) for i, (w, m) in enumerate(zip(weights, most, strict=True))])], "seats long, ps array<struct<ord:long,weight:double,most:long>>")
    assert [p["quota"] for p in sorted(mixing.apportion(df).first()["ps"])] == got


# ------------------------------------------------------------------ 2: SimHash


def brute_print(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in prints}


def test_simhash_groups(docs):
    texts = ODD + some_texts(60)
    d = docs(texts)
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_groups(prints)
    for largest in (20_000, 1):  # 1: every bucket goes on under exact keys
        got = {r["doc_id"]: (r["code"] % 2**64, r["component_id"]) for r in simhash.near_groups(d, largest).collect()}
        assert got == {i: (prints[i], want[i]) for i in prints}
    kept = simhash.keep_first(d)  # goes by Jaccard likeness
    assert {r["doc_id"] for r in kept.collect()} == set(brute_classes(texts)) and kept.columns == d.columns
    assert simhash.near_groups(d.limit(0)).count() == 0 and simhash.keep_first(d.limit(0)).count() == 0


def brute_classes(texts):
    """The least text of each text's class: five-word shingles, links at a Jaccard likeness of 0.8."""
    words = [WORD.findall(t or "") for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset() for w in words]
    above = list(range(len(texts)))

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                above[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def around_threshold(seed=12):
    """Texts with copies a little above and below the threshold, chains of them, and a line that many share."""
    r = random.Random(seed)
    line = " ".join(f"common{k}" for k in range(12))
    texts = []
    for k in range(110):
        w = [f"t{k}w{j}" for j in range(r.randint(20, 60))]
        cut = r.randint(len(w) * 4 // 5, len(w))
        texts += [" ".join(w), " ".join([*w[:cut], *(f"u{k}w{j}" for j in range(r.randint(0, 4)))]), f"{line} x{k}"]
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    return texts


def test_near_dedup_loses_no_link(docs):
    texts = around_threshold()
    want = brute_classes(texts)
    assert 200 < len(set(want)) < len(texts) - 50
    assert {r["doc_id"] for r in simhash.keep_first(docs(texts)).collect()} == set(want)


def test_golay_keys_find_three_errors():
    r = np.random.default_rng(3)
    u = r.integers(0, 2**64, 500, dtype=np.uint64)
    v = u.copy()
    for i in range(len(v)):
        for b in r.choice(64, 3, replace=False):
            v[i] ^= np.uint64(1) << np.uint64(b)
    for make in (simhash.golay_keys, simhash.exact_keys):
        (ka, ia), (kb, ib) = make(u.view(np.int64)), make(v.view(np.int64))
        a, b = collections.defaultdict(set), collections.defaultdict(set)
        for k, i in zip(ka.tolist(), ia.tolist(), strict=True):
            a[i].add(k)
        for k, i in zip(kb.tolist(), ib.tolist(), strict=True):
            b[i].add(k)
        assert all(a[i] & b[i] for i in range(len(u)))


def test_components(spark):
    r = random.Random(4)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    got = {x["node"]: x["component"] for x in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in links:
        if a != b:
            near[a].add(b)
            near[b].add(a)

    def least(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    assert got == {x: least(x) for x in near}


# ------------------------------------------------------------------ 3: BPE


@pytest.fixture(scope="module")
def model():
    return bpe.BpeModel(P.path("word_bpe_49k.json"))


def test_bpe_like_the_library(model, docs):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    r = random.Random(5)
    pool = "abcdefgh'sSTΣςéÉİıßñ漢字カ각😀🏽\u200d \x1c\x85\xa0\t\n.,!?-_</w>|<|endoftext|>0123½Ⅷ٣"  # noqa: RUF001
    texts = [t or "" for t in ODD] + ["".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't ''s"]
    texts += ["".join(r.choice("etaoinshr") for _ in range(r.randint(1, 18))) for _ in range(3000)]
    ids, first = model.encode(pa.array(texts))
    for k, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        mine = ids[first[k] : first[k + 1]]
        assert mine.tolist() == want, t
        assert model.decode(mine) == library.decode(want, skip_special_tokens=False)
    d = docs(ODD)
    for row in bpe.digests(d, P.path("word_bpe_49k.json")).collect():
        want = library.encode(ODD[row["doc_id"]] or "", add_special_tokens=False).ids
        assert (row["n_tokens"], row["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    made = bpe.encoded(d, P.path("word_bpe_49k.json"), decode=True)
    assert made.count() == len(ODD) and {"doc_id", "token_ids", "decoded"} <= set(made.columns)
    assert bpe.digests(d.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_bpe_keeps_within_bounds(model):
    small = bpe.BpeModel(P.path("word_bpe_49k.json"))
    small.runs, small.words, small.nodes = bpe.Kept(5), bpe.Kept(5), bpe.Kept(5)
    for k in range(4):
        texts = pa.array([" ".join(f"w{k}x{j} same" for j in range(20))])
        assert small.encode(texts)[0].tolist() == model.encode(texts)[0].tolist()


# ------------------------------------------------------------------ 4: rules


def test_rule_ensemble(spark, docs):
    r = random.Random(6)
    good = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(80)) + "." for _ in range(150)]
    bad = [t.upper().replace(" ", "!! ") for t in good[:75]] + ["spam " * 60] * 75
    texts = [x for pair in zip(good, bad, strict=True) for x in pair]
    d = docs(texts)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = rule_ensemble.train(d, labels)
    rows = rule_ensemble.scored(d, model).collect()
    held = [x for x in rows if x["held_out"]]
    assert {x["doc_id"] for x in held} == {i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([(x["score"] > 0.5) == (x["doc_id"] % 2 == 0) for x in held]) > 0.95
    assert all(x["predicted"] == (x["score"] >= 0.7) for x in rows)
    odd = rule_ensemble.scored(docs(ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= x["score"] <= 1 for x in odd)
    # the compiled columns say what the rules say
    stats = rule_ensemble.statistics(F.col("text"))
    measured = sorted(docs(texts + ODD).select("doc_id", *[c.cast("double").alias(f"_{n}") for n, c in stats.items()], model.score([c.cast("double") for c in stats.values()]).alias("score")).collect())
    x = np.array([row[1:-1] for row in measured])
    z = model.bias + sum(w * rule_ensemble._meets(x, rule) for rule, w in zip(model.rules, model.weights, strict=True))
    assert len(model.rules) > 3 and np.allclose([row[-1] for row in measured], 1 / (1 + np.exp(-z)))
    again = rule_ensemble.train(d.unionByName(d.withColumn("text", F.lit("other text"))), labels.unionByName(labels.withColumn("quality", F.lit(1))).repartition(3))
    assert again == rule_ensemble.train(d.unionByName(d.withColumn("text", F.lit("other text"))).repartition(5), labels)
    one = rule_ensemble.train(d, labels.filter("quality = 1"))
    assert not one.rules and rule_ensemble.scored(d, one).agg(F.min("score")).first()[0] > 0.9
    assert rule_ensemble.train(d, labels.limit(0)).bias == 0.0


# ------------------------------------------------------------------ 5: LM


def brute_likelihoods(weights, tokens, around):
    """Every token's log-probability from the full distribution, one place at a time."""
    place, bias, top, prior, inner, inner_prior = (w.astype(float) for w in weights)
    out = []
    for i, t in enumerate(tokens):
        h = np.tanh(bias + sum(place[k][around[k][i]] for k in range(len(pseudo_lm.CONTEXT))))
        groups = np.exp(h @ top + prior)
        every = np.concatenate([np.exp(h @ inner[g] + inner_prior[g]) / np.exp(h @ inner[g] + inner_prior[g]).sum() * groups[g] / groups.sum() for g in range(pseudo_lm.GROUPS)])
        assert np.isclose(every.sum(), 1)
        out.append(np.log(every[t]))
    return np.array(out)


def test_gradient_and_likelihood():
    r = np.random.default_rng(2)
    first = np.array([0, 7, 7, 12])
    tokens = r.integers(0, pseudo_lm.SIZE, 12)
    around = pseudo_lm.contexts(tokens, first)
    assert around[0].tolist() == [*[pseudo_lm.SIZE] * 2, *tokens[:5], *[pseudo_lm.SIZE] * 2, *tokens[7:10]]
    weights = [w + r.normal(0, 0.3, w.shape).astype(np.float32) for w in pseudo_lm.first_weights()]
    assert np.allclose(pseudo_lm.log_probabilities(weights, tokens, around), brute_likelihoods(weights, tokens, around), atol=1e-4)
    # the gradient of the mean log-probability, by small differences
    grads = [np.zeros_like(w, dtype=float) for w in weights]
    speed = [np.zeros_like(w) for w in weights]
    stepped = [w.copy() for w in weights]
    pseudo_lm.train_step(stepped, speed, tokens, around)
    grads = [np.sqrt(s) for s in speed]
    for k, w in enumerate(weights):
        for at in map(tuple, np.argwhere(grads[k] > 0)[:3]):
            near = [[x.copy() for x in weights] for _ in range(2)]
            near[0][k][at] += 0.01
            near[1][k][at] -= 0.01
            slope = (brute_likelihoods(near[0], tokens, around).mean() - brute_likelihoods(near[1], tokens, around).mean()) / 0.02
            assert abs(slope) == pytest.approx(grads[k][at], abs=2e-3) and (stepped[k][at] - w[at]) * slope >= 0
    before = pseudo_lm.log_probabilities(weights, tokens, around).mean()
    for _ in range(60):
        pseudo_lm.train_step(weights, speed, tokens, around)
    assert pseudo_lm.log_probabilities(weights, tokens, around).mean() > before + 1


def test_lm_scores_against_brute_force(docs):
    r = random.Random(21)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(1, 9))) for _ in range(1500)]
    texts = [" ".join(r.choices(words, [1 / (k + 9) for k in range(len(words))], k=r.randint(1, 900))) for _ in range(80)] + ODD
    d = docs(texts)
    model, tail = pseudo_lm.train(d)
    assert tail.isEmpty()
    counts = collections.Counter(x for t in texts for x in WORD.findall(t or ""))
    name = lambda x: int(shared.words_of(column([x])).hashes()[0])
    top = {x: k for k, x in enumerate(sorted(counts, key=lambda x: (-counts[x], np.uint64(name(x)).view(np.int64)))[: pseudo_lm.FREQUENT])}
    kind = {x: name(x) % pseudo_lm.CLASSES for x in counts if x not in top}
    pairs = np.ones((257, 257))
    for x, n in counts.items():
        for a, b in zip([256, *x.encode()], [*x.encode(), 256], strict=True):
            pairs[a, b] += n
    spell = np.log(pairs / pairs.sum(1, keepdims=True))

    def inside(x):
        if x in top:
            return 0.0
        whole = 1 + sum(counts[y] for y in kind if kind[y] == kind[x])
        if counts[x] >= pseudo_lm.LEAST:
            return np.log(counts[x] / whole)
        below = sum(counts[y] for y in kind if kind[y] == kind[x] and counts[y] < pseudo_lm.LEAST)
        return np.log((below + 1) / whole) + sum(spell[a, b] for a, b in zip([256, *x.encode()], [*x.encode(), 256], strict=True))

    got = {x["doc_id"]: x for x in pseudo_lm.scored(d, model, tail).collect()}
    for i, t in list(enumerate(texts))[::7]:
        w = WORD.findall(t or "")
        tokens = np.array([top.get(x, pseudo_lm.FREQUENT + kind.get(x, 0)) for x in w], np.int64)
        want = brute_likelihoods(model.weights, tokens, pseudo_lm.contexts(tokens, np.array([0, len(w)]))).sum() + sum(map(inside, w))
        assert got[i]["n_tokens"] == len(w) and got[i]["log_probability"] == pytest.approx(want, rel=1e-4, abs=1e-4)
    # neither the number of tasks nor where the shares are held matters
    other, rest = pseudo_lm.train(d.repartition(7), most=20)
    assert not rest.isEmpty() and np.array_equal(pseudo_lm.flat(model.weights), pseudo_lm.flat(other.weights))
    assert {x["doc_id"]: pytest.approx(x["log_probability"]) for x in pseudo_lm.scored(d, other, rest).collect()} == {i: x["log_probability"] for i, x in got.items()}
    small = [pseudo_lm.train(d.repartition(n), shard=3000)[0].weights for n in (2, 5)]
    assert np.array_equal(*map(pseudo_lm.flat, small)) and not np.array_equal(pseudo_lm.flat(small[0]), pseudo_lm.flat(model.weights))


def test_lm_prefers_what_it_saw(docs):
    d = docs({i: "the cat sat on the mat " * 20 for i in range(40)} | {100: "mat the on sat cat the " * 20, 101: None, 102: ""})
    counts = {r["n"] for r in pseudo_lm.word_counts(d).filter("not spelled").collect()}
    assert counts == {1640, 820}
    got = {r["doc_id"]: r for r in pseudo_lm.scored(d, *pseudo_lm.train(d)).collect()}
    assert got[0]["score"] > got[100]["score"] and got[0]["n_tokens"] == 120
    assert (got[101]["n_tokens"], got[101]["score"], got[102]["log_probability"]) == (0, 0.0, 0.0)
    assert pseudo_lm.scored(d.limit(0), *pseudo_lm.train(d.limit(0))).count() == 0


def test_lm_tells_rare_words_apart(docs):
    r = random.Random(3)
    words = ["".join(r.choice("aeioulnrst") for _ in range(6)) for _ in range(3000)]
    kind = lambda t: int(shared.words_of(column([t])).hashes()[0] % np.uint64(pseudo_lm.CLASSES))
    texts = [" ".join(r.choices(words, [1 / (k + 1) for k in range(3000)], k=2000)) for _ in range(30)]
    model, tail = pseudo_lm.train(docs(texts))
    counts = collections.Counter(" ".join(texts).split())
    least = counts.most_common(pseudo_lm.FREQUENT)[-1][1]
    order = [w for w, n in counts.most_common() if pseudo_lm.LEAST <= n < least]
    assert len(model.words) + pseudo_lm.FREQUENT == sum(n >= pseudo_lm.LEAST for n in counts.values()) > 1000
    one, other = next((a, b) for a in order for b in order if kind(a) == kind(b) and counts[a] > counts[b])
    junk = next(w for w in ("".join(r.choice("qxzjkvw") for _ in range(6)) for _ in range(10**5)) if kind(w) == kind(one))
    first, second, third = (x["score"] for x in sorted(pseudo_lm.scored(docs([f"{texts[0]} {w}" for w in (one, other, junk)]), model, tail).collect()))
    assert first > second > third


def test_lm_trains_on_every_token(docs):
    use = {k: p.default for k, p in inspect.signature(pseudo_lm.train).parameters.items()}
    first = np.array([0, 1, 1, 3, 10, 30])
    seen = np.concatenate([pseudo_lm.picked(first, use["stride"], turn) for turn in range(use["rounds"])])
    assert sorted(seen.tolist()) == list(range(30))
    weights = pseudo_lm.train(docs(["a"] * 20))[0].weights
    assert not np.array_equal(pseudo_lm.flat(weights), pseudo_lm.flat(pseudo_lm.first_weights()))
    with pytest.raises(ValueError, match="leave tokens out"):
        pseudo_lm.train(docs(["a"]), 2, 8)


# ------------------------------------------------------------------ 6: substrings


def brute_removed(texts):
    seen, out = set(), {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            if key in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest())
    return out


def test_substring_dedup(spark, docs):
    r = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(60))
    base = some_texts(30, 8, 120)
    texts = ODD + base + [f"{' '.join(base[k].split()[:9])} {passage} {base[k]}" for k in range(12)] + ["a " * 70, "ab cd " * 40, "x " * 19, "y " * 20, "y " * 21, f"{passage} {passage}", " ".join(passage.split()[5:40])]
    texts += [" ".join(r.choice("ab") for _ in range(200)) for _ in range(10)]
    ids = {5 * i + 3: t for i, t in enumerate(texts)}
    d = docs(ids).repartition(5)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in recompress.digests(d).collect()}
    want = brute_removed(ids)
    assert got == want
    cut = recompress.without_repeats(d)
    rows = {x["doc_id"]: x["text"] for x in cut.collect()}
    assert cut.columns == d.columns
    for i, (n, gone, sha) in want.items():
        if n and gone == n:
            assert i not in rows
        else:
            assert hashlib.sha256(" ".join(WORD.findall(rows[i] or "")).encode()).hexdigest() == sha
        if not gone:
            assert rows[i] == ids[i]
    assert recompress.digests(d.limit(0)).count() == 0
    twice = recompress.digests(d.unionByName(d)).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in twice) == sorted((i, *v) for i, v in want.items() for _ in range(2))


def test_substring_dedup_tells_rows_apart(spark, monkeypatch):
    r = random.Random(17)
    words = [f"q{k}" for k in range(400)]
    passage = " ".join(words[:50])
    texts = [" ".join(r.choices(words, k=70)) for _ in range(8)] + [passage, f"x {passage}", f"{passage} y", " ".join(words[10:45]), " ".join(thue_morse(1024) * 30)]
    ids = [1, 2, 2, None, None, 5, 5, 5, None, 9, 2, None, None]
    rows = [*zip(ids, texts, strict=True), (None, texts[3]), (5, texts[5]), (None, None), (4, None)]
    d = spark.createDataFrame([(*row, "x") for row in rows], "doc_id long, text string, _many string").repartition(4)
    parts = {(x["doc_id"], x["text"]): x["_part"] for x in shared.told_apart(d.select("doc_id", "text")).collect()}
    order = sorted(parts, key=lambda k: (k[0] is None, k[0] or 0, parts[k]))
    want = brute_removed(dict(enumerate(k[1] for k in order)))
    for frequent in (None, 1, 10**6):  # keys whose units go on by their words: the usual number, few, all
        if frequent:
            monkeypatch.setattr(recompress, "FREQUENT_KEYS", frequent)
        got = sorted(((x["doc_id"] or 0, x["n_words"], x["n_removed"], x["kept_sha256"]) for x in recompress.digests(d).collect()))
        assert got == sorted((i or 0, *want[order.index((i, t))]) for i, t in rows)
    assert recompress.without_repeats(d).columns == d.columns


# ------------------------------------------------------------------ 7: chat

ROLES = st.sampled_from(["user", "assistant", "system", "tool", "", "a b\n"])
BITS = st.lists(st.sampled_from(["</s>", "[INST]", " [/INST]", "\\", "<|end|>", " <|end|>", "<<SYS>>", "\n<</SYS>>\n\n", "<s>", "x", " ", "<|image:0|>", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(ROLES, BITS), max_size=6))
def test_chat_reads_back(turns):
    f = chat.format_turns(turns)
    assert [(r, chat.unescape(b)) for r, b in chat.read_turns(f.text)] == turns
    assert "".join(chat.unescape(f.text[a:b]) for a, b in f.spans) == "".join(t for r, t in turns if r == "assistant")


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see \\"}, {"type": "image", "ref": "i.png", "width": 100, "height": 50}, {"type": "audio", "ref": "a.wav", "seconds": 1.5}, {"type": "document", "ref": "d.pdf", "pages": 2}, {"type": "text", "text": "<|image:0|>"}]
    f = chat.format_turns([("user", parts)])
    assert [chat.read_parts(b) for _, b in chat.read_turns(f.text)] == [[("text", "see \\"), ("image", 0), ("audio", 1), ("document", 2), ("text", "<|image:0|>")]]
    assert [(a.kind, a.reference, a.tokens) for a in f.attachments] == [("image", "i.png", 8), ("audio", "a.wav", 38), ("document", "d.pdf", 1024)]
    f = chat.format_turns([("user", [{"type": "video", "ref": "v.mp4"}, {"type": "text", "text": "x"}, None])])
    assert f.errors == ["unknown content part: video", "unknown content part: None"] and [(a.kind, a.reference, a.tokens) for a in f.attachments] == [("unknown", "v.mp4", 0), ("unknown", "", 0)]
    assert [chat.read_parts(b) for _, b in chat.read_turns(f.text)] == [[("unknown", 0), ("text", "x"), ("unknown", 1)]]
    part = "struct<type string, text string, ref string, width int, height int>"
    typed = spark.createDataFrame([(1, 0, "user", "x", [("text", "a", None, None, None), ("image", None, "i.png", 28, 29), ("map", None, None, None, None)]), (1, 1, "assistant", "b", None)], f"conv_id long, turn long, role string, text string, parts array<{part}>")
    made = chat.format_conversations(typed, parts_col="parts")
    assert [tuple(r) for r in made.select("formatted", "errors").collect()] == [("<s>[INST] a<|image:0|><|unknown:1|> [/INST] b </s>", ["unknown content part: map"])]
    assert [tuple(r) for r in chat.digests(made).select("n_turns", "loss_chars", "n_attachments", "expanded_tokens").collect()] == [(2, 1, 2, 2)]
    rows = [(1, 1, "assistant", None, "x"), (1, 0, "user", "hi", "x"), (None, 0, None, None, "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\nhi\nassistant\n\n").hexdigest() and got[1]["loss_chars"] == 0
    assert (got[2]["n_turns"], got[2]["loss_sha256"]) == (2, hashlib.sha256(b"aa").hexdigest()) and got[None]["n_turns"] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


# ------------------------------------------------------------------ 8: MinHash


def test_minhash_estimates_jaccard():
    r = random.Random(9)
    w = [f"w{k}" for k in range(400)]
    texts = [" ".join(w), " ".join(w[:300] + [f"v{k}" for k in range(100)]), " ".join(reversed(w)), " ".join(w)]
    s = minhash.signatures(pa.array(texts))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(396)} for t in texts]
    for a in range(4):
        for b in range(4):
            true = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            assert abs((s[a] == s[b]).mean() - true) < 0.17, r
    assert (s[0] == s[3]).all()
    odd = minhash.signatures(column(ODD))
    assert (odd[0] == odd[1]).all() and (odd[9] == odd[10]).all()


def test_minhash_neighbours(docs):
    texts = {3 * k: t for k, t in enumerate(ODD + some_texts(40))}
    d, ids = docs(texts), sorted(texts)
    for rows_a_range in (7, 500):
        got = {r["doc_id"]: r for r in minhash.with_neighbours(d, rows_a_range).collect()}
        assert len(got) == len(texts)
        for i, j in zip(ids, ids[1:] + ids[:1], strict=True):
            a, b = texts[i] or "", texts[j] or ""
            half = len(a) // 2
            edited = a[: len(a) - half] + b[:half]
            assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
            assert 0 <= got[i]["near_edited"] <= 1
            assert got[i]["near_next"] == np.mean([got[i]["fingerprint"][8 * k : 8 * k + 8] == got[j]["fingerprint"][8 * k : 8 * k + 8] for k in range(128)])
    assert minhash.with_neighbours(d.limit(0)).count() == 0 and minhash.with_neighbours(d.limit(1)).count() == 1


def test_minhash_classes(docs):
    base = " ".join(f"w{k}" for k in range(200))
    near = " ".join(f"w{k}" for k in range(195)) + " a b c d e"
    far = " ".join(f"v{k}" for k in range(200))
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs([base, far, near, base, None, ""])).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 4}


def test_keep_first_keeps_unlike_rows_of_one_id(spark):
    texts = [" ".join(f"{x}{k}" for k in range(80)) for x in "abcd"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (9, texts[3])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for module in (simhash, minhash):
        assert sorted((r["doc_id"] or 0, r["text"][0]) for r in module.keep_first(d).collect()) == [(0, "a"), (0, "b"), (5, "c"), (5, "d")]


def test_minhash_loses_no_link(spark, docs):
    texts = around_threshold(13)
    want = brute_classes(texts)
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(docs(texts)).collect()}
    assert got == dict(enumerate(want))
    # two texts under one id, and none: neither's links are lost
    one, two, three = (' '.join(f'{x}{k}' for k in range(60)) for x in 'xyz')
    rows = [(7, one), (7, two), (8, f"{two} end"), (None, three), (None, f"{three} end"), (None, "some other text without any id")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    named = collections.Counter(x["class_id"] for x in minhash.near_duplicates(d).collect())
    assert sorted(named.values()) == [1, 2, 3]



# ------------------------------------------------------------------ 9: quality rules


def brute_counts(x):
    w, seen, dup = WORD.findall(x), set(), 0
    for line in x.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), dup, len(cover)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \n#é\t", max_size=60)), min_size=1, max_size=5))
def test_quality_counts(texts):
    got = quality_ngrams.base_counts(column(texts))
    assert [tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for i in range(len(texts))] == [brute_counts(t or "") for t in texts]


def test_quality_model(spark, docs):
    r = random.Random(10)
    good = [" ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)) for _ in range(200)]
    texts = [t if k % 2 else "%% ".join(t.split()) for k, t in enumerate(good)]
    d = docs(texts)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    model = quality_ngrams.train(d, labels)
    rows = quality_ngrams.judge(d, model).collect()
    held = [x for x in rows if zlib.crc32(str(x["doc_id"]).encode()) % 4 == 2]
    assert np.mean([x["kept"] == bool(x["doc_id"] % 2) for x in held]) > 0.95
    kept = quality_ngrams.keep_good(d, model)
    assert kept.columns == d.columns and {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in rows if x["kept"]}
    plain = quality_ngrams.train(d, labels.limit(0))
    assert all(x["kept"] != x["base_failed"] for x in quality_ngrams.judge(docs(ODD), plain).collect())
    assert quality_ngrams.judge(d.limit(0), model).count() == 0


def test_nulls_in_every_column(spark):
    d = spark.createDataFrame([(None, "a b c", None, None, None), (None, "w " * 40, None, None, None), (5, None, "en", "s", 0), (7, "w " * 40, "en", "s", 80)], "doc_id long, text string, lang string, source string, n_chars int")
    labels = spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    path = P.path("word_bpe_49k.json")
    made = [mixing.taken(d), simhash.near_groups(d), bpe.digests(d, path), rule_ensemble.scored(d, rule_ensemble.train(d, labels)), pseudo_lm.scored(d, *pseudo_lm.train(d)), recompress.digests(d), minhash.with_neighbours(d), minhash.near_duplicates(d), quality_ngrams.judge(d, quality_ngrams.train(d, labels))]
    assert [m.count() for m in made] == [4] * len(made)
    assert {r["n_removed"] for r in recompress.digests(d).collect()} == {0, 39, 40}


# ------------------------------------------------------------------ 10: URLs


def test_digest_array(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda k: len(k) % 3)  # collisions everywhere
    url_filter.write_digests(str(tmp_path / "x"), [("allow", "com", "/"), ("block", "a.com", "/x"), ("allow", "b.com", "/y")])
    table = url_filter.DigestArray(str(tmp_path / "x"))
    assert [table.string(i).decode() if i >= 0 else None for i in table.find([b"com/", b"a.com/x", b"b.com/y", b"c.com/z"])] == ["com/", "a.com/x", "b.com/y", None]
    url_filter.write_digests(str(tmp_path / "none"), [])
    assert url_filter.DigestArray(str(tmp_path / "none")).find([b"x"]).tolist() == [-1]


def test_urls(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/")]
    urls = [None, "", "no scheme", "http://Example.COM/en/1?x", "http://www.example.com/en/", "http://example.com", "http://xexample.com/en/", "http://a.net/es/#f", "http://a.net/ES/", "x://h?a/b://c", "http://example.com/en"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(url_filter.judge(df, rules).collect())]
    assert got == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("example.com", "/en/1", "example.com/en/", "block"), ("www.example.com", "/en/", "www.example.com/en/", "allow"), ("example.com", "", None, "allow"),
        ("xexample.com", "/en/", "com/", "allow"), ("a.net", "/es/", "net/es/", "block"), ("a.net", "/ES/", None, "allow"), ("h", "", None, "allow"), ("example.com", "/en", "com/", "allow"),
    ]
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_long_hosts_and_many_rules(spark):
    """A URL of megabytes is probed with no more keys than the rules have lengths."""
    rules = [("block", f"h{k % 50_000}.example.com", f"/p{k}/") for k in range(100_000)] + [("allow", "a.a", "/"), ("block", "a.a.a", "/x")]
    lengths = {}
    for host, path in {(len(h), len(p)) for _, h, p in rules}:
        lengths.setdefault(host, []).append(path)
    assert len(url_filter.probes("a." * 2_500_000 + "a", "/x" + "y" * 1_000_000, lengths)) <= 2 * sum(map(len, lengths.values()))
    urls = ["http://" + "a." * 2_500_000 + "a/x", "http://" + "b" * 5_000_000, "http://h7.example.com/p50007/q", "http://www.h7.example.com/p50007/", "http://h7.example.com/p50008/", "http://a.a/" + "z" * 5_000_000, "http://xa.a/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, rules).collect()}
    assert got == {0: ("a.a.a/x", "block"), 1: (None, "allow"), 2: ("h7.example.com/p50007/", "block"), 3: ("h7.example.com/p50007/", "block"), 4: (None, "allow"), 5: ("a.a/", "allow"), 6: (None, "allow")}
