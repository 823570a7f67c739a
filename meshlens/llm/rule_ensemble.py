"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into Spark column expressions.

Shallow trees are boosted on the labels in numpy; every path from a root to a node is a rule, a conjunction of comparisons
of statistics. A lasso logistic regression over all rules keeps few of them. The score is a column expression: the
statistics, the kept rules as 0 or 1, their weighted sum through the logistic function. No row is scored in Python.

Training takes at most ``max_rows`` labelled rows (a documented bound; which rows is fixed by a hash of doc_id), never
those with crc32(doc_id) % 4 = 2. Labels, lang, source and doc_id are no inputs.

Defined cases: null is the empty text, whose statistics are 0; with labels of one kind only, the score is that kind's
smoothed share everywhere, 0.5 without any; of labels that disagree on an id the worse counts; repeated rows score alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import staged, word_count

HELD_OUT, THRESHOLD = 2, 0.7
Rule = tuple[tuple[int, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """The inputs, each a function of the whole text in the JVM."""
    text = F.coalesce(text, F.lit(""))
    left = lambda pattern: F.char_length(F.regexp_replace(text, pattern, ""))
    chars, words = F.char_length(text), F.greatest(word_count(text), F.lit(1))
    lines, runs = F.split(text, "\n"), F.split(text, " ")
    return {
        "chars": chars,
        "words": word_count(text),
        "word_length": chars / words,
        "symbols": left(r"[^#*$%&|<>{}~^=_\\]+") / words,
        "upper": left(r"[^A-Z]+") / F.greatest(chars, F.lit(1)),
        "digits": left(r"[^0-9]+") / F.greatest(chars, F.lit(1)),
        "shouts": (chars - F.char_length(F.replace(text, F.lit("!"), F.lit("")))) / words,
        "stops": (chars - F.char_length(F.replace(text, F.lit("."), F.lit("")))) / words,
        "lines": F.size(lines) / words,
        "new_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "new_words": F.size(F.array_distinct(runs)) / F.size(runs),
    }


NAMES = ["chars", "words", "word_length", "symbols", "upper", "digits", "shouts", "stops", "lines", "new_lines", "new_words"]


@dataclass
class Ensemble:
    rules: list[Rule]
    weights: list[float]
    bias: float

    def score(self, stats: list[Column]) -> Column:
        """The probability of label 1 as a column expression over columns that hold the statistics."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = None
            for at, above, cut in rule:
                test = stats[at] > F.lit(cut) if above else stats[at] <= F.lit(cut)
                met = test if met is None else met & test
            total = total + F.when(met, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, path: Rule, rules: dict[Rule, None], least: int) -> np.ndarray:
    """Second-order boosting tree on rows x; adds its paths to rules and returns its value for each row."""
    value = np.full(len(x), -g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return value
    best, found = 1e-6, None
    base = g.sum() ** 2 / (h.sum() + 1)
    for k, points in enumerate(cuts):
        if not len(points):
            continue
        bins = np.searchsorted(points, x[:, k], side="left")
        gs, hs, ns = (np.cumsum(np.bincount(bins, w, minlength=len(points) + 1))[:-1] for w in (g, h, np.ones(len(x))))
        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - base
        gain[(ns < least) | (len(x) - ns < least)] = -1
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, found = gain[i], (k, float(points[i]))
    if found is None:
        return value
    k, cut = found
    for above in (False, True):
        side = (x[:, k] > cut) == above
        here = (*path, (k, above, cut))
        rules[tuple(sorted(set(here)))] = None
        value[side] = _tree(x[side], cuts, g[side], h[side], depth - 1, here, rules, least)
    return value


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, lasso: float = 0.002, rounds: int = 400, seed: int = 4) -> Ensemble:
    share = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return Ensemble([], [], start)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33))) for c in x.T]
    rules: dict[Rule, None] = {}
    z = np.full(len(y), start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        some = rng.random(len(y)) < 0.5
        mine: dict[Rule, None] = {}
        _tree(x[some], cuts, (p - y)[some], (p * (1 - p))[some], depth, (), mine, max(5, len(y) // 200))
        rules |= mine
        g, h, leaf = p - y, p * (1 - p), np.zeros(len(y))
        for rule in (r for r in mine if not any(set(r) < set(o) for o in mine)):  # leaves
            met = _meets(x, rule)
            leaf[met] = -g[met].sum() / (h[met].sum() + 1)
        z = z + 0.3 * np.clip(leaf, -4, 4)
    kept = list(rules)
    if not kept:  # no statistic tells the labels apart
        return Ensemble([], [], start)
    a = np.stack([_meets(x, r) for r in kept], 1).astype(float)
    spread = np.maximum(a.std(0), 0.05)
    a = (a - a.mean(0)) / spread
    mean = np.stack([_meets(x, r) for r in kept], 1).mean(0)
    step = 1 / (0.25 * np.linalg.norm(a, 2) ** 2 / len(y) + 0.25)
    w, look, bias, t = np.zeros(len(kept)), np.zeros(len(kept)), start, 1.0
    for _ in range(rounds):  # proximal gradient steps with momentum
        r = 1 / (1 + np.exp(-np.clip(a @ look + bias, -30, 30))) - y
        new = look - step * (a.T @ r) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * lasso, 0)
        bias -= step * r.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    some = np.flatnonzero(w)
    weights = w / spread
    return Ensemble([kept[i] for i in some], [float(weights[i]) for i in some], float(bias - (weights * mean).sum()))


def _meets(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) == above
    return out


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, seed: int = 3) -> Ensemble:
    marked = labels.filter(F.col("quality").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != HELD_OUT)).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = staged(marked.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(max_rows), "rules-labels")
    # at most max_rows rows of two numbers, and of each id one text: the least statistics
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.select("doc_id", F.struct("quality", *[c.cast("double").alias(n) for n, c in statistics(F.col("text")).items()]).alias("f"))
    rows = rows.groupBy("doc_id").agg(F.min("f").alias("f")).select("doc_id", "f.*").toArrow().sort_by("doc_id")
    if not rows.num_rows:
        return Ensemble([], [], 0.0)
    return fit(np.stack([rows.column(n).to_numpy() for n in NAMES], 1), rows.column("quality").to_numpy().astype(float))


def scored(docs: DataFrame, model: Ensemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row: one projection, no shuffle."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))
    measured = docs.select("doc_id", held.alias("held_out"), *[c.cast("double").alias(f"_{n}") for n, c in statistics(F.col("text")).items()])
    found = measured.select("doc_id", "held_out", model.score([F.col(f"_{n}") for n in NAMES]).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
