"""Hard negatives against brute force and SQL."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from meshlens.llm import hard_negatives, queries

SF = "/root/testdata/sf0.01"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "id long, label int, vec array<float>, block int, tree string, q double"


def brute(rows, divisor=5, positives=5, negatives=3):
    """Rows are (id, label, vector)."""
    sound = {(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in sorted(sound):
        if a[0] % divisor:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(a[2], r[2], strict=False)), r[0], r[1]) for r in sound if r != a))
        for s, p, _ in [r for r in scored if r[2] == a[1]][:positives]:
            met = [r for r in scored if r[2] != a[1] and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(a[0], p, k + 1, r[1], -s, -r[0]) for k, r in enumerate(met)]
    return sorted(out)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, lab, v, 1, "x", 0.5) for i, lab, v in rows], SCHEMA)
    found = hard_negatives.mined(df, F.col("id") % 5 == 0, **options)
    assert found.columns == NAMES
    return sorted(tuple(r) for r in found.collect())


def test_table_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    found = db.execute(queries.SQL["op12_hard_negatives"])
    assert [c[0] for c in found.description] == NAMES
    want = sorted(found.fetchall())
    assert len(want) > 50 and sorted(tuple(r) for r in queries.op12_hard_negatives(spark, SF).collect()) == want


@pytest.mark.parametrize("tree_rows, block_rows", [(1 << 13, 512), (20, 7)])
def test_against_brute_force(spark, tree_rows, block_rows):
    """Clusters, equal vectors in large numbers, ties in scores, and shorter vectors."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(i, int(rng.integers(3)), [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.2]) for i in range(240)]
    rows += [(1000 + i, i % 2, [0.5] * 8) for i in range(150)] + [(2000 + i, 1, [0.25, -0.5]) for i in range(30)]
    want = brute(rows)
    assert len({r[5] for r in want}) < len(want) and len(want) > 300
    assert mined(spark, rows, tree_rows=tree_rows, block_rows=block_rows) == want


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 1.5]), (2, 2, [0.9, 1.0]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]), (10, 1, []), (None, 2, [1.0, 1.2])]
    rows += [(1, 1, [1.0, 1.5]), (2, 2, [0.9, 1.0]), (0, 2, [1.0, 1.0]), (0, 2, [1.0, 1.1])]  # repeated rows, and an id with other contents
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(3, 1, [1.0])]) == [] and mined(spark, [(0, 1, [1.0])]) == []


def test_large_components_are_exact(spark):
    rows = [(i, i % 2, [(1 - i % 2 / 4) * (2**20 + i), (1 - i % 2 / 4) * (2**21 - 3 * i), 1.0]) for i in range(40)] + [(99, 1, [3e30, 1.0, 1.0])]
    want = brute(rows[:-1])
    assert want and max(abs(r[4]) for r in want) > 2**53
    assert mined(spark, rows, tree_rows=8) == want


def test_many_trees_merge_in_levels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(2)), [float(x) for x in rng.normal(size=4)]) for i in range(300)]
    assert mined(spark, rows, tree_rows=2) == brute(rows)


def test_bounds_prune():
    """Far clusters are not looked at: the tree's leaves are met far less often than there are."""
    rng = np.random.default_rng(3)
    q = np.concatenate([rng.integers(-20, 20, (512, 4)) + c for c in ([900, 0, 0, 0], [0, 900, 0, 0], [-900, 0, 0, 0], [0, -900, 0, 0])])
    ids = np.arange(len(q))
    tree = hard_negatives.BallTree(ids, ids % 2, ids, q)
    met = []
    leaf = tree._leaf
    tree._leaf = lambda node, *rest: (met.append(node), leaf(node, *rest))[1]
    found = tree.search(np.array([[0], [0], [0]]), q[:1], hard_negatives.positives_wanted(1, 5))
    scores = q @ q[0]
    order = sorted((i for i in ids if i and i % 2 == 0), key=lambda i: (-scores[i], i))[:5]
    assert found[1][0].tolist() == order and len(met) <= sum(left < 0 for left in tree.left) // 3
