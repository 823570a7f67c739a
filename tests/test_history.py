"""Hashes of graphs and reports on large totals."""

import hashlib

import pytest

from meshlens.operators import diff, history


def plain_hash(ids, flags):
    return hashlib.sha256(("\x1e".join(sorted(ids)) + "\x1d" + "\x1e".join(sorted(f"{a}\x1f{b}" for a, b in flags))).encode()).hexdigest()[:16]


@pytest.mark.parametrize("n_ids, n_flags", [(0, 0), (0, 3), (3, 0), (2000, 1501)])
def test_hash_over_many_ids(spark, n_ids, n_flags):
    """Ids come in any order and places; the digest is that of their sorted text, also where there are none."""
    ids, marks = [f"n{k * 7919 % n_ids}-é" for k in range(n_ids)], [(f"n{k}", f"c{k % 3}") for k in range(n_flags)]
    nodes = spark.createDataFrame([*((i,) for i in ids), (None,)], "id string").repartition(5)
    flags = spark.createDataFrame([*marks, ("n", None)], "owner_id string, code string").repartition(3)
    assert [r["graph_hash"] for r in history.digest(nodes, flags).collect()] == [plain_hash(ids, marks)]


def test_no_row_holds_all_ids(spark):
    nodes = spark.createDataFrame([("a", "endpoint", 1.0)], "id string, type string, risk_score double")
    edges = spark.createDataFrame([], "type string")
    flags = spark.createDataFrame([("a", "node", "x", "low")], "owner_id string, owner_kind string, code string, severity string")
    taken = history.snapshot(nodes, edges, flags, 0)
    assert taken.first()["graph_hash"] == plain_hash(["a"], [("a", "x")])
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list(id" not in plan and "owner_id" not in plan.split("collect_list", 1)[-1].split("\n")[0]


def test_report_of_large_totals(spark):
    """Ten million and more are spelled out, as Python does."""

    def side(risk):
        nodes = spark.createDataFrame([("a", risk)], "id string, risk_score double")
        edges = spark.createDataFrame([], "id string, risk_score double, confidence string")
        flags = spark.createDataFrame([], "owner_id string, code string, severity string, category string, message string, ord long")
        return {"nodes": nodes, "edges": edges, "flags": flags}

    for a, b, line in ((12_345_678.5, 36_000_000.5, "12345678.5 -> 36000000.5 (+23654322)"), (2e7, 5.0, "20000000.0 -> 5.0 (-19999995)"), (1.5, 1.5, "1.5 -> 1.5 (0)")):
        assert diff.text_lines(side(a), side(b)).collect()[3]["line"] == f"  risk  {line}"
