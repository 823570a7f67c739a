import pytest
from pyspark.sql import functions as F

from meshlens import schema
from meshlens.operators import coverage, diff, graph, history, match, runtime, score, traverse


def endpoints(spark, *rows):
    return spark.createDataFrame([(k, i, m, p, "a.py", k, "h", "fastapi", False, None, None, None) for k, (i, m, p) in enumerate(rows)], schema.ENDPOINTS)


def calls(spark, *rows):
    return spark.createDataFrame([(k, i, m, u, "certain", "w.ts", k, False, False, None, None, None) for k, (i, m, u) in enumerate(rows)], schema.CALLS)


def flags(spark, *rows):
    return spark.createDataFrame([(o, k, n, c, s, g, "", e, "") for n, (o, k, c, s, g, e) in enumerate(rows)], schema.FLAGS)


def stats(spark, n_match, n_miss):
    eps = endpoints(spark, *[(f"e{i}", "GET", f"/a{i}x") for i in range(n_match)]) if n_match else endpoints(spark, ("e", "PUT", "/none"))
    cs = calls(spark, *[(f"c{i}", "GET", f"/a{i}x") for i in range(n_match)], *[(f"m{i}", "GET", f"/miss{i}x") for i in range(n_miss)])
    return match.match_stats(cs, eps).first(), match.match_flags(cs, eps)


def test_discovery_guard_boundaries(spark):
    found, marks = stats(spark, 1, 24)
    assert found["discovery_guard"] and {r["severity"] for r in marks.filter("code = 'orphan_call'").collect()} == {"low"}
    assert not stats(spark, 24, 1)[0]["discovery_guard"]
    assert not stats(spark, 0, 1)[0]["discovery_guard"]
    assert not stats(spark, 5, 15)[0]["discovery_guard"]  # exactly a quarter


def test_dynamic_calls_and_methods(spark):
    eps, cs = endpoints(spark, ("e", "GET", "/u/{id}")), calls(spark, ("a", "POST", "/u/1"), ("b", "GET", "<dynamic>"), ("c", "GET", "/u/42?x=1"))
    codes = {(r["owner_id"], r["code"]) for r in match.match_flags(cs, eps).collect()}
    assert codes == {("a", "orphan_call"), ("b", "unresolvable_url")}


def test_unknown_fields_stay_silent(spark):
    eps = endpoints(spark, ("e", "GET", "/u")).withColumn("response_fields", F.lit(None).cast("array<string>"))
    cs = calls(spark, ("a", "GET", "/u")).withColumn("expected_fields", F.array(F.lit("x")))
    assert match.missing_fields(match.matched(cs, eps)).isEmpty()


def test_scores(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    marks = flags(spark, ("a", "node", "x", "critical", "security", ""), ("b", "node", "y", "low", "quality", ""), *[("c", "node", "z", "critical", "security", str(i)) for i in range(5)])
    got = {r["id"]: r["risk_score"] for r in score.node_scores(nodes, marks).collect()}
    assert got == {"a": 100.0, "b": 5.0, "c": 100.0}
    edges = spark.createDataFrame([("e", "a", "nowhere")], "id string, source string, target string")
    assert score.edge_scores(edges, marks, score.node_scores(nodes, marks)).first()["risk_score"] == 80.0


def test_first_and_last_write(spark):
    df = spark.createDataFrame([(1, "a", "old"), (2, "a", "new"), (3, "b", "x")], "ord long, id string, label string")
    assert {(r["id"], r["label"]) for r in graph.merge_nodes(df).collect()} == {("a", "old"), ("b", "x")}
    assert {(r["id"], r["ord"], r["label"]) for r in graph.merge_edges(df).collect()} == {("a", 1, "new"), ("b", 3, "x")}


def observed(spark, rows):
    return spark.createDataFrame([(i, 0, m, r, p, float(d), s, t) for i, (m, r, p, d, s, t) in enumerate(rows)], schema.OBSERVATIONS)


def test_rollup_ranks_and_rates(spark):
    eps = endpoints(spark, ("e", "GET", "/u/{id}"), ("f", "GET", "/quiet"))
    o = observed(spark, [("GET", "/u/{x}", None, 100 * k, 500 if k == 1 else 200, "") for k in range(1, 11)])
    r = {x["endpoint"]: x for x in runtime.rollup(eps, runtime.observed(eps, o)).collect()}
    assert (r["e"]["req_count"], r["e"]["p50_ms"], r["e"]["p95_ms"], r["e"]["error_rate"], r["e"]["confidence"]) == (10, 500.0, 1000.0, 0.1, "certain")
    assert r["f"]["req_count"] == 0 and r["f"]["p50_ms"] is None
    marks = {x["code"] for x in runtime.runtime_flags(eps, flags(spark, ("f", "node", "unused_endpoint", "low", "contract", "")), runtime.rollup(eps, runtime.observed(eps, o))).collect()}
    assert marks == {"high_error_rate", "confirmed_dead"}  # 1000 ms is not above 1000


def test_fallback_by_pattern(spark):
    eps = endpoints(spark, ("e", "GET", "/u/{id}"))
    o = observed(spark, [("GET", None, "/u/7", 1, 200, ""), ("GET", None, "/u/8/?q=1", 1, 200, ""), ("POST", None, "/u/7", 1, 200, ""), ("GET", None, "/u/7/x", 1, 200, "")])
    r = runtime.rollup(eps, runtime.observed(eps, o)).first()
    assert (r["req_count"], r["confidence"]) == (2, "probable")


def test_attribution_splits_evenly(spark):
    eps = endpoints(spark, ("e", "GET", "/u/{id}"))
    o = observed(spark, [("GET", "/u/{id}", None, 1, 200, f"t{k}") for k in range(6)])
    w = spark.createDataFrame([(0, "w0", "c0", "e"), (1, "w1", "c1", "e")], "ord long, id string, source string, target string")
    cs = calls(spark, ("c0", "GET", "/u/1"), ("c1", "GET", "/u/2"))
    owners = spark.createDataFrame([("c0", "A", 0), ("c1", "B", 1)], "call string, component string, ord long")
    cl = spark.createDataFrame([(k, f"t{k}", "GET", "/u/5") for k in range(6)], schema.CLIENTS)
    got = runtime.attributed(w, cs, owners, runtime.observed(eps, o), cl)
    assert {r["id"]: r["req_count"] for r in got.collect()} == {"w0": 3.0, "w1": 3.0}
    assert runtime.top_callers(got).first()["component"] == "A"
    none = runtime.attributed(w, cs, owners, runtime.observed(eps, o), cl.filter("false"))
    assert {(r["req_count"], r["attributed"], r["endpoint_req_count"]) for r in none.collect()} == {(None, False, 6)}


def test_window_and_cap(spark):
    o = spark.createDataFrame([(k, k * 3_600_000, "k") for k in range(5)], "ord long, ts_ms long, key string")
    assert runtime.in_window(o, 4 * 3_600_000, 1).count() == 2
    assert {r["ord"] for r in runtime.last_per_key(o, "key", 2).collect()} == {3, 4}


def test_diff_and_gate(spark):
    old = spark.createDataFrame([("a", 1.0, "certain"), ("b", 2.0, None)], "id string, risk_score double, confidence string")
    new = spark.createDataFrame([("b", 2.5, None), ("c", 1.0, "certain")], "id string, risk_score double, confidence string")
    assert {(r["id"], r["status"]) for r in diff.wire_diff(old, new).collect()} == {("a", "removed"), ("b", "changed"), ("c", "added")}
    f_old, f_new = flags(spark, ("a", "node", "x", "low", "quality", "1")), flags(spark, ("a", "node", "x", "low", "quality", "2"), ("a", "node", "y", "high", "quality", ""), ("b", "node", "z", "critical", "quality", ""))
    assert [r["code"] for r in diff.new_flags(f_old, f_new).collect()] == ["z", "y"]
    assert diff.gate(diff.new_flags(f_old, f_new), "critical").first()[0] and not diff.gate(diff.new_flags(f_new, f_old), "low").first()[0]
    assert diff.risk_totals(old, new).first()["delta"] == 0.5


def test_history(spark):
    h = spark.createDataFrame([(float(k), "", str(k // 2), float(k), {"a": k, "b": 3 - k}) for k in range(4)], "ts double, iso string, graph_hash string, total_risk double, by_code map<string,long>")
    assert [r["ts"] for r in history.recorded(h).collect()] == [0.0, 2.0]
    assert [r["ts"] for r in history.recorded(h, 1).collect()] == [2.0]
    r = history.churn(h).first()
    assert (r["introduced"], r["resolved"], r["risk_delta"]) == (["a"], ["b"], 1.0)
    assert history.churn(h.limit(1)).first()["introduced"] == []


def test_coverage(spark):
    lines = spark.createDataFrame([("/ci/app/a.py", 2, "executed"), ("/ci/app/a.py", 3, "missing"), ("x/b.py", 2, "missing"), ("y/b.py", 2, "executed"), ("c.py", 9, "missing")], schema.COVERAGE)
    nodes = spark.createDataFrame([("a", "app/a.py", 1, 3), ("b", "b.py", 1, 3), ("c", "c.py", 1, 20), ("d", "c.py", 9, 20), ("e", "c.py", 1, 0)], "id string, file string, line int, end_line int")
    assert {r["id"]: r["coverage_pct"] for r in coverage.body_coverage(nodes, lines).collect()} == {"a": 50.0, "c": 0.0}
    marks = coverage.coverage_flags(nodes.withColumn("handler", F.lit("h")), coverage.body_coverage(nodes, lines))
    assert {(r["owner_id"], r["severity"]) for r in marks.collect()} == {("c", "high")}


def test_taint_hops(spark):
    fn = [("direct", ["q"], ["q"], [7]), ("one", ["a"], [], []), ("two", ["a"], [], []), ("three", ["a"], [], []), ("off", ["a"], [], []), ("loop", ["a"], [], [])]
    f = spark.createDataFrame(fn, "fqn string, params array<string>, sql_sink_params array<string>, raw_sql_lines array<int>")
    w = spark.createDataFrame([("one", 0, "direct", ["a"]), ("two", 0, "one", ["a"]), ("three", 0, "two", ["a"]), ("off", 0, "direct", [None]), ("loop", 0, "loop", ["a"])], "fqn string, ord int, target string, arg_params array<string>")
    got = {r["fqn"]: (r["param"], r["witness"], r["line"]) for r in traverse.sql_taint(f, w).collect()}
    assert got == {"direct": ("q", "direct", 7), "one": ("a", "direct", 7), "two": ("a", "direct", 7)}


def test_callees(spark):
    f = spark.createDataFrame([("m.A.x", "m", "A.x"), ("m.A.y", "m", "A.y"), ("m.f", "m", "f"), ("n.g", "n", "g")], "fqn string, module string, qname string")
    i = spark.createDataFrame([("m", "g", "n.g"), ("m", "n", "n"), ("m", "f", "lost.f")], "module string, local string, fqn string")
    c = spark.createDataFrame([("m.A.x", k, s) for k, s in enumerate(["self.y", "g", "n.g", "f", "other.z"])], "fqn string, ord int, callee string")
    assert {r["callee"]: r["target"] for r in traverse.resolve_callees(c, f, i).collect()} == {"self.y": "m.A.y", "g": "n.g", "n.g": "n.g", "f": None, "other.z": None}


def test_walk_depth_and_cycles(spark):
    hops = spark.createDataFrame([(f"f{k}", f"f{k + 1}") for k in range(9)] + [("f2", "f0"), ("f1", "f1")], "fqn string, target string")
    h = spark.createDataFrame([("ep", "f0")], "parent string, fqn string")
    got = {r["target"] for r in traverse.call_walk(h, hops, h.select("fqn", F.lit("M").alias("model"))).collect()}
    assert got == {"fn:f0", *[f"fn:f{k}" for k in range(1, 6)], "db:M"}


def test_nesting_and_inheritance_cut_cycles(spark):
    e = spark.createDataFrame([("a", "x/", "b", None), ("b", "y/", "a", None), ("b", "z", None, "view")], "module string, pattern string, include string, leaf string")
    roots = spark.createDataFrame([("a",)], "module string")
    assert [r["path"] for r in traverse.nested_routes(e, roots).collect()] == ["x/z"]
    fields = spark.createDataFrame([("A", "a"), ("B", "b")], "name string, field string")
    bases = spark.createDataFrame([("A", "B"), ("B", "A")], "name string, base string")
    assert {r["name"]: r["fields"] for r in traverse.inherited_fields(fields, bases).collect()} == {"A": ["a", "b"], "B": ["a", "b"]}


@pytest.mark.parametrize("values", [[1.0], [2.5] * 7 + [1e-300, 1e300, 7.0, -3.0], [float(k % 997) / 7 for k in range(5000)], [1 + k * 2**-52 for k in range(40)] + [5e200], [-1.7e308, 1.7e308, 0.0, 3.0, 4.0], list(range(100))])
def test_ranks_by_histograms(spark, values):
    """The same as sorting, with as few as three bins a round, and no window over values."""
    df = spark.createDataFrame([("a" if k % 3 else None, v) for k, v in enumerate(map(float, values))] + [("b", None)], "k string, v double")
    quantiles = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    found = runtime.nearest_ranks(df, ["k"], "v", quantiles, bins=3)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for key in ("a", None):
        held = sorted(float(v) for k, v in enumerate(values) if ("a" if k % 3 else None) == key)
        if held:
            want[key] = tuple(round(held[min(len(held) - 1, round(q * (len(held) - 1)))], 1) for q in quantiles.values())
    assert {r["k"]: tuple(r[n] for n in quantiles) for r in found.collect()} == want


def test_ranks_of_many_values(spark):
    df = spark.range(300_000).selectExpr("id % 2 as k", "cast(pmod(xxhash64(id), 1000000007) as double) as v")
    for r in runtime.nearest_ranks(df, ["k"], "v", {"p": 0.95}).collect():
        held = sorted(x["v"] for x in df.filter(F.col("k") == r["k"]).collect())
        assert r["p"] == held[round(0.95 * (len(held) - 1))]


def test_nested_bodies_meet_lines_once(spark):
    nodes = spark.createDataFrame([(f"n{k}", "a.py", k, 400 - k) for k in range(150)] + [("none", "a.py", 500, 400), ("start", "a.py", None, 9), ("zero", "b.py", 1, 0)], "id string, file string, line int, end_line int")
    lines = spark.createDataFrame([("src/a.py", k, "executed" if k % 3 else "missing") for k in range(1, 400, 2)] + [("src/a.py", 9, "executed")], "file string, line int, state string")
    found = coverage.body_coverage(nodes, lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " > line" not in plan and "<= end_line" not in plan
    state = {k: k % 3 != 0 or k == 9 for k in range(1, 400, 2)}
    want = {}
    for k in range(150):
        inside = [ran for at, ran in state.items() if k < at <= 400 - k]
        want[f"n{k}"] = round(sum(inside) / len(inside) * 100, 1)
    assert {r["id"]: r["coverage_pct"] for r in found.collect()} == want
