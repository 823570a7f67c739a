"""Walks and closures against brute force, at sizes where paths could not be kept."""

import random
import re

import pytest

from meshlens.operators import runtime, traverse


def brute_walk(handlers, calls, queries, depth):
    hops = {(a, b) for a, b in calls if b is not None and a != b}
    out = set()
    for parent, fqn in handlers:
        seen, front, left = {fqn}, [(fqn, parent)], [(fqn, parent)]
        for _ in range(depth):
            onward = {b for f, _ in front for a, b in hops if a == f} - seen
            seen |= onward
            front = [(b, f"fn:{b}") for b in onward]
            left += front
        for f, at in left:
            out |= {(f"{at}->fn:{b}", at, f"fn:{b}", "calls") for a, b in hops if a == f}
            out |= {(f"{at}->q:{m}", at, f"db:{m}", "queries") for g, m in queries if g == f}
    return out


@pytest.mark.parametrize("seed", range(6))
def test_walk(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([4, 8, 25])
    names = [f"f{k}" for k in range(n)]
    calls = [(rng.choice(names), rng.choice([*names, None])) for _ in range(2 * n)]
    handlers = [(f"ep{k}", rng.choice(names)) for k in range(rng.choice([1, 3, n]))]
    queries = [(f, "M") for f in names[::3]]
    depth = rng.choice([1, 2, 4])
    got = traverse.call_walk(spark.createDataFrame(handlers, "parent string, fqn string"), spark.createDataFrame(calls, "fqn string, target string"), spark.createDataFrame(queries, "fqn string, model string"), depth)
    assert {tuple(r) for r in got.collect()} == brute_walk(handlers, calls, queries, depth)


def test_a_function_is_kept_twice_at_most(spark, monkeypatch):
    """Many handlers call one helper: the walk's state follows functions, not handlers times functions."""
    rows = []
    real = traverse.staged
    monkeypatch.setattr(traverse, "staged", lambda df, tag: (rows.append(df.count()), real(df, tag))[1])
    calls = [(f"h{k}", "shared") for k in range(300)] + [("shared", f"g{k}") for k in range(40)]
    got = traverse.call_walk(spark.createDataFrame([(f"e{k}", f"h{k}") for k in range(300)], "parent string, fqn string"), spark.createDataFrame(calls, "fqn string, target string"), spark.createDataFrame([("g1", "M")], "fqn string, model string"))
    assert got.count() == 300 + 40 + 1 and max(rows) <= 80


def diamonds(layers):
    return [(f"{k}{a}", f"{k + 1}{b}") for k in range(layers) for a in "lr" for b in "lr"]


def test_forty_diamond_layers(spark):
    bases = spark.createDataFrame(diamonds(40), "name string, base string")
    fields = spark.createDataFrame([(f"{k}{a}", f"x{k}") for k in range(41) for a in "lr"], "name string, field string")
    assert {r["name"]: len(r["fields"]) for r in traverse.inherited_fields(fields, bases).collect()} == {f"{k}{a}": 41 - k for k in range(41) for a in "lr"}


def test_forty_diamond_includes(spark):
    """Includes of one prefix: as many rows as different (module, prefix), though two to the fortieth ways lead there."""
    rows = [(a, "p/" if k % 20 == 0 else "", b, None) for k, (a, b) in enumerate(diamonds(40))] + [("40l", "end", None, "view")]
    e = spark.createDataFrame(rows, "module string, pattern string, include string, leaf string")
    got = [r["path"] for r in traverse.nested_routes(e, spark.createDataFrame([("0l",), ("0r",)], "module string")).collect()]
    assert len(got) == len(set(got)) and set(got) <= {"p/" * k + "end" for k in range(41)} and "end" in got


def brute_routes(entries, roots, joint=""):
    out = set()

    def walk(module, prefix, path):
        for m, pattern, include, leaf in entries:
            if m == module and include is None:
                out.add((prefix + pattern, m, leaf))
            elif m == module and include not in path:
                walk(include, prefix + pattern + joint, [*path, include])

    for r in roots:
        walk(r, "", [r])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_routes_in_circles(spark, seed):
    rng = random.Random(seed)
    names = "abcdef"[: rng.choice([3, 6])]
    entries = [(rng.choice(names), rng.choice(["", "x/", "y/"]), rng.choice(names), None) for _ in range(rng.choice([4, 9]))] + [(n, "z", None, f"v{n}") for n in names[::2]]
    roots = list(names[:2])
    got = traverse.nested_routes(spark.createDataFrame(entries, "module string, pattern string, include string, leaf string"), spark.createDataFrame([(r,) for r in roots], "module string"), ".")
    assert {tuple(r) for r in got.collect()} == brute_routes(entries, roots, ".")


def test_closure(spark):
    rng = random.Random(7)
    links = [(rng.randrange(12), rng.randrange(12)) for _ in range(14)] + [(100 + k, 101 + k) for k in range(70)]
    reach = set(links)
    while longer := {(a, d) for a, b in reach for c, d in links if b == c} - reach:
        reach |= longer
    got = [tuple(r) for r in traverse.closure(spark.createDataFrame(links, "a long, b long")).collect()]
    assert len(got) == len(set(got)) and set(got) == reach
    assert traverse.closure(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ten_thousand_templates(spark):
    """Paths meet templates by equality; the same by regular expressions on the driver."""
    rng = random.Random(3)
    words = ["u", "v", "items", "x.y", "a+b", "(z)"]
    templates = sorted({"/" + "/".join(rng.choice([*words, ":p", "{id}", f"w{rng.randrange(60)}", f"x{rng.randrange(400)}", f"x{rng.randrange(400)}"]) for _ in range(rng.choice([2, 3, 4]))) for _ in range(14_000)})[:10_000]
    paths = sorted({"/" + "/".join(rng.choice([*words, "7", f"w{rng.randrange(60)}", "", "xzy"]) for _ in range(rng.choice([2, 3, 4]))) for _ in range(150)})
    eps = spark.createDataFrame([(f"e{k}", "GET" if k % 2 else "POST", t) for k, t in enumerate(templates)], "id string, method string, raw_path string")
    obs = spark.createDataFrame([(k, "GET", None, p + ("?q=1" if k % 3 == 0 else ""), 1.0, 200, "") for k, p in enumerate(paths)], "ord long, method string, route string, path string, dur_ms double, status int, trace_id string")
    seen = runtime.observed(eps, obs)
    assert "rlike" not in seen._jdf.queryExecution().optimizedPlan().toString().lower()
    got = sorted((r["endpoint"], r["ord"]) for r in seen.collect())
    shapes = [(f"e{k}", re.compile("/".join("[^/]+" if s in (":p", "{id}") else re.escape(s) for s in t.split("/")))) for k, t in enumerate(templates) if k % 2]
    bare = [p.rstrip("/") or "/" for p in paths]
    assert len(templates) > 9000 and got == sorted((e, k) for k, p in enumerate(bare) for e, rx in shapes if rx.fullmatch(p)) and len(got) > 100
