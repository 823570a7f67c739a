import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from meshlens.plans import bindings, more_bindings, registry  # noqa: F401

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, db, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.SQL:
        return
    found = db.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    line = lambda row, cols: repr(tuple(row[cols.index(c)] for c in order))
    assert sorted(line(r, df.columns) for r in rows) == sorted(line(r, names) for r in found.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == len(bindings.ROUTES)


def test_only_the_entry_knows_the_llm_package():
    for p in (ROOT / "meshlens").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in named), p
