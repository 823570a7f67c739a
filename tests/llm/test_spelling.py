"""Spelling variants against brute force."""

import zlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from meshlens.llm import spelling
from tests.llm.conftest import ODD

SF = "/root/testdata/sf0.001"


def brute_words(rows):
    import re

    found = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


def brute(counts):
    cuts = {}
    for w in counts:
        for i in range(len(w)):
            cuts.setdefault((w[:i] + w[i + 1 :], i), set()).add(w)  # replaced at i
    near = {w: set() for w in counts}
    for same in cuts.values():
        for w in same:
            near[w] |= same - {w}
    for w in counts:
        for i in range(len(w)):
            short = w[:i] + w[i + 1 :]
            if short in counts:
                near[w].add(short)
                near[short].add(w)
    out = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best is not None and counts[best] >= 10 * n else None, n, len(near[w]))
    rows = set()
    for w, (form, n, many) in out.items():
        root = w
        while out[root][0] is not None:
            root = out[root][0]
        rows.add((w, form, root, n, many, counts[form] if form is not None else None))
    return rows


def result(df):
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("largest", [spelling.LARGEST, 8])
def test_all_documents(spark, largest):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute(brute_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert len(want) > 500 and any(r[1] for r in want)
    assert result(spelling.grouped(docs, largest=largest)) == want


def test_chains_accents_and_ties(spark):
    counts = {"abcdefgh": 500, "abcdefg": 50, "abcdefx": 5, "àbcdefgh": 2, "bbcdefgh": 50, "aaaaaaaa": 3, "aaaaaaa": 30, "aaaaaaaaa": 30, "xyzxyzx": 4, "yxzxyzx": 40}
    rows = [(w, n) for w, n in counts.items()]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {r["word"]: (r["n_near"], r["best"], r["best_n"]) for r in spelling.near(df).collect()}
    want = {w: (many, form) for w, form, _, _, many, _ in brute(counts)}
    assert {w: m for w, (m, *_) in got.items()} == {w: m for w, (m, _) in want.items() if m}
    assert got["aaaaaaaa"][1] == "aaaaaaa"  # ties go to the first by letters
    assert got["àbcdefgh"][1] == "abcdefgh"
    assert "xyzxyzx" not in got  # two letters are replaced though the masks are equal
    k = next(k for k in range(99) if all(zlib.crc32(f"{k}:{w}".encode()) % 31 for w in counts))  # an id under which no letter goes
    docs = spark.createDataFrame([(k, " ".join([w] * n)) for w, n in counts.items()], "doc_id long, text string")
    found = result(spelling.grouped(docs))
    assert found == brute(brute_words([(r["doc_id"], r["text"]) for r in docs.collect()]))
    assert any(form and root != form for _, form, root, *_ in found)  # a chain of two forms


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text("abcàéÿ", min_size=7, max_size=9), st.integers(2, 300), min_size=1, max_size=60), st.sampled_from([2, 3, 100]))
def test_near_words(spark, counts, largest):
    got = {(r["word"], r["n_near"]) for r in spelling.near(spark.createDataFrame(list(counts.items()), "word string, n long"), largest).collect()}
    assert got == {(w, many) for w, _, _, _, many, _ in brute(counts) if many}


def test_odd_rows(spark, docs):
    df = docs([*ODD, "w" * 100_000 + " " + "w" * 100_000, "variant1variant variants variants " * 40, None])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert result(spelling.grouped(df)) == brute(brute_words(rows))
    nulls = df.selectExpr("cast(null as bigint) as doc_id", "text", "1 as word", "2 as n")
    assert result(spelling.grouped(nulls)) == brute(brute_words([(None, t) for _, t in rows]))
    assert result(spelling.grouped(df.limit(0))) == set()
    assert spelling.grouped(df.limit(0)).columns == ["word", "form", "root", "n", "n_near", "form_n"]
