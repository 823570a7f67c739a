"""Modes of the scanner: templates in templates, patterns, elements and their text."""

import time

import pytest

from meshlens.sources.extract import script_source
from meshlens.sources.extract.script_source import Lexer, Script


def calls(source, elements=True):
    return [f for kind, f in script_source.call_sites(Script(source, elements)) if kind == "call"]


def urls(source, elements=True):
    return [(f["method"], f["url"], f["confidence"]) for f in calls(source, elements)]


@pytest.mark.parametrize(
    ("source", "found"),
    [
        ("fetch(`/u/${a ? `x` : 'y'}/z`)", [("GET", "/u/:param/z", "probable")]),
        ("fetch(`/u/${`${a}/${`b`}`}/z`)", [("GET", "/u/:param/z", "probable")]),
        ("fetch(`/u/${f({a: '}'})}/${b}`)", [("GET", "/u/:param/:param", "probable")]),
        ("fetch(`/u/\\`${a}`)", [("GET", "/u/\\`:param", "probable")]),
        ("const r = /[`'\"(]/g; fetch('/a')", [("GET", "/a", "certain")]),
        ("const r = s.replace(/'/g, ''); fetch('/a'); const q = x / 2 / 3; fetch('/b')", [("GET", "/a", "certain"), ("GET", "/b", "certain")]),
        ("return /\\/[/'(]/.test(u) ? fetch('/a') : 0", [("GET", "/a", "certain")]),
        ("function A() { return <p>don't (stop <b>it's</b> {fetch('/a')} 'til {`}`} now</p>; }\nfunction B() { fetch('/b') }", [("GET", "/a", "certain"), ("GET", "/b", "certain")]),
        ("const a = <><A b={() => fetch('/a')} c=\"it's {\" d='x>y'/>:-( {/* ( */}</>; fetch('/b')", [("GET", "/a", "certain"), ("GET", "/b", "certain")]),
        ("const f = <T,>(x: T) => fetch('/a'); const g = <T extends X>(x) => fetch('/b')", [("GET", "/a", "certain"), ("GET", "/b", "certain")]),
        ("if (i < n && m > 1) fetch('/a'); const x = y as Map<string, number>; fetch('/b')", [("GET", "/a", "certain"), ("GET", "/b", "certain")]),
        ("const a = <div>never closed (; fetch('/a')", [("GET", "/a", "certain")]),
        ("// it's (\n/* ` */ fetch('/a') // `", [("GET", "/a", "certain")]),
        ("fetch('/a')\n/* open", [("GET", "/a", "certain")]),
        ("const x = `open ${fetch('/b')", []),
    ],
)
def test_modes(source, found):
    assert urls(source) == found


def test_casts_are_no_elements_without_jsx():
    assert urls("const a = <Foo>bar(); fetch('/a'); const b = <Bar>x;", elements=False) == [("GET", "/a", "certain")]


def test_trpc_chains():
    source = "trpc.user.byId.fetch(); TRPC.user.byId.useQuery(); Api.a.b.mutate(); client.post.add.useMutation(); trpc.x.y.subscription(); trpc.useQuery()"
    assert [(f["method"], f["url"]) for f in calls(source)] == [("QUERY", "/trpc#user.byId"), ("QUERY", "/trpc#user.byId"), ("MUTATION", "/trpc#a.b"), ("MUTATION", "/trpc#post.add")]


def test_owner_and_lines_stay():
    source = "export function Page() {\n  const t = `a\n${b}`;\n  return <p>it's\n {fetch('/x').catch(e => 0)}</p>;\n}\n"
    (call,) = calls(source)
    assert (call["component"], call["line"], call["has_error_handling"]) == ("Page", 5, True)


@pytest.mark.parametrize("source", ["<a>" * 20_000, "x = <a>{" * 3000 + "1", "`" * 50_000, "`${" * 500, "/" * 50_000, "/[" * 20_000, "<a b='" * 20_000, "= <a " * 20_000, "{" * 50_000, "<a>x</a>" * 10_000, "=> <p>{a}</p>; " * 5000])
def test_hostile_sources(source):
    began = time.perf_counter()
    try:
        Lexer(source, True).code(0)
    except RecursionError:
        pass  # facts() gives such a file the fact "failed"
    assert time.perf_counter() - began < 5
