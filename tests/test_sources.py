import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from meshlens.plans import scan, viewer
from meshlens.sources import cache, config, otlp, specs, tree
from meshlens.sources.extract import graphql_source, python_source, script_source
from meshlens.streaming import http_receiver, spans

API = """
from fastapi import APIRouter, Depends
from app.models import Out, In
from app import store
router = APIRouter(prefix="/api")
@router.get("/items/{item_id}", response_model=Out)
def read(item_id: int):
    return store.load(item_id)
@router.post("/items")
def make(body: In, user=Depends(get_current_user)):
    pass
@router.get(computed)
def skipped(): pass
"""
MODELS = """
class Root(BaseModel):
    id: int
class Out(Root):
    name: str
class In(BaseModel):
    name: str
    note: Optional[str]
"""
STORE = 'def load(i):\n    return run(i)\ndef run(i):\n    cursor.execute(f"select {i}")\n'
PAGE = "export function Page() {\n  axios.get(`/api/items/${id}`).then(r => r.data.colour);\n  axios.post('/api/items', {extra: 1}, {timeout: 5}).catch(e => 0);\n  fetch('/api/missing');\n}\n"


def test_scan_end_to_end(spark, tmp_path):
    for name, text in (("back/app/api.py", API), ("back/app/models.py", MODELS), ("back/app/store.py", STORE), ("back/venv/x.py", API), ("front/page.tsx", PAGE)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    g = scan.scan(spark, str(tmp_path / "back"), str(tmp_path / "front"))
    marks = {(r["owner_id"], r["code"]) for r in g.flags.collect()}
    get, post = "ep:GET /api/items/{item_id}", "ep:POST /api/items"
    assert (get, "sql_injection_risk") in marks and (post, "missing_auth") not in marks
    assert {("call:page.tsx:2", "contract_mismatch"), ("call:page.tsx:3", "request_contract_mismatch"), ("call:page.tsx:3", "missing_request_field"), ("call:page.tsx:4", "orphan_call")} <= marks
    scores = {r["id"]: r["risk_score"] for r in g.nodes.collect()}
    assert scores[get] == 100.0 and scores["cmp:Page"] == 0.0
    edges = {r["id"]: (r["type"], r["confidence"]) for r in g.edges.collect()}
    assert edges[f"call:page.tsx:2=>{get}"] == ("http", "probable") and f"{get}->fn:app.store.load" in edges


def test_python_facts():
    facts = list(python_source.parse("app/api.py", API))
    assert [f["path"] for k, f in facts if k == "route"] == ["/items/{item_id}", "/items"]
    assert list(python_source.parse("bad.py", "def (")) == []
    urls = list(python_source.parse("shop/urls.py", "urlpatterns = [path('a/<int:x>/', views.one), re_path(r'^b/(?P<y>\\d+)$', V.as_view()), path('c/', include('other.urls'))]"))
    assert [(f["pattern"], f["regex"], f["view"], f["include"], f["by_class"]) for k, f in urls if k == "url"] == [("a/<int:x>/", False, "views.one", None, False), ("^b/(?P<y>\\d+)$", True, "V", None, True), ("c/", False, None, "other.urls", False)]


def test_script_facts():
    s = script_source.Script("async function load() { try { const r = await fetch('/a', {method: 'put'}); const d = await r.json(); use(d.one, d.map()); } catch (e) {} }\nconst q = useQuery(() => axios.get<User>('/b'));\ninterface User { id: number; name?: string }")
    a, b = [f for k, f in script_source.call_sites(s)]
    assert (a["method"], a["url"], a["component"], a["has_error_handling"], a["expected_fields"]) == ("PUT", "/a", "load", True, ["one"])
    assert (b["method"], b["response_type"], b["has_error_handling"]) == ("GET", "User", True)
    assert [f for k, f in script_source.types(s)] == [{"name": "User", "required": ["id"], "optional": ["name"]}]


def test_graphql():
    assert graphql_source.document_fields("query Q($a: ID) { me { id } other: things(x: {y: 1}) @skip(if: true) { z } ...F }") == ("QUERY", ["me", "things"])
    assert graphql_source.document_fields("{ a }") == ("QUERY", ["a"]) and graphql_source.document_fields("nothing") is None
    assert [(f["kind"], f["field"]) for _, f in graphql_source.schema_fields("extend type Mutation {\n  # no: x\n  add(x: Int): T\n  drop: T\n}\ntype Other { no: Int }")] == [("MUTATION", "add"), ("MUTATION", "drop")]


def test_graphql_descriptions_and_strings():
    schema = 'type Query {\n  "See also: docs"\n  user(id: ID = "a: b"): User\n  """\n  more: words { x: y }\n  """\n  all: [User!]! @old(reason: "no: more")\n}\nextend type Subscription @x(y: 1) { tick: Int }\ntype User { id: ID }'
    assert [(f["kind"], f["field"]) for _, f in graphql_source.schema_fields(schema)] == [("QUERY", "user"), ("QUERY", "all"), ("SUBSCRIPTION", "tick")]
    assert graphql_source.document_fields('mutation { a: add(x: "}") { id } ... on Mutation { drop } last }') == ("MUTATION", ["add", "last"])
    assert graphql_source.document_fields("fragment F on Query { x }\nquery { y }") == ("QUERY", ["y"])


def test_python_bodies():
    src = "def f(a, b, c):\n    x = a['k'].v\n    b = 1\n    try:\n        db.execute(f'{x} {b}')\n    finally:\n        g(x, b, 2)\n    if a and b or c:\n        session.query(User).get(1)\n    a.b.run(c)\n"
    (fact,) = [f for k, f in python_source.parse("m.py", src) if k == "function"]
    assert (fact["sql_sink_params"], fact["complexity"], fact["orm_models"], fact["has_try"]) == (["a"], 4, ["User"], True)
    assert fact["calls"] == ["db.execute", "g", "get", "session.query", "run"]
    assert fact["forwards"] == [{"callee": "g", "arg_params": ["a", None, None]}, {"callee": "run", "arg_params": ["c"]}]
    assert [x["name"] for x in fact["loose_io"]] == ["get", "query"]
    views = list(python_source.parse("v.py", "@require_safe\ndef v(request): pass\n@api_view(['get', 'POST'])\ndef w(request): pass\n"))
    assert [f["methods"] for k, f in views if k == "function"] == [["GET"], ["GET", "POST"]]
    found = list(python_source.parse("a/b/__init__.py", "from . import x\nfrom ..c import y as z\nfrom ....d import w\nimport p.q, r.s as t\nfrom u import *"))
    assert [(f["local"], f["fqn"]) for k, f in found if k == "import"] == [("x", "a.b.x"), ("z", "a.c.y"), ("p", "p"), ("t", "r.s")]


def test_express_auth_and_comments():
    text = "const express = require('express');\nconst r = express.Router();\nr.post('/a', verifyRequest, h);\nr.post('/b', loadUser, h);\n"
    assert [(f["path"], f["has_auth"], f["line"]) for k, f in script_source.express(script_source.Script(text)) if k == "express_route"] == [("/a", True, 3), ("/b", False, 4)]
    routes = script_source.Script("// export function GET() {}\n/* export const PUT = 1 */\nexport async function POST(req) {}\nexport const DELETE = h;")
    assert [f["method"] for _, f in script_source.file_routes(routes, "app")] == ["DELETE", "POST"]


def test_files_that_fail_are_told(spark, tmp_path):
    (tmp_path / "deep.py").write_text("x = " + "-" * 100_000 + "1\n")
    (tmp_path / "good.py").write_text("def f(): pass\n")
    found = tree.facts(tree.scan(spark, str(tmp_path), "python")).select("path", "kind").collect()
    assert ("good.py", "function") in [tuple(r) for r in found] and {r["kind"] for r in found if r["path"] == "deep.py"} <= {"failed"}


def span(kind, **attrs):
    return {"kind": kind, "startTimeUnixNano": "1000000000", "endTimeUnixNano": "1012340000", "traceId": "t", "attributes": [{"key": k, "value": {"intValue": str(v)} if isinstance(v, int) else {"stringValue": v}} for k, v in attrs.items()]}


def payload(*spans_):
    return json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": list(spans_)}]}]})


def test_otlp(spark):
    bad = span(2, **{"http.method": "get"}) | {"startTimeUnixNano": "soon"}
    text = payload(span(2, **{"http.request.method": "get", "http.route": "/u/{x}", "http.response.status_code": 503}), span("SPAN_KIND_CLIENT", **{"http.method": "get", "http.url": "https://h/u/7?q=1"}), span(1, **{"http.method": "get"}), bad)
    found = otlp.spans(spark.createDataFrame([(text,), ("not json",)], "payload string"))
    s = otlp.server_spans(found).collect()
    assert [(r["method"], r["route"], r["status"], r["ts_ms"], r["dur_ms"]) for r in s] == [("GET", "/u/{x}", 503, 1000, 12.3)]
    assert [(r["method"], r["path"]) for r in otlp.client_spans(found).collect()] == [("GET", "/u/7")]


def test_stream_to_store(spark, tmp_path):
    status, _ = http_receiver.accept(str(tmp_path / "in"), payload(span(2, **{"http.method": "get", "url.path": "/u/1"})).encode(), "application/json")
    assert status == 200
    assert [http_receiver.accept(str(tmp_path / "in"), b, t)[0] for b, t in ((b"{", "application/json"), (b"[]", "application/json"), (b"", ""), (b"", "text/plain"))] == [400, 400, 415, 415]
    query = spans.store_stream(spans.payload_stream(spark, str(tmp_path / "in")), str(tmp_path / "store"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    servers = spark.read.parquet(str(tmp_path / "store/servers"))
    assert [(r["method"], r["path"]) for r in servers.collect()] == [("GET", "/u/1")]
    cl = spark.createDataFrame([(0, "t", "GET", "/u/1"), (1, "gone", "GET", "/x")], "ord long, trace_id string, method string, path string")
    routed, unrouted, kept = spans.retained(servers, cl, 2000, 1)
    assert routed.count() == 0 and unrouted.count() == 1 and [r["trace_id"] for r in kept.collect()] == ["t"]


def test_stream_join(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.json").write_text(payload(span(2, **{"http.method": "get", "url.path": "/u/1"}), span(3, **{"http.method": "get", "url.path": "/u/9"})) + "\n")
    joined = spans.joined_stream(*spans.span_streams(spans.payload_stream(spark, str(tmp_path / "p"))))
    query = joined.writeStream.format("memory").queryName("joined").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r["path"], r["client_path"]) for r in spark.table("joined").collect()] == [("/u/1", "/u/:p")]


def test_specs(spark, tmp_path):
    doc = {"security": [], "paths": {"/a": {"get": {"operationId": "listA", "security": [{"k": []}]}, "trace": {}}, "/b": {"post": {}}}}
    ops = specs.operations(spark.createDataFrame([(json.dumps(doc),), ("oops",)], "value string"))
    assert {(r["path"], r["method"], r["operation_id"], r["has_auth"]) for r in ops.collect()} == {("/a", "GET", "listA", True), ("/b", "POST", None, False)}
    lines = specs.coverage_lines(spark.createDataFrame([(json.dumps({"files": {"a\\b.py": {"executed_lines": [1], "missing_lines": [2, 3]}}}),)], "value string"))
    assert {(r["file"], r["line"], r["state"]) for r in lines.collect()} == {("a/b.py", 1, "executed"), ("a/b.py", 2, "missing"), ("a/b.py", 3, "missing")}
    with pytest.raises(Exception, match="no files map"):
        specs.coverage_lines(spark.createDataFrame([("{}",)], "value string")).collect()


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("weights: {quality: 9}\nhub_fanin_threshold: 7\n")
    c = config.load_config(str(tmp_path / "c.yaml"))
    assert c["weights"] == {"quality": 9, "contract": 1.5, "operational": 1.0, "security": 2.0} and c["hub_fanin_threshold"] == 7
    assert config.parse_tokens("ann:t1, t2,", "t3") == {"t1": "ann", "t2": "user2", "t3": "default"}


def test_command_line(spark, tmp_path, capsys):
    from meshlens.plans import cli

    for name, text in (("p/backend/app/api.py", API), ("p/backend/app/models.py", MODELS), ("p/backend/app/store.py", STORE), ("p/frontend/page.tsx", PAGE)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    root, out = str(tmp_path / "p"), str(tmp_path / "out")
    assert cli.main(["scan", root, "--out", out]) == 0
    with pytest.raises(SystemExit, match="0"):
        cli.main(["--version"])
    graph = f"{out}/graph.json"
    assert "endpoint" in capsys.readouterr().out and "<title>" in (tmp_path / "out/graph.html").read_text()
    # nothing changed: all facts come from the cache, and the graph is the same
    before = {r["id"]: r["risk_score"] for r in spark.read.json(graph).selectExpr("inline(nodes)").collect()}
    assert cli.main(["scan", root, "--out", out]) == 0
    assert {r["id"]: r["risk_score"] for r in spark.read.json(graph).selectExpr("inline(nodes)").collect()} == before
    assert cli.main(["diff", graph, graph, "--fail-on", "low", "--format", "json"]) == 0 and cli.main(["diff", graph, graph]) == 0 and cli.main(["diff", graph, str(tmp_path / "none")]) == 2
    capsys.readouterr()
    assert cli.main(["explain", graph, "ep:GET /api/items/{item_id}"]) == 0 and "sql_injection_risk" in capsys.readouterr().out
    assert cli.main(["explain", graph, "items"]) == 2 and "/api/items" in capsys.readouterr().out
    assert spark.read.json(f"{out}/history.json").count() == 1


def test_cache_parses_only_what_changed(spark, tmp_path):
    for name, text in (("a.py", "def f(): pass\n"), ("b.py", "# nothing\n"), ("c.py", "def g(): pass\n")):
        (tmp_path / name).write_text(text)
    before = tree.facts(tree.scan(spark, str(tmp_path), "python")).withColumn("fact", F.concat("fact", F.lit(" ")))
    rows = spark.createDataFrame(before.collect(), before.schema)
    (tmp_path / "c.py").write_text("def h(): pass\n")
    (tmp_path / "d.py").write_text("def i(): pass\n")
    (tmp_path / "a.py").rename(tmp_path / "e.py")
    files = tree.scan(spark, str(tmp_path), "python")
    assert {r["path"] for r in cache.stale(files, rows).collect()} == {"c.py", "d.py", "e.py"}
    found = cache.refreshed(rows, files).collect()
    assert {(r["path"], r["fact"].endswith(" ")) for r in found} == {("b.py", True), ("c.py", False), ("d.py", False), ("e.py", False)}


def test_a_scan_writes_the_buckets_that_changed(spark, tmp_path):
    src, kept = tmp_path / "src", tmp_path / "cache"
    src.mkdir()
    for k in range(40):
        (src / f"m{k}.py").write_text(f"def f{k}(): pass\n")
    scan = lambda: cache.updated(str(kept), tree.scan(spark, str(src), "python"))
    stamps = lambda: {p.parent.name: p.name for p in kept.glob("bucket=*/part-*")}
    names = lambda df: sorted(r["fqn"] for r in tree.of_kind(df, "function").select("fqn").collect())
    assert len(names(scan())) == 40
    first = stamps()
    assert len(names(scan())) == 40 and stamps() == first
    (src / "m7.py").write_text("def changed(): pass\n")
    assert "m7.changed" in names(scan()) and "m7.f7" not in names(scan())
    assert sum(first[b] != n for b, n in stamps().items()) == 1
    for p in src.glob("*.py"):
        p.unlink()
    (src / "one.py").write_text("def one(): pass\n")
    assert names(scan()) == ["one.one"]


def test_further_extractors(spark, tmp_path):
    (tmp_path / "x.routes").write_text("GET /a\nPOST /b")

    def lines(path, text):
        for k, row in enumerate(text.split("\n"), 1):
            method, route = row.split(" ")
            yield "route", {"method": method, "path": route, "prefix": "", "handler": "", "line": k, "end_line": k, "framework": "lines", "has_auth": False, "response_model": None, "request_model": None, "annotations": []}

    with pytest.raises(ValueError):
        tree.register("python", "*.x", lines)
    tree.register("lines", "*.routes", lines)
    try:
        g = scan.scan(spark, str(tmp_path), str(tmp_path))
        assert {(r["id"], r["framework"]) for r in g.endpoints.collect()} == {("ep:GET /a", "lines"), ("ep:POST /b", "lines")}
    finally:
        del tree.FURTHER["lines"]


def test_server(spark, tmp_path):
    calls = []
    server = http_receiver.make_server(str(tmp_path / "in"), 0, {"t1": "ann"}, lambda p: (b"<p>", "text/html") if p == "/" else None, lambda: calls.append(1) or {"n": len(calls)})
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def ask(path, body=None, **headers):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, body, headers)) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            return e.code, e.read()

    try:
        assert ask("/") == (200, b"<p>") and ask("/healthz")[0] == 200 and ask("/none")[0] == 404
        assert ask("/rescan", b"")[0] == 401 and ask("/rescan", b"", Authorization="Bearer t1") == (200, b'{"n": 1}')
        assert ask("/v1/traces", payload().encode(), Authorization="Bearer t1", **{"Content-Type": "application/json"})[0] == 200
    finally:
        server.shutdown()
    assert viewer.page('{"a": "</script>"}').count("</script>") == 1
