"""The source readers over source trees that are written from the driver's tables, and the same in DuckDB's SQL.

Each supplier has a service: Python, Express, tRPC, Django and GraphQL files, an API document and a coverage report. Each
customer has a page that calls the service numbered as its nation. What a file holds depends on the key's remainders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.operators import match, views
from meshlens.plans import scan
from meshlens.plans.registry import query, table
from meshlens.plans.staging import staged
from meshlens.sources import cache, specs, tree

API = """from fastapi import APIRouter, Depends
from app.models@k@ import In@k@, Out@k@
router = APIRouter(prefix="/s@k@")
@router.get("/items/{item_id}", response_model=Out@k@)
def read(item_id: int):
    return load(item_id)
@router.post("/items"@dep@)
def make(body: In@k@):
@body@
    return body
def load(i):
    cursor.execute(@sql@)
"""
MODELS = """class Root@k@(BaseModel):
    id: int
class Out@k@(Root@k@):
    name: str
class In@k@(BaseModel):
    name: str
    note: Optional[str]
"""
BRANCHES = "".join(f"    if body == {n}: pass\n" for n in range(11))
EXPRESS_APP = "const express = require('express');\nconst app = express();\nconst r = require('./routes/r@k@');\napp.use('/x@k@', r);\napp.delete('/direct@k@', (req, res) => res.end());\n"
EXPRESS_ROUTER = "const express = require('express');\nconst router = express.Router();\n// router.get('/no', h);\nrouter.get('/one/:id', h);\nrouter.post('/two', @guard@h);\nmodule.exports = router;\n"
NEXT = "// export function PUT() {}\nexport async function GET(req) {}\nexport const POST = h;\n"
TRPC = "const inner@k@ = router({\n  list: publicProcedure.query(() => 1),\n  add: publicProcedure.mutation(() => 2),\n});\nexport const root@k@ = router({\n  deep@k@: inner@k@,\n});\n"
SCHEMA = 'type Query {\n  "See also: docs"\n  all@k@(id: ID = "a: b"): T\n}\n# type Mutation { no: T }\nextend type Mutation { add@k@: T }\n'
URLS = "from django.urls import path, include\nurlpatterns = [path('p@k@/', include('q@k@.urls'))]\n"
INNER_URLS = "from q@k@ import views\nurlpatterns = [path('a/<int:x>/', views.one), re_path(r'^b/(?P<y>\\d+)$', views.Two.as_view())]\n"
VIEWS = "@require_POST\ndef one(request, x): pass\nclass Two(LoginRequiredMixin, View):\n    def get(self, request, y): pass\n"
PAGE = "export function Page@k@() {\n  fetch(`/s@n@/items/${id}`).then(r => r.json()).then(d => show(d.@field@));\n  try { axios.post('/s@n@/items', {@sent@}, {timeout: 5}); } catch (e) {}\n  fetch('/lost@k@');\n  trpc.deep@n@.list.useQuery();\n}\n"


def _filled(text: str, **parts: Column) -> Column:
    out = F.lit(text)
    for name, value in parts.items():
        out = F.replace(out, F.lit(f"@{name}@"), value)
    return out


def _files(df: DataFrame, section: str, *named: tuple[Column, Column]) -> DataFrame:
    """(section, path, content), a row each for the (path, text) pairs of a row of df."""
    each = F.explode(F.array(*[F.struct(path.alias("path"), text.alias("text")) for path, text in named])).alias("f")
    return df.select(each).select(F.lit(section).alias("section"), "f.path", F.col("f.text").cast("binary").alias("content"))


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k").cast("string")
    dep = F.when(F.col("k") % 3 == 0, ", dependencies=[Depends(current_user)]").otherwise("")
    io = F.when(F.col("k") % 4 == 0, "    session.commit()").otherwise("    try:\n        session.commit()\n    finally:\n        pass")
    body = F.concat(F.when(F.col("k") % 5 == 0, BRANCHES).otherwise(""), io)
    sql = F.when(F.col("k") % 2 == 0, 'f"select {i}"').otherwise('"select ?", (i,)')
    api = _filled(API, body=body, dep=dep, sql=sql, k=k)
    at = lambda *parts: F.concat(*[F.lit(p) if p != "@" else k for p in parts])
    return _files(s, "python", (at("app/m", "@", ".py"), api), (at("app/models", "@", ".py"), _filled(MODELS, k=k)), (at("p", "@", "/urls.py"), _filled(URLS, k=k)), (at("q", "@", "/urls.py"), _filled(INNER_URLS, k=k)), (at("q", "@", "/views.py"), _filled(VIEWS, k=k)))


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k").cast("string")
    guard = F.when(F.col("k") % 2 == 0, "verifyRequest, ").otherwise("loadUser, ")
    at = lambda *parts: F.concat(*[F.lit(p) if p != "@" else k for p in parts])
    return _files(s, "script", (at("e", "@", "/app.js"), _filled(EXPRESS_APP, k=k)), (at("e", "@", "/routes/r", "@", ".js"), _filled(EXPRESS_ROUTER, guard=guard, k=k)), (at("app/api/n", "@", "/[id]/route.ts"), F.lit(NEXT)), (at("trpc/t", "@", ".ts"), _filled(TRPC, k=k)))


def schema_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("k"))
    return _files(s, "schema", (F.concat(F.lit("g"), "k", F.lit(".graphql")), _filled(SCHEMA, k=F.col("k"))))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    field = F.when(F.col("c_custkey") % 2 == 0, "name").otherwise("colour")
    sent = F.when(F.col("c_custkey") % 3 == 0, "name: 1").when(F.col("c_custkey") % 3 == 1, "extra: 1").otherwise("name: 1, ...more")
    return _files(c, "script", (F.concat(F.lit("web/c"), k, F.lit(".tsx")), _filled(PAGE, field=field, sent=sent, n=n, k=k)))


def facts(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    files = {"python": python_files, "script": script_files, "schema": schema_files, "pages": page_files}[which]
    return staged(tree.facts(files(spark, sf_dir)), f"facts-{which}")


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoints of all trees in the order of the scan, with the fields of their models."""
    py = facts(spark, sf_dir, "python")
    found = scan.python_endpoints(py).unionByName(scan.script_endpoints(facts(spark, sf_dir, "script"))).unionByName(scan.schema_endpoints(facts(spark, sf_dir, "schema")))
    found = found.withColumn("ord", F.struct("rank", "id")).drop("rank")
    return staged(scan.with_contracts(staged(found, "services"), py), "contracts")


# ---------------------------------------------------------------- endpoints


#: Columns of an endpoint in SQL: id, method, raw_path, framework, has_auth, handler, line.
ROUTE_SQL = {
    "python": """SELECT 'GET' AS method, '/s' || s_suppkey || '/items/{item_id}' AS raw_path, 'fastapi' AS framework, false AS has_auth, 'app.m' || s_suppkey || '.read' AS handler, 5 AS line FROM supplier
UNION ALL SELECT 'POST', '/s' || s_suppkey || '/items', 'fastapi', s_suppkey % 3 = 0, 'app.m' || s_suppkey || '.make', 8 FROM supplier
UNION ALL SELECT 'POST', '/p' || s_suppkey || '/a/<int:x>', 'django', false, 'q' || s_suppkey || '.views.one', 2 FROM supplier
UNION ALL SELECT 'GET', '/p' || s_suppkey || '/b/<y>', 'django', true, 'q' || s_suppkey || '.views.Two.get', 4 FROM supplier""",
    "script": """SELECT 'GET' AS method, '/x' || s_suppkey || '/one/:id' AS raw_path, 'express' AS framework, false AS has_auth, '' AS handler, 4 AS line FROM supplier
UNION ALL SELECT 'POST', '/x' || s_suppkey || '/two', 'express', s_suppkey % 2 = 0, '', 5 FROM supplier UNION ALL SELECT 'DELETE', '/direct' || s_suppkey, 'express', false, '', 5 FROM supplier
UNION ALL SELECT m, '/api/n' || s_suppkey || '/:id', 'nextjs', false, '', 1 FROM supplier, (VALUES ('GET'), ('POST')) v(m)
UNION ALL SELECT 'QUERY', '/trpc#deep' || s_suppkey || '.list', 'trpc', false, '', 2 FROM supplier UNION ALL SELECT 'MUTATION', '/trpc#deep' || s_suppkey || '.add', 'trpc', false, '', 3 FROM supplier""",
    "schema": """SELECT 'QUERY' AS method, '/graphql#all' || s_suppkey AS raw_path, 'graphql' AS framework, false AS has_auth, '' AS handler, 1 AS line FROM supplier
UNION ALL SELECT 'MUTATION', '/graphql#add' || s_suppkey, 'graphql', false, '', 6 FROM supplier""",
}
ROUTE = ["id", "method", "raw_path", "framework", "has_auth", "handler", "line"]


def _routes(which: str) -> str:
    return f"SELECT 'ep:' || method || ' ' || raw_path AS id, * FROM ({ROUTE_SQL[which]})"


@query(_routes("python"))
def scan_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.python_endpoints(facts(spark, sf_dir, "python")).select(*ROUTE)


@query(_routes("script"))
def scan_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.script_endpoints(facts(spark, sf_dir, "script")).select(*ROUTE)


@query(_routes("schema"))
def scan_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.schema_endpoints(facts(spark, sf_dir, "schema")).select(*ROUTE)


@query("SELECT 'ep:GET /s' || s_suppkey || '/items/{item_id}' AS id, 'id,name' AS answered, NULL AS accepted, NULL AS needed FROM supplier UNION ALL SELECT 'ep:POST /s' || s_suppkey || '/items', NULL, 'name,note', 'name' FROM supplier" + f" UNION ALL SELECT id, NULL, NULL, NULL FROM ({_routes('python')} UNION ALL {_routes('script')} UNION ALL {_routes('schema')}) WHERE framework <> 'fastapi'")
def scan_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the models that routes name, inherited ones among them."""
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return services(spark, sf_dir).select("id", joined("response_fields").alias("answered"), joined("request_fields").alias("accepted"), joined("request_required").alias("needed"))


@query("SELECT 'Out' || s_suppkey AS name, 'app/models' || s_suppkey || '.py' AS file, 'Root' || s_suppkey AS bases, 'name' AS fields FROM supplier UNION ALL SELECT 'Root' || s_suppkey, 'app/models' || s_suppkey || '.py', 'BaseModel', 'id' FROM supplier UNION ALL SELECT 'In' || s_suppkey, 'app/models' || s_suppkey || '.py', 'BaseModel', 'name,note' FROM supplier")
def scan_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.of_kind(facts(spark, sf_dir, "python"), "contract").select("name", "file", F.array_join("bases", ",").alias("bases"), F.array_join("fields", ",").alias("fields"))


@query("""SELECT replace(f, '@', CAST(s_suppkey AS VARCHAR)) AS fqn, CAST(1 + CASE WHEN f = 'app.m@.make' AND s_suppkey % 5 = 0 THEN 11 ELSE 0 END AS INT) AS complexity, f = 'app.m@.make' AND s_suppkey % 4 <> 0 AS has_try
FROM supplier, (VALUES ('app.m@.read'), ('app.m@.make'), ('app.m@.load'), ('q@.views.one'), ('q@.views.Two.get')) v(f)""")
def scan_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.of_kind(facts(spark, sf_dir, "python"), "function").select("fqn", "complexity", "has_try")


# ---------------------------------------------------------------- calls, wires and flags


PAGES_SQL = """calls AS (SELECT c_custkey AS k, 'call:web/c' || c_custkey || '.tsx:' || line AS id, method, url, confidence, line, 'Page' || c_custkey AS component, handled, timed, wants, sends FROM (
SELECT *, 2 AS line, 'GET' AS method, '/s' || c_nationkey || '/items/:param' AS url, 'probable' AS confidence, false AS handled, false AS timed, CASE WHEN c_custkey % 2 = 0 THEN 'name' ELSE 'colour' END AS wants, NULL AS sends FROM customer
UNION ALL SELECT *, 3, 'POST', '/s' || c_nationkey || '/items', 'certain', true, true, NULL, CASE c_custkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'extra' END FROM customer
UNION ALL SELECT *, 4, 'GET', '/lost' || c_custkey, 'certain', false, false, NULL, NULL FROM customer
UNION ALL SELECT *, 5, 'QUERY', '/trpc#deep' || c_nationkey || '.list', 'certain', true, true, NULL, NULL FROM customer))"""
HIT_SQL = PAGES_SQL + """, hit AS (SELECT c.*, 'ep:' || c.method || ' ' || CASE c.line WHEN 2 THEN replace(c.url, ':param', '{item_id}') ELSE c.url END AS ep FROM calls c WHERE line <> 4 AND CAST(regexp_extract(url, '(\\d+)', 1) AS BIGINT) IN (SELECT s_suppkey FROM supplier))"""


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(scan.call_sites(facts(spark, sf_dir, "pages")), "calls")


@query(f"WITH {PAGES_SQL} SELECT id, method, url, confidence, line, component, handled, timed FROM calls")
def scan_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_sites(spark, sf_dir).select("id", "method", "url", "confidence", "line", "component", F.col("has_error_handling").alias("handled"), F.col("has_timeout").alias("timed"))


@query(f"WITH {HIT_SQL} SELECT id || '=>' || ep AS id, id AS source, ep AS target, confidence FROM hit")
def scan_wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.wires(match.matched(call_sites(spark, sf_dir), services(spark, sf_dir))).select("id", "source", "target", "confidence")


@query(
    """SELECT 'ep:POST /s' || s_suppkey || '/items' AS owner_id, 'no_error_handling' AS code, 'high' AS severity, 'quality' AS category FROM supplier WHERE s_suppkey % 4 = 0
UNION ALL SELECT 'ep:POST /s' || s_suppkey || '/items', 'high_complexity', 'medium', 'quality' FROM supplier WHERE s_suppkey % 5 = 0
UNION ALL SELECT 'ep:GET /s' || s_suppkey || '/items/{item_id}', 'sql_injection_risk', 'critical', 'security' FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'ep:POST /s' || s_suppkey || '/items', 'missing_auth', 'high', 'security' FROM supplier WHERE s_suppkey % 3 <> 0
UNION ALL SELECT 'ep:POST /p' || s_suppkey || '/a/<int:x>', 'missing_auth', 'high', 'security' FROM supplier
UNION ALL SELECT 'ep:POST /x' || s_suppkey || '/two', 'missing_auth', 'high', 'security' FROM supplier WHERE s_suppkey % 2 <> 0
UNION ALL SELECT 'ep:DELETE /direct' || s_suppkey, 'missing_auth', 'high', 'security' FROM supplier UNION ALL SELECT 'ep:POST /api/n' || s_suppkey || '/:id', 'missing_auth', 'high', 'security' FROM supplier"""
)
def scan_endpoint_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detectors on endpoints: errors, complexity, raw SQL through calls, authentication."""
    none = call_sites(spark, sf_dir).limit(0)
    return scan.static_flags(services(spark, sf_dir), facts(spark, sf_dir, "python"), none).select("owner_id", "code", "severity", "category")


@query(f"WITH {PAGES_SQL} SELECT id AS owner_id, 'no_error_handling' AS code, 'medium' AS severity, 'quality' AS category FROM calls WHERE NOT handled UNION ALL SELECT id, 'no_timeout', 'low', 'operational' FROM calls WHERE NOT timed")
def scan_call_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = services(spark, sf_dir).limit(0)
    return scan.static_flags(none, facts(spark, sf_dir, "python"), call_sites(spark, sf_dir)).select("owner_id", "code", "severity", "category")


@query(f"""WITH {HIT_SQL} SELECT id AS owner_id, 'contract_mismatch' AS code FROM hit WHERE wants = 'colour' UNION ALL SELECT id, 'request_contract_mismatch' FROM hit WHERE sends = 'extra'
UNION ALL SELECT id, 'missing_request_field' FROM hit WHERE sends = 'extra'""")
def scan_contract_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = match.match_flags(call_sites(spark, sf_dir), services(spark, sf_dir))
    return marks.filter(F.col("code").isin("contract_mismatch", "request_contract_mismatch", "missing_request_field")).select("owner_id", "code")


# ---------------------------------------------------------------- documents


@query("SELECT 'ep:' || m || ' /v' || s_suppkey || '/{id}' AS id, m AS method, CASE m WHEN 'GET' THEN 'get' || s_suppkey ELSE '' END AS handler, m = 'PUT' OR s_suppkey % 2 = 0 AS has_auth FROM supplier, (VALUES ('GET'), ('PUT')) v(m)")
def scan_openapi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An API document a supplier; every other one has security for all its operations."""
    k = F.col("s_suppkey").cast("string")
    guard = F.when(F.col("s_suppkey") % 2 == 0, '"security": [{"key": []}], ').otherwise("")
    text = '{"openapi": "3.0.0", @guard@"paths": {"/v@k@/{id}": {"get": {"operationId": "get@k@"}, "put": {"security": [{"key": []}]}, "summary": "none"}}}'
    docs = table(spark, sf_dir, "supplier").select(_filled(text, guard=guard, k=k).alias("value"))
    return specs.openapi_endpoints(specs.operations(docs), "openapi.json").select("id", "method", "handler", "has_auth")


@query("SELECT 'src/f' || s_suppkey || '.py' AS file, n AS line, CASE WHEN n % 2 = 0 THEN 'missing' ELSE 'executed' END AS state FROM supplier, (SELECT CAST(unnest(generate_series(1, 4)) AS INT) AS n)")
def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"meta": {}, "files": {"src\\\\f@k@.py": {"executed_lines": [1, 3], "missing_lines": [2, 4]}}}'
    reports = table(spark, sf_dir, "supplier").select(_filled(text, k=F.col("s_suppkey").cast("string")).alias("value"))
    return specs.coverage_lines(reports).select("file", F.col("line").cast("int").alias("line"), "state")


@query("SELECT count(*) AS components, 4 * count(*) AS calls FROM customer")
def scan_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.component_counts(call_sites(spark, sf_dir))


@query("SELECT 'web/c' || c_custkey || '.tsx' AS path, c_custkey % 4 = 0 AS parsed_anew FROM customer WHERE c_custkey % 7 <> 0")
def scan_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second scan: a seventh of the pages is gone, a fourth has changed; facts of the others come from the cache."""
    files = page_files(spark, sf_dir)
    key = F.regexp_extract("path", r"(\d+)", 1).cast("long")
    before = staged(tree.facts(files), "cache")
    now = files.filter(key % 7 != 0).withColumn("content", F.when(key % 4 == 0, F.concat(F.col("content").cast("string"), F.lit("// more\n")).cast("binary")).otherwise(F.col("content")))
    parsed = cache.refreshed(before, now)
    old = before.select("path", "sha").distinct().withColumn("_old", F.lit(True))
    return parsed.select("path", "sha").distinct().join(old, ["path", "sha"], "left").select("path", F.col("_old").isNull().alias("parsed_anew"))
