"""Queries over further idioms of source trees, over graphs, and over spans as a stream; and the same in DuckDB's SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.operators import graph, score, views
from meshlens.plans import scan
from meshlens.plans.bindings import FLAG_SQL, HOURS, NOW_MS, OBS_SQL, _payloads, canon_sql, flags, graph_nodes, observations
from meshlens.plans.registry import query, table
from meshlens.plans.source_bindings import _filled, _files, _routes, facts
from meshlens.plans.staging import own_dir, staged
from meshlens.sources import specs, tree
from meshlens.streaming import spans, state

ALIASES = "Logged@k@ = Annotated[User, Depends(get_current_user)]\nPlain@k@ = Annotated[Page, Depends(paging)]\n"
GUARDED = """from fastapi import APIRouter, Depends
open_ = APIRouter(prefix="/o@k@")
shut = APIRouter(prefix="/h@k@", dependencies=[Depends(get_current_user)])
@open_.get("/a")
def a(u: Logged@k@): pass
@open_.get("/b")
def b(u: Plain@k@): pass
@shut.get("/c")
def c(): pass
@shut.post("/d")
def d(x: Plain@k@): pass
@open_.get("/q/{i}")
def q(i: str):
    cursor.execute(@sql@)
"""
GUARDED_SCRIPT = "const express = require('express');\nconst router = express.Router();\nrouter.use(@guard@);\nrouter.get('/es@k@', h);\n"
TYPED = "export interface Thing@k@ { id: number; name?: string; }\nexport function Typed@k@() {\n  axios.get<Thing@k@>('/t@k@').catch(e => 0);\n  api.getThing@k@();\n  api.unknown@k@();\n}\n"
DOCUMENT = "export function Doc@k@() {\n  const q = gql`query Q { user@k@ { id } all(x: 1) { id } }`;\n}\n"


def _supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of routes behind aliases and routers, and of handlers with SQL of their own."""
    s, k = _supplier(spark, sf_dir), F.col("k").cast("string")
    sql = F.when(F.col("k") % 2 == 0, 'f"select {i}"').otherwise('"select ?", (i,)')
    guard = F.when(F.col("k") % 2 == 0, "requireAuth").otherwise("compress")
    named = lambda a, b: F.concat(F.lit(a), k, F.lit(b))
    python = _files(s, "python", (named("auth", ".py"), _filled(ALIASES, k=k)), (named("r", ".py"), _filled(GUARDED, sql=sql, k=k)))
    return staged(tree.facts(python.unionByName(_files(s, "script", (named("es", ".js"), _filled(GUARDED_SCRIPT, guard=guard, k=k))))), "guarded")


@query("""SELECT 'ep:' || m || ' /' || replace(p, '@', CAST(s_suppkey AS VARCHAR)) AS id, a AS has_auth FROM supplier, (VALUES ('GET', 'o@/a', true), ('GET', 'o@/b', false), ('GET', 'h@/c', true), ('POST', 'h@/d', true), ('GET', 'o@/q/{i}', false)) v(m, p, a)
UNION ALL SELECT 'ep:GET /es' || s_suppkey, s_suppkey % 2 = 0 FROM supplier""")
def scan_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authentication by an annotation's alias in another file, by a router's dependencies, and by a router's middleware."""
    found = _guarded(spark, sf_dir)
    return scan.python_endpoints(found).unionByName(scan.script_endpoints(found)).select("id", "has_auth")


@query("SELECT 'ep:GET /o' || s_suppkey || '/q/{i}' AS owner_id, 'sql_injection_risk' AS code, 'critical' AS severity FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'ep:GET /o' || s_suppkey || '/q/{i}', 'no_error_handling', 'high' FROM supplier")
def scan_raw_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers that put their own parameter into SQL, and don't handle its errors."""
    found = _guarded(spark, sf_dir)
    routes = scan.python_endpoints(found).withColumn("ord", F.struct("rank", "id")).drop("rank")
    none = scan.call_sites(found).limit(0)
    return scan.static_flags(staged(scan.with_contracts(staged(routes, "routes"), found), "contracts"), found, none).select("owner_id", "code", "severity")


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '{"openapi": "3.0.0", "paths": {"/things/@k@": {"get": {"operationId": "getThing@k@"}}, "/s@k@/items/{item_id}": {"get": {"operationId": "read@k@"}}}}'
    return specs.operations(_supplier(spark, sf_dir).select(_filled(text, k=F.col("k").cast("string")).alias("value")))


@query("""SELECT 'call:web/t' || s_suppkey || '.tsx:' || line AS id, 'GET' AS method, replace(u, '@', CAST(s_suppkey AS VARCHAR)) AS url, e AS expected, 'Typed' || s_suppkey AS component FROM supplier, (VALUES (3, '/t@', 'id'), (4, '/things/@', NULL)) v(line, u, e)""")
def scan_typed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses typed by an interface, and client methods named as operations of the API document; unknown ones are no calls."""
    pages = _files(_supplier(spark, sf_dir), "script", (F.concat(F.lit("web/t"), "k", F.lit(".tsx")), _filled(TYPED, k=F.col("k").cast("string"))))
    found = scan.call_sites(staged(tree.facts(pages), "typed"), _operations(spark, sf_dir))
    return found.select("id", "method", "url", F.array_join("expected_fields", ",").alias("expected"), "component")


@query("SELECT '/graphql#' || f AS url, 'Doc' || s_suppkey AS component, 2 AS line, true AS handled FROM supplier, (VALUES ('user'), ('all')) v(n), LATERAL (SELECT CASE n WHEN 'user' THEN 'user' || s_suppkey ELSE n END AS f)")
def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root fields of query documents in scripts."""
    pages = _files(_supplier(spark, sf_dir), "script", (F.concat(F.lit("web/d"), "k", F.lit(".tsx")), _filled(DOCUMENT, k=F.col("k").cast("string"))))
    return scan.call_sites(staged(tree.facts(pages), "documents")).select("url", "component", "line", F.col("has_error_handling").alias("handled"))


@query(f"SELECT id, framework FROM ({_routes('python')}) UNION ALL SELECT 'ep:GET /things/' || s_suppkey, 'openapi' FROM supplier")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of an API document go behind the routes that were found, but for those found already."""
    found = scan.python_endpoints(facts(spark, sf_dir, "python"))
    more = specs.openapi_endpoints(_operations(spark, sf_dir), "openapi.json")
    return graph.fill_gaps(found.select("id", "framework"), more.select("id", "framework"))


@query(f"WITH {FLAG_SQL} SELECT id FROM nodes WHERE contains(lower(id), 'o1') ORDER BY id LIMIT 5")
def id_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first few ids that hold what was asked for."""
    return score.suggestions(graph_nodes(spark, sf_dir), "O1")


@query(f"WITH {FLAG_SQL} SELECT CASE WHEN risk_score >= 70 THEN 'critical' WHEN risk_score >= 40 THEN 'high' WHEN risk_score >= 15 THEN 'medium' ELSE 'low' END AS heat, count(*) AS n FROM scores GROUP BY 1")
def node_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.by_heat(score.node_scores(graph_nodes(spark, sf_dir), flags(spark, sf_dir)))


LIVE_SQL = f"""kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ord DESC) AS r FROM obs WHERE ts_ms >= {NOW_MS} - {HOURS} * 3600000) WHERE r <= 5000)"""


@query(f"WITH {OBS_SQL}, {LIVE_SQL}, cl AS (SELECT trace_id, arg_max(method, ord) AS client_method, arg_max({canon_sql('path')}, ord) AS client_path FROM obs WHERE method = 'POST' GROUP BY trace_id) SELECT * FROM cl WHERE trace_id IN (SELECT trace_id FROM kept)")
def live_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last client span of each trace that an observation in the store still names."""
    o = observations(spark, sf_dir)
    return spans.retained(o, o.filter("method = 'POST'"), NOW_MS, HOURS)[2]


def _dropped(spark: SparkSession, sf_dir: str) -> str:
    """The request payloads of the events as files of a folder that a stream reads."""
    folder = f"{own_dir(spark)}/payloads-{uuid.uuid4().hex}"
    _payloads(spark, sf_dir).select("payload").write.text(folder)
    return folder


@query(f"""WITH {OBS_SQL}, s AS (SELECT ord, method, event_type, trace_id, epoch_us(ts) // 1000 AS ms FROM obs JOIN (SELECT event_id AS ord, ts FROM events) USING (ord) WHERE ord % 5 <> 0 AND ord % 11 <> 0 AND ord % 13 <> 0 AND epoch_us(ts) // 1000 >= {NOW_MS} - {HOURS} * 3600000)
SELECT CASE WHEN event_type <> 'error' THEN method || ' /api/users/:p/' || event_type ELSE '' END AS key, least(5000, count(*)) AS kept FROM s GROUP BY 1""")
def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads through the stream into its state, read from there: rows of each key inside the window, the cap at most."""
    checkpoint = f"{own_dir(spark)}/checkpoint-{uuid.uuid4().hex}"
    state.keep_stream(spans.payload_stream(spark, _dropped(spark, sf_dir)), checkpoint, 24 * 3650).awaitTermination()
    servers, _ = state.kept(spark, checkpoint, NOW_MS, HOURS)
    key = F.when(F.col("route").isNotNull(), F.concat("method", F.lit(" "), F.regexp_replace("route", r"\{user_id\}", ":p"))).otherwise("")
    return servers.groupBy(key.alias("key")).agg(F.count("*").alias("kept"))


@query(f"""WITH {OBS_SQL}, sp AS (SELECT ord, method, path, trace_id, epoch_us(ts) // 1000 AS ms FROM obs JOIN (SELECT event_id AS ord, ts FROM events) USING (ord) WHERE ord % 11 <> 0),
s AS (SELECT * FROM sp WHERE ord % 5 <> 0 AND ord % 13 <> 0), c AS (SELECT * FROM sp WHERE ord % 5 = 0 AND ord % 13 <> 0), mark AS (SELECT max(ms) - 3600000 AS w FROM (SELECT ms FROM s UNION ALL SELECT ms FROM c))
SELECT s.trace_id, s.ms AS ts_ms, s.path, max(c.ms) AS client_ms, arg_max({canon_sql('c.path')}, c.ms) AS client_path FROM s CROSS JOIN mark LEFT JOIN c ON c.trace_id = s.trace_id AND abs(c.ms - s.ms) <= 3600000
WHERE s.ms + 3600001 <= w GROUP BY s.ord, s.trace_id, s.ms, s.path""")
def stream_latest_client(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as they leave the stream, each with the latest client span of its trace within the hour; those whose hour isn't over wait."""
    out, checkpoint = (f"{own_dir(spark)}/{kind}-{uuid.uuid4().hex}" for kind in ("sent", "checkpoint"))
    servers, clients = spans.span_streams(spans.payload_stream(spark, _dropped(spark, sf_dir)))
    found = state.latest_client_stream(servers, clients, hours=1, apart=1)
    found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out).select("trace_id", "ts_ms", "path", F.unix_millis("client_ts").alias("client_ms"), "client_path")
