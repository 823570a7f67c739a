"""The engine's operators over the driver's tables, and the same in DuckDB's SQL.

Views of the driver's tables stand in for the engine's inputs: events for spans, pages for call sites, lineitem for
coverage and flags, orders for graphs and snapshots.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions import columns as fx
from meshlens.operators import coverage, diff, graph, history, match, runtime, score, traverse, views
from meshlens.plans.registry import SQL, query, table
from meshlens.plans.shipping import ship
from meshlens.plans.staging import staged
from meshlens.sources import otlp, protobuf

NOW_MS, HOURS = 1706572800000, 240.0

#: id, method, path: every syntax of parameters, one route that nothing reaches, two of one key.
ROUTES = [
    ("ep1", "GET", "/api/users/{user_id}/click"),
    ("ep2", "GET", "/api/users/<int:user_id>/view"),
    ("ep3", "GET", "/api/users/:user_id/error/"),
    ("ep4", "POST", "/api/users/{id}/signup"),
    ("ep5", "POST", "/api/users/{id}/purchase/"),
    ("ep6", "DELETE", "/api/users/{id}"),
    ("ep7", "GET", "/en/{page}"),
    ("ep8", "GET", "/fr/<p>"),
    ("ep9", "POST", "/de/:id/"),
    ("ep10", "GET", "/en/{other}"),
]


# ---------------------------------------------------------------- views


def canon_sql(x: str) -> str:
    out = f"CASE WHEN rtrim(split_part({x}, '?', 1), '/') = '' THEN '/' ELSE rtrim(split_part({x}, '?', 1), '/') END"
    for a, b in ((r"\{[^}/]+\}", ":p"), (r"<[^>/]+>", ":p"), (":param", ":p"), (r":[A-Za-z_]\w*", ":p"), (r"/\d+(/|$)", r"/:p\1"), (r"/\d+(/|$)", r"/:p\1")):
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    return out


def endpoints(spark: SparkSession) -> DataFrame:
    rows = [(k, i, m, p, "api.py", k * 10, f"h{k}", "fastapi", k % 2 == 0, [f"f{j}" for j in range(k)] if k % 3 else None, ["a", "b"] if k % 2 else None, ["a"] if k % 2 else None) for k, (i, m, p) in enumerate(ROUTES, 1)]
    from meshlens.schema import ENDPOINTS

    return spark.createDataFrame(rows, ENDPOINTS)


def _list_sql(values: list[str] | None) -> str:
    return "NULL" if values is None else "[" + ", ".join(f"'{v}'" for v in values) + "]"


EP_SQL = "endpoints(ord, id, method, raw_path, file, line, response_fields, request_fields, request_required) AS (VALUES " + ", ".join(
    f"({k}, '{i}', '{m}', '{p}', 'api.py', {k * 10}, CAST({_list_sql([f'f{j}' for j in range(k)] if k % 3 else None)} AS VARCHAR[]), CAST({_list_sql(['a', 'b'] if k % 2 else None)} AS VARCHAR[]), CAST({_list_sql(['a'] if k % 2 else None)} AS VARCHAR[]))" for k, (i, m, p) in enumerate(ROUTES, 1)
) + f"), eps AS (SELECT *, {canon_sql('raw_path')} AS canon FROM endpoints), firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, canon ORDER BY ord) AS rn FROM eps) WHERE rn = 1)"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).drop("ts")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    path = F.concat(F.lit("/api/users/"), F.col("user_id").cast("string"), F.lit("/"), "event_type")
    return e.select(
        F.col("event_id").alias("ord"), F.unix_millis("ts").alias("ts_ms"), F.when(F.col("event_type").isin("signup", "purchase"), "POST").otherwise("GET").alias("method"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("/api/users/{user_id}/"), "event_type")).alias("route"), path.alias("path"),
        (F.col("value") * 10).alias("dur_ms"), F.when(k % 50 == 0, 500).otherwise(200).alias("status"), F.concat(F.col("user_id").cast("string"), F.lit("-"), F.expr("unix_seconds(ts) div 3600").cast("string")).alias("trace_id"), "ts",
    )


OBS_SQL = """obs AS (SELECT event_id AS ord, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_type IN ('signup', 'purchase') THEN 'POST' ELSE 'GET' END AS method,
  event_type, '/api/users/' || user_id || '/' || event_type AS path, value * 10 AS dur_ms, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 50 = 0 THEN 500 ELSE 200 END AS status,
  user_id || '-' || CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS trace_id FROM events)"""
#: Observations by endpoint: the five event types reach the first five routes, errors by their path only.
SEEN_SQL = EP_SQL + ", " + OBS_SQL + """, seen AS (SELECT e.id AS endpoint, o.* FROM obs o JOIN eps e ON e.method = o.method AND e.canon = '/api/users/:p/' || o.event_type)"""
ROLL_SQL = SEEN_SQL + """, ranked AS (SELECT endpoint, list(dur_ms ORDER BY dur_ms) AS d, count(*) AS n, count(*) FILTER (WHERE status >= 500) AS err, bool_or(event_type <> 'error') AS direct FROM seen GROUP BY endpoint),
rolled AS (SELECT e.id AS endpoint, coalesce(n, 0) AS req_count, round(d[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1], 1) AS p50_ms, round(d[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 1) AS p95_ms,
  round(err / n, 4) AS error_rate, CAST(24.0 AS DOUBLE) AS window_hours, CASE WHEN direct THEN 'certain' WHEN n > 0 THEN 'probable' END AS confidence FROM eps e LEFT JOIN ranked r ON r.endpoint = e.id)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages"), F.col("page_id")
    fields = F.transform(F.sequence(F.lit(0), i % 9), lambda j: F.concat(F.lit("f"), j.cast("string")))
    return p.select(
        i.alias("ord"), F.concat(F.lit("call:"), i.cast("string")).alias("id"), F.when(i % 10 == 0, "POST").otherwise("GET").alias("method"), F.when(i % 17 == 0, match.DYNAMIC).otherwise(fx.strip_origin(F.col("url"))).alias("url"),
        F.when(i % 3 == 0, "probable").otherwise("certain").alias("confidence"), F.concat(F.lit("web"), (i % 7).cast("string"), F.lit(".tsx")).alias("file"), i.cast("int").alias("line"), F.when(i % 4 != 0, fields).alias("expected_fields"),
        F.when(i % 5 != 0, F.when(i % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))).alias("sent_fields"), (i % 3 != 0).alias("sent_complete"),
    )


CALL_SQL = f"""calls AS (SELECT page_id AS ord, 'call:' || page_id AS id, CASE WHEN page_id % 10 = 0 THEN 'POST' ELSE 'GET' END AS method, CASE WHEN page_id % 17 = 0 THEN '<dynamic>' ELSE regexp_replace(url, '^https?://[^/]+', '') END AS url,
  CASE WHEN page_id % 3 = 0 THEN 'probable' ELSE 'certain' END AS confidence, 'web' || (page_id % 7) || '.tsx' AS file, CAST(page_id AS INT) AS line, CASE WHEN page_id % 4 <> 0 THEN list_transform(generate_series(0, page_id % 9), lambda j: 'f' || j) END AS expected_fields,
  CASE WHEN page_id % 5 <> 0 THEN CASE WHEN page_id % 2 = 0 THEN ['b', 'c'] ELSE ['a'] END END AS sent_fields, page_id % 3 <> 0 AS sent_complete FROM pages),
met AS (SELECT c.*, {canon_sql('c.url')} AS pattern FROM calls c WHERE url <> '<dynamic>'),
hit AS (SELECT m.*, f.id AS ep_id, f.file AS ep_file, f.line AS ep_line, f.response_fields, f.request_fields, f.request_required FROM met m JOIN firsts f ON f.method = m.method AND f.canon = m.pattern),
lost AS (SELECT m.* FROM met m WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.method = m.method AND f.canon = m.pattern))"""
MATCH_SQL = f"WITH {EP_SQL}, {CALL_SQL} "


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of orders, one from each of their lines; equal ones merge."""
    li = table(spark, sf_dir, "lineitem")
    sev = F.when(F.col("l_returnflag") == "R", "medium").otherwise("low")
    rows = li.select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("owner_id"), F.lit("node").alias("owner_kind"), ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("ord"), F.concat(F.lit("c"), (F.col("l_partkey") % 5).cast("string")).alias("code"),
        sev.alias("severity"), F.when(F.col("l_linestatus") == "O", "contract").otherwise("quality").alias("category"), F.lit("m").alias("message"), (F.col("l_partkey") % 3).cast("string").alias("evidence"), F.lit("").alias("suggestion"),
    )
    return staged(graph.merge_flags(rows, graph_nodes(spark, sf_dir)), "flags")  # scores and rollups read it more than once


FLAG_SQL = """raw AS (SELECT 'o' || l_orderkey AS owner_id, (l_orderkey * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord, 'c' || (l_partkey % 5) AS code, CASE WHEN l_returnflag = 'R' THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN l_linestatus = 'O' THEN 'contract' ELSE 'quality' END AS category, CAST(l_partkey % 3 AS VARCHAR) AS evidence FROM lineitem),
nodes AS (SELECT o_orderkey AS ord, 'o' || o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'endpoint' ELSE 'api_call' END AS type, 'n' || (o_custkey % 10) AS label, 'src/m' || (o_custkey % 6) || '.py' AS file, CAST(o_orderkey AS INT) AS line FROM orders
  UNION ALL SELECT 1000000000000 + c_custkey, 'c' || c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 'function' ELSE 'db_model' END, c_name, 'lib/m' || c_nationkey || '.py', CAST(c_custkey AS INT) FROM customer),
flags AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY owner_id, code, evidence ORDER BY ord) AS rn FROM raw) WHERE rn = 1 AND owner_id IN (SELECT id FROM nodes)),
points AS (SELECT *, CASE severity WHEN 'medium' THEN 3 ELSE 1 END * CASE category WHEN 'contract' THEN 1.5 ELSE 1.0 END AS p FROM flags),
scores AS (SELECT id, round(least(CAST(coalesce(sum(p), 0) AS DOUBLE) / 20.0 * 100, 100.0), 1) AS risk_score FROM nodes LEFT JOIN points ON owner_id = id GROUP BY id)"""


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    cust = F.col("o_custkey")
    first = o.select(F.col("o_orderkey").cast("long").alias("ord"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.when(F.col("o_orderstatus") == "F", "endpoint").otherwise("api_call").alias("type"), F.concat(F.lit("n"), (cust % 10).cast("string")).alias("label"), F.concat(F.lit("src/m"), (cust % 6).cast("string"), F.lit(".py")).alias("file"), F.col("o_orderkey").cast("int").alias("line"))
    then = c.select((F.lit(1_000_000_000_000) + F.col("c_custkey")).cast("long").alias("ord"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.when(F.col("c_nationkey") % 2 == 0, "function").otherwise("db_model").alias("type"), F.col("c_name").alias("label"), F.concat(F.lit("lib/m"), F.col("c_nationkey").cast("string"), F.lit(".py")).alias("file"), F.col("c_custkey").cast("int").alias("line"))
    return first.unionByName(then)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to their customers, written once a line: the last line counts."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(li, "o_orderkey")
    a, b = F.concat(F.lit("o"), F.col("o_orderkey").cast("string")), F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    rank = F.substring("o_orderpriority", 1, 1)
    kind = F.when(rank.isin("1", "2"), "calls").when(rank == "3", "queries").otherwise("http")
    named = rows.select((F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.concat(a, F.lit("->"), b).alias("id"), a.alias("source"), b.alias("target"), kind.alias("type"), F.when(F.col("l_linenumber") % 2 == 0, "probable").otherwise("certain").alias("confidence"))
    return graph.merge_edges(named)


EDGE_SQL = """edges AS (SELECT 'o' || o_orderkey || '->c' || o_custkey AS id, 'o' || o_orderkey AS source, 'c' || o_custkey AS target, any_value(CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'calls' WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'queries' ELSE 'http' END) AS type,
  arg_max(CASE WHEN l_linenumber % 2 = 0 THEN 'probable' ELSE 'certain' END, l_linenumber) AS confidence FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)"""
SCORE_SQL = f"WITH {FLAG_SQL}, {EDGE_SQL} "


# ---------------------------------------------------------------- matching


@query(f"SELECT page_id, {canon_sql('url')} AS canonical, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages")
def canonicalize_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", fx.canonical_path(F.col("url")).alias("canonical"), fx.strip_origin(F.col("url")).alias("path"))


@query(MATCH_SQL + "SELECT id || '=>' || ep_id AS id, id AS source, ep_id AS target, 'http' AS type, confidence, method, pattern FROM hit")
def match_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.wires(match.matched(calls(spark, sf_dir), endpoints(spark))).drop("ord")


@query(MATCH_SQL + "SELECT id, method, url, pattern FROM lost")
def orphan_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.orphans(calls(spark, sf_dir), endpoints(spark)).select("id", "method", "url", "pattern")


@query(MATCH_SQL + "SELECT id, method, raw_path FROM eps WHERE id NOT IN (SELECT ep_id FROM hit)")
def unused_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = endpoints(spark)
    return match.unused(eps, match.matched(calls(spark, sf_dir), eps)).select("id", "method", "raw_path")


@query(f"WITH routes AS (SELECT page_id AS ord, 'page' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'POST' ELSE 'GET' END AS method, {canon_sql("regexp_replace(url, '^https?://[^/]+', '')")} AS path FROM pages) SELECT method, path, arg_min(id, ord) AS id, min(ord) AS ord FROM routes GROUP BY method, path")
def first_match_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the routes that pages serve, the first of each method and canonical path."""
    p = table(spark, sf_dir, "pages")
    routes = p.select(F.col("page_id").alias("ord"), F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("id"), F.when(F.col("page_id") % 3 == 0, "POST").otherwise("GET").alias("method"), fx.strip_origin(F.col("url")).alias("raw_path"))
    return match.keyed_endpoints(routes).select(F.col("_method").alias("method"), F.col("_path").alias("path"), "ep.id", "ep.ord")


@query(MATCH_SQL + "SELECT m AS matched, o AS orphan_calls, u AS unused_endpoints, m + o >= 20 AND 4 * m < m + o AS discovery_guard FROM (SELECT (SELECT count(*) FROM hit) AS m, (SELECT count(*) FROM lost) AS o, (SELECT count(*) FROM eps WHERE id NOT IN (SELECT ep_id FROM hit)) AS u)")
def discovery_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_stats(calls(spark, sf_dir), endpoints(spark))


@query(MATCH_SQL + "SELECT id, array_to_string(missing, ',') AS missing FROM (SELECT id, list_sort(list_filter(expected_fields, lambda x: NOT list_contains(response_fields, x))) AS missing FROM hit WHERE response_fields IS NOT NULL AND expected_fields IS NOT NULL) WHERE len(missing) > 0")
def contract_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.missing_fields(match.matched(calls(spark, sf_dir), endpoints(spark))).select("id", F.concat_ws(",", "missing").alias("missing"))


@query(MATCH_SQL + "SELECT id, array_to_string(extra, ',') AS extra, array_to_string(lacking, ',') AS lacking FROM (SELECT id, list_sort(list_filter(sent_fields, lambda x: NOT list_contains(request_fields, x))) AS extra, list_sort(list_filter(request_required, lambda x: NOT list_contains(sent_fields, x))) AS lacking FROM hit WHERE request_fields IS NOT NULL AND sent_fields IS NOT NULL AND sent_complete) WHERE len(extra) > 0 OR len(lacking) > 0")
def request_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.request_fields(match.matched(calls(spark, sf_dir), endpoints(spark))).select("id", F.concat_ws(",", "extra").alias("extra"), F.concat_ws(",", "lacking").alias("lacking"))


@query(MATCH_SQL + """, g AS (SELECT m + o >= 20 AND 4 * m < m + o AS guard FROM (SELECT (SELECT count(*) FROM hit) AS m, (SELECT count(*) FROM lost) AS o))
SELECT id AS owner_id, 'unresolvable_url' AS code, 'low' AS severity, file || ':' || line AS evidence FROM calls WHERE url = '<dynamic>'
UNION ALL SELECT id, 'contract_mismatch', 'high', file || ':' || line || ' reads ' || array_to_string(expected_fields, ', ') || '; ' || ep_file || ':' || ep_line || ' declares ' || array_to_string(response_fields, ', ') FROM hit WHERE len(list_filter(expected_fields, lambda x: NOT list_contains(response_fields, x))) > 0
UNION ALL SELECT id, 'request_contract_mismatch', 'high', file || ':' || line || ' sends ' || array_to_string(sent_fields, ', ') || '; ' || ep_file || ':' || ep_line || ' accepts ' || array_to_string(request_fields, ', ') FROM hit WHERE sent_complete AND len(list_filter(sent_fields, lambda x: NOT list_contains(request_fields, x))) > 0
UNION ALL SELECT id, 'missing_request_field', 'high', file || ':' || line || ' sends ' || array_to_string(sent_fields, ', ') || '; required: ' || array_to_string(request_required, ', ') FROM hit WHERE sent_complete AND len(list_filter(request_required, lambda x: NOT list_contains(sent_fields, x))) > 0
UNION ALL SELECT id, 'orphan_call', CASE WHEN guard THEN 'low' ELSE 'high' END, file || ':' || line FROM lost, g
UNION ALL SELECT id, 'unused_endpoint', 'low', file || ':' || line FROM eps WHERE id NOT IN (SELECT ep_id FROM hit)""")
def match_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.match_flags(calls(spark, sf_dir), endpoints(spark)).select("owner_id", "code", "severity", "evidence")


# ---------------------------------------------------------------- runtime


def _seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.observed(endpoints(spark), observations(spark, sf_dir))


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.rollup(endpoints(spark), _seen(spark, sf_dir))


@query(f"WITH {ROLL_SQL} SELECT * FROM rolled")
def runtime_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rolled(spark, sf_dir)


@query("WITH d AS (SELECT l_returnflag AS mode, list(l_extendedprice ORDER BY l_extendedprice) AS v, count(*) AS n FROM lineitem GROUP BY 1) SELECT mode, round(v[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1], 1) AS p50, round(v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1], 1) AS p95 FROM d")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.nearest_ranks(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "mode"), ["mode"], "l_extendedprice", {"p50": 0.5, "p95": 0.95})


@query(f"WITH {SEEN_SQL} SELECT endpoint, count(*) AS n FROM seen WHERE event_type = 'error' GROUP BY endpoint")
def regex_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen(spark, sf_dir).filter("not direct").groupBy("endpoint").agg(F.count("*").alias("n"))


def _wires(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Two call sites on each of the first five routes, one on the sixth; traces have client spans but for views and failures."""
    rows = [(k, f"w{k}", f"call{k}", f"ep{k % 5 + 1}", ROUTES[k % 5][1], ROUTES[k % 5][2].replace("{user_id}", "7").replace("{id}", "9")) for k in range(10)]
    w = spark.createDataFrame(rows, "ord long, id string, source string, target string, method string, url string")
    owners = w.select(F.col("source").alias("call"), F.concat(F.lit("Cmp"), (F.col("ord") % 4).cast("string")).alias("component"), "ord")
    clients = observations(spark, sf_dir).filter("status = 200 and path not like '%/view'").select("ord", "trace_id", "method", "path")
    return w.select("ord", "id", "source", "target"), w.select(F.col("source").alias("id"), "method", "url"), owners, clients


WIRE_SQL = SEEN_SQL + f""", wires AS (SELECT k AS ord, 'w' || k AS id, 'ep' || (k % 5 + 1) AS endpoint, 'Cmp' || (k % 4) AS component, e.method AS cm, e.canon AS cc FROM (SELECT unnest(generate_series(0, 9)) AS k) JOIN eps e ON e.id = 'ep' || (k % 5 + 1)),
cl AS (SELECT trace_id, arg_max(method, ord) AS cm, arg_max({canon_sql('path')}, ord) AS cc FROM obs WHERE status = 200 AND event_type <> 'view' GROUP BY trace_id),
hits AS (SELECT endpoint, cm, cc, count(*) AS h FROM seen JOIN cl USING (trace_id) GROUP BY ALL),
tot AS (SELECT endpoint, count(*) AS t FROM seen GROUP BY endpoint),
traffic AS (SELECT w.ord, w.id, w.endpoint, w.component, CASE WHEN a.endpoint IS NOT NULL THEN round(coalesce(h, 0) / count(*) OVER (PARTITION BY w.endpoint, w.cm, w.cc), 1) END AS req_count, t AS endpoint_req_count, a.endpoint IS NOT NULL AS attributed
  FROM wires w JOIN tot USING (endpoint) LEFT JOIN hits USING (endpoint, cm, cc) LEFT JOIN (SELECT DISTINCT endpoint FROM hits) a ON a.endpoint = w.endpoint)"""


@query(f"WITH {WIRE_SQL} SELECT * FROM traffic")
def wire_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, c, owners, clients = _wires(spark, sf_dir)
    return runtime.attributed(w, c, owners, _seen(spark, sf_dir), clients)


@query(f"WITH {WIRE_SQL} SELECT endpoint, component, req_count AS caller_req_count FROM (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY req_count DESC, ord) AS rn FROM traffic WHERE attributed AND req_count > 0) WHERE rn = 1")
def top_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.top_callers(wire_attribution(spark, sf_dir))


def _static(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("ep5", "node", 1, "missing_auth", "high", "security", "", "", ""), ("ep2", "node", 2, "sql_injection_risk", "critical", "security", "", "", ""), ("ep1", "node", 3, "missing_auth", "high", "security", "", "", ""), ("ep6", "node", 4, "unused_endpoint", "low", "contract", "", "", ""), ("ep1", "node", 5, "unused_endpoint", "low", "contract", "", "", ""), ("ep3", "node", 6, "untested_handler", "high", "quality", "", "", ""), ("ep4", "node", 7, "untested_handler", "high", "quality", "", "", "")]
    from meshlens.schema import FLAGS

    return spark.createDataFrame(rows, FLAGS)


CONFIG = {"runtime": {"p95_ms_threshold": 900, "error_rate_threshold": 0.02}}
HOT_SQL = ROLL_SQL + ", hot AS (SELECT round(c[CAST(round_even(0.9 * (len(c) - 1), 0) AS BIGINT) + 1], 1) AS t FROM (SELECT list(req_count ORDER BY req_count) AS c FROM rolled WHERE req_count > 0))"


def _runtime_flags(spark: SparkSession, sf_dir: str, code: str) -> DataFrame:
    found = runtime.runtime_flags(endpoints(spark), _static(spark, sf_dir), _rolled(spark, sf_dir), None, CONFIG)
    return found.filter(F.col("code") == code).select("owner_id", "code", "severity", "category")


@query(f"WITH {HOT_SQL} SELECT endpoint AS owner_id, 'hot_fragile' AS code, 'critical' AS severity, 'operational' AS category FROM rolled, hot WHERE req_count >= t AND endpoint IN ('ep1', 'ep2', 'ep3', 'ep4', 'ep5')")
def hot_fragile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runtime_flags(spark, sf_dir, "hot_fragile")


@query(f"WITH {ROLL_SQL} SELECT endpoint AS owner_id, 'high_latency' AS code, 'medium' AS severity, 'operational' AS category FROM rolled WHERE p95_ms > 900")
def high_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runtime_flags(spark, sf_dir, "high_latency")


@query(f"WITH {ROLL_SQL} SELECT endpoint AS owner_id, 'high_error_rate' AS code, 'high' AS severity, 'operational' AS category FROM rolled WHERE error_rate > 0.02")
def high_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runtime_flags(spark, sf_dir, "high_error_rate")


@query(f"WITH {ROLL_SQL} SELECT endpoint AS owner_id, 'confirmed_dead' AS code, 'medium' AS severity, 'contract' AS category FROM rolled WHERE req_count = 0 AND endpoint IN ('ep1', 'ep6')")
def confirmed_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runtime_flags(spark, sf_dir, "confirmed_dead")


@query(f"WITH {OBS_SQL} SELECT ord, ts_ms, method, path FROM obs WHERE ts_ms >= {NOW_MS} - {int(HOURS * 3600000)}")
def rolling_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runtime.in_window(observations(spark, sf_dir), NOW_MS, HOURS).select("ord", "ts_ms", "method", "path")


@query(f"WITH {OBS_SQL} SELECT ord, event_type AS key FROM (SELECT ord, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ord DESC) AS r FROM obs) WHERE r <= 5000")
def cap_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = observations(spark, sf_dir).withColumn("key", F.substring_index("path", "/", -1))
    return runtime.last_per_key(keyed, "key").select("ord", "key")


@query(f"WITH {OBS_SQL}, cl AS (SELECT trace_id, arg_max(method, ord) AS m, arg_max({canon_sql('path')}, ord) AS p FROM obs WHERE method = 'POST' GROUP BY trace_id) SELECT o.ord, o.trace_id, m AS client_method, p AS client_path FROM obs o LEFT JOIN cl USING (trace_id)")
def trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = observations(spark, sf_dir)
    index = runtime.client_index(o.filter("method = 'POST'"))
    return o.select("ord", "trace_id").join(index, "trace_id", "left")


# ---------------------------------------------------------------- spans as JSON


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event: old attribute names for even ids, a doubled attribute, no method for one in eleven, a bad time for one in thirteen."""
    o = _observed(spark, sf_dir)
    even = F.col("ord") % 2 == 0
    attr = lambda key, kind, value: F.struct(key.alias("key"), F.struct(*[(value if k == kind else F.lit(None).cast("string")).alias(k) for k in ("stringValue", "intValue")]).alias("value"))
    pick = lambda new, old: F.when(even, old).otherwise(new)
    attributes = F.array(attr(F.when(F.col("ord") % 11 == 0, "other").otherwise(pick("http.request.method", "http.method")), "stringValue", F.lower("method")), attr(F.lit("http.route"), "stringValue", F.lit("/old")), attr(F.lit("http.route"), "stringValue", F.col("route")), attr(pick("url.path", "http.target"), "stringValue", F.col("path")), attr(pick("http.response.status_code", "http.status_code"), "intValue", F.col("status").cast("string")))
    start = F.unix_micros("ts") * 1000
    span = F.struct(F.when(F.col("ord") % 5 == 0, F.lit("3")).otherwise(F.lit("SPAN_KIND_SERVER")).alias("kind"), F.when(F.col("ord") % 13 == 0, "late").otherwise(start.cast("string")).alias("startTimeUnixNano"), (start + F.round(F.col("dur_ms") * 1000) * 1000).cast("long").cast("string").alias("endTimeUnixNano"), F.col("trace_id").alias("traceId"), attributes.alias("attributes"))
    return o.select("ord", F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))).alias("payload"))


OTLP_SQL = f"WITH {OBS_SQL} SELECT ord, upper(method) AS method, CASE WHEN event_type <> 'error' THEN '/api/users/{{user_id}}/' || event_type END AS route, path, CAST(status AS INT) AS status, epoch_us(ts) // 1000 AS ts_ms, round(round(dur_ms * 1000) / 1000, 1) AS dur_ms, trace_id FROM obs JOIN (SELECT event_id AS ord, ts FROM events) USING (ord) WHERE ord % 5 <> 0 AND ord % 11 <> 0 AND ord % 13 <> 0"


@query(OTLP_SQL)
def otlp_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.server_spans(otlp.spans(_payloads(spark, sf_dir)))


@query(OTLP_SQL.replace("trace_id FROM obs", "lower(hex(encode(trace_id))) AS trace_id FROM obs"))
def otlp_protobuf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same requests written as protobuf; trace ids are bytes there."""
    payloads = _payloads(spark, sf_dir)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([protobuf.write(_hexed(json.loads(t))) for t in b.column(1).to_pylist()], pa.binary())], names=["ord", "payload"])

    ship(spark)
    found = protobuf.spans(payloads.mapInArrow(coded, "ord long, payload binary"), F.col("payload"))
    return otlp.server_spans(found)


def _hexed(request: dict) -> dict:
    """Trace ids as the hexadecimal that the encoding asks for."""
    for resource in request["resourceSpans"]:
        for scope in resource["scopeSpans"]:
            for span in scope["spans"]:
                span["traceId"] = span["traceId"].encode().hex()
    return request


@query(f"WITH {OBS_SQL} SELECT ord, trace_id, upper(method) AS method, path FROM obs WHERE ord % 5 = 0 AND ord % 11 <> 0")
def otlp_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.client_spans(otlp.spans(_payloads(spark, sf_dir)))


@query(f"WITH {OBS_SQL} SELECT ord, CASE WHEN event_type <> 'error' THEN '/api/users/{{user_id}}/' || event_type END AS route FROM obs")
def otlp_attr_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.spans(_payloads(spark, sf_dir)).select("ord", otlp.attribute(F.col("attributes"), "http.route").alias("route"))


# ---------------------------------------------------------------- scores


@query(SCORE_SQL + ", f AS (SELECT target AS id, count(*) AS n FROM edges WHERE type IN ('calls', 'queries') GROUP BY target) SELECT id AS owner_id, 'hub_function' AS code, file || ':' || line || ' `' || label || '` fan-in ' || n AS evidence FROM f JOIN nodes USING (id) WHERE n >= 3 AND type = 'function'")
def hub_fanin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.hub_flags(graph_nodes(spark, sf_dir), edges(spark, sf_dir)).select("owner_id", "code", "evidence")


@query(f"WITH {FLAG_SQL} SELECT * FROM scores")
def node_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.node_scores(graph_nodes(spark, sf_dir), flags(spark, sf_dir))


@query(SCORE_SQL + "SELECT e.id, round(greatest(coalesce(a.risk_score, 0), coalesce(b.risk_score, 0)) * 0.8, 1) AS risk_score FROM edges e LEFT JOIN scores a ON a.id = source LEFT JOIN scores b ON b.id = target")
def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flags(spark, sf_dir)
    return score.edge_scores(edges(spark, sf_dir), f, score.node_scores(graph_nodes(spark, sf_dir), f))


@query(f"WITH {FLAG_SQL} SELECT (SELECT count(*) FROM flags) AS total_flags, CAST(0 AS BIGINT) AS critical_flags, (SELECT max(risk_score) FROM scores) AS max_risk_score")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = flags(spark, sf_dir)
    return score.score_stats(f, score.node_scores(graph_nodes(spark, sf_dir), f))


@query(f"WITH {FLAG_SQL} SELECT code, severity, category, CAST(p AS DOUBLE) AS points FROM points WHERE owner_id = (SELECT 'o' || min(o_orderkey) FROM orders)")
def explain_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return score.explained(flags(spark, sf_dir), f"o{first}")


@query(f"WITH {FLAG_SQL} SELECT code, count(*) AS n FROM flags GROUP BY code")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.code_counts(flags(spark, sf_dir))


# ---------------------------------------------------------------- diff and history


def _side(spark: SparkSession, sf_dir: str, which: str) -> dict[str, DataFrame]:
    """Orders as nodes: those before a date in the old graph, those after another in the new one; customers as wires."""
    o = table(spark, sf_dir, "orders")
    part = o.filter(F.col("o_orderdate") < F.lit("1997-01-01")) if which == "old" else o.filter(F.col("o_orderdate") >= F.lit("1994-01-01"))
    risk = (F.col("o_orderkey") % 7).cast("double") if which == "old" else (F.col("o_orderkey") % (5 + 2 * (F.col("o_custkey") % 2))).cast("double")
    nodes = part.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.lit("endpoint").alias("type"), risk.alias("risk_score"))
    wires = part.groupBy("o_custkey").agg(F.count("*").alias("n")).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"), F.lit("http").alias("type"), (F.col("n") % 3).cast("double").alias("risk_score"), F.when(F.col("n") % 2 == 0, "certain").otherwise("probable").alias("confidence"))
    sev = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("3"), "medium").otherwise("low")
    code = F.concat(F.lit("k"), F.substring("o_orderpriority", 1, 1))
    code = F.when(F.col("o_custkey") % 11 == 0, F.concat(F.lit("gone"), code)).otherwise(code) if which == "old" else code
    marks = part.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("owner_id"), F.lit("node").alias("owner_kind"), F.col("o_orderkey").alias("ord"), code.alias("code"), sev.alias("severity"), F.lit("quality").alias("category"), F.col("o_orderstatus").alias("message"))
    return {"nodes": nodes, "edges": wires, "flags": marks}


_NEW, _OLD = "o_orderdate >= DATE '1994-01-01'", "o_orderdate < DATE '1997-01-01'"
_RISK_NEW = "CAST(o_orderkey % (5 + 2 * (o_custkey % 2)) AS DOUBLE)"
DIFF_SQL = f"""oldn AS (SELECT *, CAST(o_orderkey % 7 AS DOUBLE) AS risk FROM orders WHERE {_OLD}), newn AS (SELECT *, {_RISK_NEW} AS risk FROM orders WHERE {_NEW}),
oldw AS (SELECT 'c' || o_custkey AS id, CAST(count(*) % 3 AS DOUBLE) AS risk, CASE WHEN count(*) % 2 = 0 THEN 'certain' ELSE 'probable' END AS conf FROM oldn GROUP BY o_custkey),
neww AS (SELECT 'c' || o_custkey AS id, CAST(count(*) % 3 AS DOUBLE) AS risk, CASE WHEN count(*) % 2 = 0 THEN 'certain' ELSE 'probable' END AS conf FROM newn GROUP BY o_custkey),
oldf AS (SELECT 'c' || o_custkey AS owner, CASE WHEN o_custkey % 11 = 0 THEN 'gonek' || substr(o_orderpriority, 1, 1) ELSE 'k' || substr(o_orderpriority, 1, 1) END AS code, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity, 'quality' AS category, arg_min(o_orderstatus, o_orderkey) AS message FROM oldn GROUP BY ALL),
newf AS (SELECT 'c' || o_custkey AS owner, 'k' || substr(o_orderpriority, 1, 1) AS code, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS severity, 'quality' AS category, arg_min(o_orderstatus, o_orderkey) AS message FROM newn GROUP BY ALL)"""


@query(f"WITH {DIFF_SQL} SELECT 'o' || o_orderkey AS id, 'added' AS status FROM newn WHERE o_orderkey NOT IN (SELECT o_orderkey FROM oldn) UNION ALL SELECT 'o' || o_orderkey, 'removed' FROM oldn WHERE o_orderkey NOT IN (SELECT o_orderkey FROM newn)")
def graph_diff_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.node_diff(_side(spark, sf_dir, "old")["nodes"], _side(spark, sf_dir, "new")["nodes"])


@query(f"WITH {DIFF_SQL} SELECT * FROM (SELECT coalesce(a.id, b.id) AS id, a.risk AS old_risk_score, a.conf AS old_confidence, b.risk AS new_risk_score, b.conf AS new_confidence, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.risk <> b.risk OR a.conf <> b.conf THEN 'changed' END AS status FROM oldw a FULL JOIN neww b ON a.id = b.id) WHERE status IS NOT NULL")
def graph_diff_wires(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.wire_diff(_side(spark, sf_dir, "old")["edges"], _side(spark, sf_dir, "new")["edges"])


@query(f"WITH {DIFF_SQL} SELECT * FROM newf WHERE (owner, code) NOT IN (SELECT (owner, code) FROM oldf)")
def flag_churn_introduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.new_flags(_side(spark, sf_dir, "old")["flags"], _side(spark, sf_dir, "new")["flags"])


@query(f"WITH {DIFF_SQL} SELECT * FROM oldf WHERE (owner, code) NOT IN (SELECT (owner, code) FROM newf)")
def flag_churn_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.gone_flags(_side(spark, sf_dir, "old")["flags"], _side(spark, sf_dir, "new")["flags"])


@query(f"WITH {DIFF_SQL} SELECT coalesce(bool_or(severity IN ('high', 'critical')), false) AS failed FROM newf WHERE (owner, code) NOT IN (SELECT (owner, code) FROM oldf)")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.gate(flag_churn_introduced(spark, sf_dir), "high")


@query(f"WITH {DIFF_SQL} SELECT a AS old_total, b AS new_total, b - a AS delta FROM (SELECT (SELECT sum(risk) FROM oldn) AS a, (SELECT sum(risk) FROM newn) AS b)")
def risk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.risk_totals(_side(spark, sf_dir, "old")["nodes"], _side(spark, sf_dir, "new")["nodes"])


_LINE = "SELECT '  {sign} [' || severity || '] ' || code || '  ' || owner AS line FROM {a} WHERE (owner, code) NOT IN (SELECT (owner, code) FROM {b})"
REPORT_SQL = f"""WITH {DIFF_SQL}, w AS (SELECT count(*) FILTER (WHERE a.id IS NULL) AS added, count(*) FILTER (WHERE b.id IS NULL) AS removed, count(*) FILTER (WHERE a.risk <> b.risk OR a.conf <> b.conf) AS changed FROM oldw a FULL JOIN neww b ON a.id = b.id),
n AS (SELECT count(*) FILTER (WHERE a.o_orderkey IS NULL) AS added, count(*) FILTER (WHERE b.o_orderkey IS NULL) AS removed FROM oldn a FULL JOIN newn b ON a.o_orderkey = b.o_orderkey),
r AS (SELECT (SELECT sum(risk) FROM oldn) AS x, (SELECT sum(risk) FROM newn) AS y),
plus AS ({_LINE.format(sign="+", a="newf", b="oldf")}), minus AS ({_LINE.format(sign="-", a="oldf", b="newf")})
SELECT '  nodes  +' || added || ' / -' || removed AS line FROM n UNION ALL SELECT '  wires  +' || added || ' / -' || removed || ' / ~' || changed FROM w
UNION ALL SELECT '  flags  +' || (SELECT count(*) FROM plus) || ' / -' || (SELECT count(*) FROM minus)
UNION ALL SELECT '  risk  ' || x || ' -> ' || y || ' (' || CASE WHEN y > x THEN '+' ELSE '' END || regexp_replace(CAST(y - x AS VARCHAR), '[.]0$', '') || ')' FROM r UNION ALL SELECT line FROM plus UNION ALL SELECT line FROM minus"""


@query(REPORT_SQL)
def diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.text_lines(_side(spark, sf_dir, "old"), _side(spark, sf_dir, "new")).select("line")


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot each month; the hash repeats where the number of orders does modulo 3."""
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    codes = o.groupBy("month", F.concat(F.lit("k"), F.substring("o_orderpriority", 1, 1)).alias("code")).agg(F.count("*").alias("n")).groupBy("month").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("by_code"))
    risk = o.groupBy("month").agg(F.sum(F.col("o_orderkey") % 10).cast("double").alias("total_risk"), F.count("*").alias("nodes"))
    ts = F.unix_timestamp(F.concat("month", F.lit("-01")), "yyyy-MM-dd")
    return risk.join(codes, "month").select(ts.cast("double").alias("ts"), fx.iso_second(ts * 1000).alias("iso"), (F.col("nodes") % 3).cast("string").alias("graph_hash"), "total_risk", "nodes", "by_code")


HIST_SQL = """hist AS (SELECT CAST(epoch(date_trunc('month', CAST(o_orderdate AS TIMESTAMP))) AS DOUBLE) AS ts, strftime(date_trunc('month', CAST(o_orderdate AS TIMESTAMP)), '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(count(*) % 3 AS VARCHAR) AS graph_hash, CAST(sum(o_orderkey % 10) AS DOUBLE) AS total_risk, count(*) AS nodes FROM orders GROUP BY 1, 2),
kept AS (SELECT * FROM (SELECT *, lag(graph_hash) OVER (ORDER BY ts) AS b FROM hist) WHERE b IS NULL OR b <> graph_hash)"""


@query(
    SCORE_SQL
    + f""", ids AS (SELECT string_agg(id, chr(30) ORDER BY id) AS s FROM nodes), pairs AS (SELECT string_agg(owner_id || chr(31) || code, chr(30) ORDER BY owner_id || chr(31) || code) AS s, count(*) AS n FROM flags),
codes AS (SELECT string_agg(code || '=' || n, ',' ORDER BY code) AS s FROM (SELECT code, count(*) AS n FROM flags GROUP BY code))
SELECT CAST({NOW_MS / 1000} AS DOUBLE) AS ts, strftime(make_timestamp({NOW_MS} * 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso, substr(sha256(ids.s || chr(29) || pairs.s), 1, 16) AS graph_hash, (SELECT round(sum(risk_score), 1) FROM scores) AS total_risk, (SELECT count(*) FROM nodes) AS nodes,
(SELECT count(*) FROM edges WHERE type = 'http') AS wires, (SELECT count(*) FROM nodes WHERE type = 'endpoint') AS endpoints, pairs.n AS flags_total, CAST(0 AS BIGINT) AS flags_critical, codes.s AS by_code FROM ids, pairs, codes"""
)
def history_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks, nodes = flags(spark, sf_dir), graph_nodes(spark, sf_dir)
    scored = staged(nodes.select("id", "type").join(score.node_scores(nodes, marks), "id"), "scored")  # sums and hash read it
    taken = history.snapshot(scored, edges(spark, sf_dir), marks, NOW_MS)
    return taken.withColumn("by_code", F.array_join(F.transform(F.map_entries("by_code"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@query(f"WITH {HIST_SQL} SELECT ts, graph_hash FROM kept")
def history_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recorded(_history(spark, sf_dir)).select("ts", "graph_hash")


@query(f"WITH {HIST_SQL} SELECT ts, graph_hash FROM kept ORDER BY ts DESC LIMIT 10")
def history_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.recorded(_history(spark, sf_dir), 10).select("ts", "graph_hash")


@query("""WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(o_orderkey % 10) AS r FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 2), c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, 'k' || substr(o_orderpriority, 1, 1) AS code, count(*) AS n FROM orders GROUP BY ALL),
a AS (SELECT code, n FROM c WHERE month = (SELECT max(month) FROM m)), b AS (SELECT code, n FROM c WHERE month = (SELECT min(month) FROM m)),
j AS (SELECT coalesce(a.code, b.code) AS code, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b ON a.code = b.code)
SELECT coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM j WHERE x > y), '') AS introduced, coalesce((SELECT string_agg(code, ',' ORDER BY code) FROM j WHERE x < y), '') AS resolved, CAST((SELECT arg_max(r, month) - arg_min(r, month) FROM m) AS DOUBLE) AS risk_delta""")
def churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.churn(_history(spark, sf_dir)).select(F.concat_ws(",", "introduced").alias("introduced"), F.concat_ws(",", "resolved").alias("resolved"), "risk_delta")


@query(f"WITH {HIST_SQL} SELECT ts, (nodes - min(nodes) OVER ()) / (max(nodes) OVER () - min(nodes) OVER ()) AS y FROM hist")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.sparkline(_history(spark, sf_dir), "nodes")


@query("SELECT substr(sha256(string_agg('s' || s_suppkey, chr(30) ORDER BY 's' || s_suppkey) || chr(29) || string_agg('s' || s_suppkey || chr(31) || 'c' || (s_suppkey % 3), chr(30) ORDER BY 's' || s_suppkey || chr(31) || 'c' || (s_suppkey % 3))), 1, 16) AS graph_hash FROM supplier")
def graph_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("code"))
    return history.digest(s, s.withColumnRenamed("id", "owner_id"))


# ---------------------------------------------------------------- coverage


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports by supplier modulo 40, some under a root of their own; file 7 twice, so that its suffix is ambiguous."""
    li, m = table(spark, sf_dir, "lineitem"), F.col("l_suppkey") % 40
    base = F.concat(F.lit("src/m"), (m % 35).cast("string"), F.lit(".py"))
    file = F.when(m % 3 == 0, F.concat(F.lit("/ci/"), base)).when(m == 37, F.lit("/x/src/m7.py")).when(m == 7, F.lit("/y/src/m7.py")).otherwise(base)
    return li.select(file.alias("file"), (F.col("l_partkey") % 150).cast("int").alias("line"), F.when(F.col("l_orderkey") % 16 != 0, "missing").otherwise("executed").alias("state"))


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    return p.select(F.concat(F.lit("p"), k.cast("string")).alias("id"), F.concat(F.lit("src/m"), (k % 45).cast("string"), F.lit(".py")).alias("file"), (k % 140).cast("int").alias("line"), F.when(k % 10 == 0, (k % 140 + 12).cast("int")).otherwise(F.when(k % 3 == 0, 0).otherwise((k % 140 + 3).cast("int"))).alias("end_line"), F.lit("h").alias("handler"))


COV_SQL = """lines AS (SELECT CASE WHEN m % 3 = 0 THEN '/ci/' || b WHEN m = 37 THEN '/x/src/m7.py' WHEN m = 7 THEN '/y/src/m7.py' ELSE b END AS report, line, max(CASE WHEN state = 'executed' THEN 1 ELSE 0 END) AS ran FROM (SELECT l_suppkey % 40 AS m, 'src/m' || ((l_suppkey % 40) % 35) || '.py' AS b, l_partkey % 150 AS line, CASE WHEN l_orderkey % 16 <> 0 THEN 'missing' ELSE 'executed' END AS state FROM lineitem) GROUP BY 1, 2),
bodies AS (SELECT 'p' || p_partkey AS id, 'src/m' || (p_partkey % 45) || '.py' AS file, p_partkey % 140 AS line, CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 140 + 12 WHEN p_partkey % 3 = 0 THEN 0 ELSE p_partkey % 140 + 3 END AS end_line FROM part),
reports AS (SELECT DISTINCT report FROM lines),
ends AS (SELECT f.file, count(*) AS n, any_value(r.report) AS report FROM (SELECT DISTINCT file FROM bodies) f JOIN reports r ON suffix(r.report, '/' || f.file) GROUP BY f.file),
found AS (SELECT f.file, coalesce(r.report, CASE WHEN e.n = 1 THEN e.report END) AS report FROM (SELECT DISTINCT file FROM bodies) f LEFT JOIN reports r ON r.report = f.file LEFT JOIN ends e ON e.file = f.file),
pct AS (SELECT b.id, round(sum(ran) / count(*) * 100, 1) AS coverage_pct FROM bodies b JOIN found USING (file) JOIN lines l ON l.report = found.report AND l.line > b.line AND l.line <= b.end_line WHERE b.end_line <> 0 GROUP BY b.id)"""


@query(f"WITH {COV_SQL} SELECT * FROM pct")
def coverage_body_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.body_coverage(_bodies(spark, sf_dir), _lines(spark, sf_dir))


@query(f"WITH {COV_SQL} SELECT * FROM found WHERE report IS NOT NULL")
def coverage_suffix_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.report_of(_bodies(spark, sf_dir), _lines(spark, sf_dir))


@query(f"WITH {COV_SQL} SELECT id AS owner_id, CASE WHEN coverage_pct = 0 THEN 'high' ELSE 'medium' END AS severity FROM pct WHERE coverage_pct < 50")
def untested_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bodies(spark, sf_dir)
    return coverage.coverage_flags(b, coverage.body_coverage(b, _lines(spark, sf_dir))).select("owner_id", "severity")


# ---------------------------------------------------------------- walks


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    sink = F.when(k % 50 == 0, F.array(F.when(k % 100 == 0, "a").otherwise("b"))).otherwise(F.array().cast("array<string>"))
    return p.select(F.concat(F.lit("f"), k.cast("string")).alias("fqn"), F.array(F.lit("a"), F.lit("b")).alias("params"), sink.alias("sql_sink_params"), F.array((k % 90).cast("int")).alias("raw_sql_lines"))


def _forwards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    n = p.agg(F.count("*").alias("n"))
    to = lambda a, b: F.concat(F.lit("f"), ((k * a + b) % F.col("n") + 1).cast("string"))
    null = F.lit(None).cast("string")
    one = p.join(n).select(F.concat(F.lit("f"), k.cast("string")).alias("fqn"), F.explode(F.array(F.struct(F.lit(1).alias("ord"), to(7, 3).alias("target"), F.when(k % 3 == 0, F.array(F.lit("a"), null)).otherwise(F.array(F.lit("b"), F.lit("a"))).alias("arg_params")), F.struct(F.lit(2).alias("ord"), to(11, 5).alias("target"), F.array(F.lit("a")).alias("arg_params")))).alias("x"))
    return one.select("fqn", "x.*")


WALK_SQL = """n AS (SELECT count(*) AS n FROM part),
fw AS (SELECT p_partkey AS f, 1 AS ord, (p_partkey * 7 + 3) % n + 1 AS t, CASE WHEN p_partkey % 3 = 0 THEN 'a' ELSE 'b' END AS x0, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'a' END AS x1 FROM part, n UNION ALL SELECT p_partkey, 2, (p_partkey * 11 + 5) % n + 1, 'a', NULL FROM part, n)"""


@query(f"""WITH RECURSIVE {WALK_SQL}, w(root, f, d) AS (SELECT 'ep' || p_partkey, p_partkey, 0 FROM part UNION SELECT root, t, d + 1 FROM w JOIN fw USING (f) WHERE d < 4 AND t <> f)
SELECT DISTINCT CASE WHEN d = 0 THEN root ELSE 'fn:f' || f END AS source, 'fn:f' || t AS target, 'calls' AS type FROM (SELECT root, f, min(d) AS d FROM w GROUP BY root, f) JOIN fw USING (f) WHERE t <> f""")
def reachability_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    handlers = table(spark, sf_dir, "part").select(F.concat(F.lit("ep"), F.col("p_partkey").cast("string")).alias("parent"), F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("fqn"))
    none = handlers.select("fqn", F.lit("").alias("model")).filter("false")
    return traverse.call_walk(handlers, _forwards(spark, sf_dir), none).select("source", "target", "type")


def _through_sql(found: str) -> str:
    return f"SELECT * FROM d UNION ALL SELECT f, arg_min(x, ord), arg_min(w, ord), arg_min(line, ord) FROM (SELECT fw.f, fw.ord, CASE {found}.param WHEN 'a' THEN x0 ELSE x1 END AS x, w, line FROM fw JOIN {found} ON fw.t = {found}.f WHERE fw.t <> fw.f) WHERE x IS NOT NULL AND f NOT IN (SELECT f FROM d) GROUP BY f"


@query(f"WITH {WALK_SQL}, d AS (SELECT p_partkey AS f, CASE WHEN p_partkey % 100 = 0 THEN 'a' ELSE 'b' END AS param, 'f' || p_partkey AS w, CAST(p_partkey % 90 AS INT) AS line FROM part WHERE p_partkey % 50 = 0), t1 AS ({_through_sql('d')}), t2 AS ({_through_sql('t1')}) SELECT 'f' || f AS fqn, param, w AS witness, line FROM t2")
def taint_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.sql_taint(_functions(spark, sf_dir), _forwards(spark, sf_dir))


@query("WITH RECURSIVE up(name, above) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT name, above // 2 FROM up WHERE above // 2 >= 1) SELECT 'm' || name AS name, string_agg(DISTINCT 'x' || (above % 7), ',' ORDER BY 'x' || (above % 7)) AS fields FROM up GROUP BY name")
def model_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    name = lambda x: F.concat(F.lit("m"), x.cast("string"))
    half = F.expr("s_suppkey div 2")
    fields = s.select(name(k).alias("name"), F.concat(F.lit("x"), (k % 7).cast("string")).alias("field"))
    bases = s.filter(k > 1).select(name(k).alias("name"), name(half).alias("base")).unionByName(s.filter(k == 1).select(name(k).alias("name"), F.lit("m3").alias("base")))
    return traverse.inherited_fields(fields, bases).join(fields.select("name").distinct(), "name").select("name", F.concat_ws(",", "fields").alias("fields"))


SQL["model_inheritance"] = "WITH RECURSIVE b(name, base) AS (SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey > 1 UNION ALL SELECT 1, 3), up(name, above) AS (SELECT s_suppkey, s_suppkey FROM supplier UNION SELECT up.name, b.base FROM up JOIN b ON up.above = b.name) SELECT 'm' || name AS name, string_agg(DISTINCT 'x' || (above % 7), ',' ORDER BY 'x' || (above % 7)) AS fields FROM up GROUP BY name"


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey").cast("string")
    kids = s.filter("s_suppkey > 1").select(F.expr("cast(s_suppkey div 2 as string)").alias("module"), F.concat(F.lit("/n"), k).alias("pattern"), k.alias("include"), F.lit(None).cast("string").alias("leaf"))
    leaves = s.select(k.alias("module"), F.lit("/list").alias("pattern"), F.lit(None).cast("string").alias("include"), F.col("s_name").alias("leaf"))
    return kids.unionByName(leaves)


@query("WITH RECURSIVE w(m, prefix) AS (SELECT CAST(s_suppkey AS BIGINT), '' FROM supplier WHERE s_suppkey < 2 UNION ALL SELECT s_suppkey, prefix || '/n' || s_suppkey FROM w JOIN supplier ON s_suppkey // 2 = m WHERE s_suppkey > 1) SELECT prefix || '/list' AS path, CAST(m AS VARCHAR) AS module, s_name AS leaf FROM w JOIN supplier ON s_suppkey = m")
def include_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _nested(spark, sf_dir)
    return traverse.nested_routes(e, traverse.root_modules(e))


# ---------------------------------------------------------------- views and sources


ROWS_SQL = SCORE_SQL + ", sized AS (SELECT *, count(*) OVER (PARTITION BY type) AS n FROM nodes), shown AS (SELECT id, type, CASE WHEN n > 60 THEN type || '|' || file ELSE id END AS r FROM sized)"


@query(ROWS_SQL + ", f AS (SELECT owner_id, count(*) AS c FROM flags GROUP BY 1) SELECT r AS \"row\", type, max(risk_score) AS risk, CAST(sum(coalesce(c, 0)) AS BIGINT) AS flags, count(*) AS members FROM shown JOIN scores USING (id) LEFT JOIN f ON owner_id = id GROUP BY 1, 2")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f = graph_nodes(spark, sf_dir), flags(spark, sf_dir)
    return views.group_rollup(s.join(score.node_scores(s, f), "id"), f)


@query(ROWS_SQL + " SELECT a.r AS a, b.r AS b, max(round(greatest(x.risk_score, y.risk_score) * 0.8, 1)) AS risk, count(*) AS n, CASE WHEN bool_or(confidence = 'probable') THEN 'probable' ELSE 'certain' END AS confidence FROM edges JOIN shown a ON a.id = source JOIN shown b ON b.id = target JOIN scores x ON x.id = source JOIN scores y ON y.id = target GROUP BY 1, 2")
def wire_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, f, e = graph_nodes(spark, sf_dir), flags(spark, sf_dir), edges(spark, sf_dir)
    scored = e.join(score.edge_scores(e, f, score.node_scores(s, f)), "id")
    return views.bundles(scored, views.rows_of(s, f))


@query(f"WITH {FLAG_SQL} SELECT code, id FROM (SELECT code, id, row_number() OVER (PARTITION BY code ORDER BY md5('45|' || id), id) AS r FROM (SELECT code, owner_id || '|' || evidence AS id FROM flags)) WHERE r <= 5")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.sample(flags(spark, sf_dir).select("code", F.concat_ws("|", "owner_id", "evidence").alias("id")), "code", "id", 5)


@query("SELECT page_id, sha256(html) AS sha FROM pages WHERE NOT starts_with(url, 'https:')")
def sha_cache_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache holds secure pages as they are, blogs as they were, and no others."""
    from meshlens.sources.cache import stale

    files = table(spark, sf_dir, "pages").select(F.lit("html").alias("section"), F.col("page_id").cast("string").alias("path"), F.col("html").cast("binary").alias("content"), "url")
    cache = files.filter("url like 'https:%'").select("section", "path", fx.content_hash(F.col("content")).alias("sha")).unionByName(files.filter("url like 'http://blog%'").select("section", "path", F.lit("old").alias("sha")))
    return stale(files.drop("url"), cache).select(F.col("path").cast("long").alias("page_id"), "sha")


@query(SCORE_SQL + """SELECT 'node' AS part, type AS name, count(*) AS n FROM nodes GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM edges GROUP BY type
UNION ALL SELECT 'flag', severity, count(*) FROM flags GROUP BY severity UNION ALL SELECT 'code', code, count(*) FROM flags GROUP BY code""")
def scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(graph_nodes(spark, sf_dir), edges(spark, sf_dir), flags(spark, sf_dir))


@query(f"WITH {DIFF_SQL} SELECT to_json({{'severity': severity, 'code': code, 'owner': owner}}) AS line FROM newf WHERE (owner, code) NOT IN (SELECT (owner, code) FROM oldf)")
def diff_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flags that a diff's JSON document says are new, a line each."""
    doc = diff.json_document(_side(spark, sf_dir, "old"), _side(spark, sf_dir, "new"))
    flags_ = doc.select(F.explode(F.from_json(F.get_json_object("document", "$.flags.introduced"), "array<struct<severity:string,code:string,owner:string>>")).alias("f"))
    return flags_.select(F.to_json("f").alias("line"))
