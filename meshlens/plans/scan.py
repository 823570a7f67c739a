"""From facts of source trees to a scored graph: extract, match, coverage, runtime, score, in this order."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.functions import columns as fx
from meshlens.operators import coverage, graph, match, runtime, score, traverse
from meshlens.operators.match import at, flag
from meshlens.plans.staging import staged
from meshlens.sources import cache, tree
from meshlens.sources.config import DEFAULTS

ENDPOINT = ["id", "method", "raw_path", "file", "line", "end_line", "handler", "framework", "has_auth", "response_model", "request_model"]
#: Actions of a view set, their method, and what follows the prefix.
ACTIONS = [("list", "GET", ""), ("create", "POST", ""), ("retrieve", "GET", "<pk>/"), ("update", "PUT", "<pk>/"), ("partial_update", "PATCH", "<pk>/"), ("destroy", "DELETE", "<pk>/")]
MOST_COMPLEX = 10


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    flags: DataFrame
    endpoints: DataFrame
    calls: DataFrame
    facts: dict[str, DataFrame]


def _named(df: DataFrame, method: Column, path: Column) -> DataFrame:
    return df.withColumn("raw_path", path).withColumn("id", F.concat(F.lit("ep:"), method, F.lit(" "), "raw_path"))


def _shape(df: DataFrame) -> DataFrame:
    for c, kind in (("end_line", "int"), ("handler", "string"), ("response_model", "string"), ("request_model", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df.select(*ENDPOINT, F.col("rank").cast("struct<step:int,file:string,place:long>").alias("rank"))


def python_endpoints(facts: DataFrame) -> DataFrame:
    """Decorated routes, Django tables and view sets, GraphQL resolvers."""
    routes, fns, imports = (tree.of_kind(facts, k) for k in ("route", "function", "import"))
    aliases = tree.of_kind(facts, "auth_alias").select("name").distinct()
    met = routes.select("file", "_ord", F.explode("annotations").alias("name")).join(aliases, "name", "left_semi").select("file", "_ord").distinct().withColumn("_alias", F.lit(True))
    decorated = _named(routes.join(met, ["file", "_ord"], "left"), F.col("method"), fx.join_path(F.col("prefix"), F.col("path"))).withColumn("has_auth", F.col("has_auth") | F.coalesce("_alias", F.lit(False))).withColumn("rank", F.struct(F.lit(0), "file", "_ord"))
    modules = fns.select("file", "module").unionByName(imports.select("file").distinct().withColumn("module", fx.module_of(F.col("file")))).distinct()
    urls = tree.of_kind(facts, "url").withColumn("module", fx.module_of(F.col("file")))
    sets = tree.of_kind(facts, "viewset").withColumn("module", fx.module_of(F.col("file")))
    url_leaf = F.when(F.col("include").isNull(), F.to_json(F.struct("view", "by_class", F.lit(False).alias("set"))))
    entries = urls.select("module", F.when(F.col("regex"), fx.template_of_regex(F.col("pattern"))).otherwise(F.col("pattern")).alias("pattern"), "include", url_leaf.alias("leaf")).unionByName(sets.select("module", F.concat("prefix", F.lit("/")).alias("pattern"), F.lit(None).cast("string").alias("include"), F.to_json(F.struct("view", F.lit(False).alias("by_class"), F.lit(True).alias("set"))).alias("leaf")))
    spelled = traverse.nested_routes(entries, traverse.root_modules(entries)).withColumn("v", F.from_json("leaf", "view string, by_class boolean, set boolean"))
    head, tail = F.substring_index("v.view", ".", 1), F.regexp_extract("v.view", r"\.(.*)$", 1)
    via = imports.join(modules, "file").select("module", F.col("local").alias("_h"), F.col("fqn").alias("_f"))
    views = spelled.withColumn("_h", head).join(via, ["module", "_h"], "left")
    base = F.coalesce("_f", F.when(F.col("module") == "", F.col("_h")).otherwise(F.concat("module", F.lit("."), "_h")))
    views = views.withColumn("fqn", F.when(tail == "", base).otherwise(F.concat(base, F.lit("."), tail)))
    info = fns.select(F.col("fqn").alias("handler"), "file", "line", "end_line", "auth_hint", "methods")
    verb = F.array(*[F.struct(F.lit(v.upper()).alias("m"), F.lit("").alias("suffix"), F.lit(f".{v}").alias("member")) for v in sorted(fx.HTTP_VERBS)])
    action = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(s).alias("suffix"), F.lit(f".{a}").alias("member")) for a, m, s in ACTIONS])
    members = views.select("path", "fqn", F.explode(F.when(F.col("v.set"), action).when(F.col("v.by_class"), verb).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("m"), F.lit("").alias("suffix"), F.lit("").alias("member"))))).alias("x"))
    found = members.withColumn("handler", F.concat("fqn", "x.member")).join(info, "handler")
    listed = F.when(F.col("x.m").isNotNull(), F.array("x.m")).when(F.size("methods") > 0, F.col("methods")).otherwise(F.array(F.lit("GET")))
    django = found.withColumn("method", F.explode(listed)).withColumns({"has_auth": F.col("auth_hint"), "framework": F.lit("django"), "rank": F.struct(F.lit(1), "file", F.col("line").cast("long"))})
    django = _named(django, F.col("method"), fx.join_path(F.lit("/"), F.concat("path", "x.suffix")))
    solved = tree.of_kind(facts, "resolver").join(fns.select(F.col("fqn").alias("handler"), "end_line", "auth_hint"), "handler")
    solved = solved.select("file", "line", "end_line", "handler", F.col("kind").alias("method"), F.concat(F.lit("/graphql#"), "field").alias("raw_path"), F.col("auth_hint").alias("has_auth"), F.lit("graphql").alias("framework"), F.struct(F.lit(2), "file", "_ord").alias("rank")).withColumn("id", F.concat(F.lit("ep:"), "method", F.lit(" "), "raw_path"))
    return _shape(decorated).unionByName(_shape(django)).unionByName(_shape(solved))


def script_endpoints(facts: DataFrame) -> DataFrame:
    """Express routes under their mounts, file routes, tRPC procedures."""
    routes, mounts, requires, exports = (tree.of_kind(facts, k) for k in ("express_route", "mount", "require", "export"))
    known = facts.select(F.col("path").alias("target_file")).distinct()
    wanted = requires.select("file", F.col("local").alias("target"), F.posexplode(fx.require_candidates(F.col("file"), F.col("spec"))).alias("_k", "target_file")).filter(F.col("target_file") != "")
    resolved = wanted.join(known, "target_file").groupBy("file", "target").agg(F.min_by("target_file", "_k").alias("target_file"))
    exported = exports.groupBy(F.col("file").alias("target_file")).agg(F.max_by("local", "_ord").alias("router2"))
    far = mounts.join(resolved, ["file", "target"]).join(exported, "target_file").select(F.col("target_file").alias("file"), F.col("router2").alias("router"), "prefix", F.struct("file", "_ord").alias("_w"))
    near = mounts.select("file", F.col("target").alias("router"), "prefix", F.struct("file", "_ord").alias("_w"))
    prefix = far.unionByName(near).groupBy("file", "router").agg(F.max_by("prefix", "_w").alias("prefix"))
    express = _named(routes.join(prefix, ["file", "router"], "left"), F.col("method"), fx.join_path(F.coalesce("prefix", F.lit("")), F.col("path"))).withColumns({"framework": F.lit("express"), "handler": F.lit(""), "rank": F.struct(F.lit(3), "file", "_ord")})
    files = tree.of_kind(facts, "file_route").withColumn("_r", fx.next_route(F.col("file"))).filter("_r is not null")
    served = _named(files, F.col("method"), F.col("_r.route")).withColumns({"framework": F.lit("nextjs"), "handler": F.lit(""), "line": F.lit(1), "has_auth": F.lit(False), "rank": F.struct(F.lit(5), "file", "_ord")})
    steps = tree.of_kind(facts, "procedure")
    entries = steps.select(F.col("router").alias("module"), F.when(F.col("verb").isNull(), F.concat("key", F.lit("."))).otherwise(F.col("key")).alias("pattern"), F.when(F.col("verb").isNull(), F.col("nested")).alias("include"), F.when(F.col("verb").isNotNull(), F.to_json(F.struct("verb", "line", "file", "_ord"))).alias("leaf"))
    out_of = steps.filter("exported").select(F.col("router").alias("module")).distinct()
    free = traverse.root_modules(entries)
    roots = free.join(out_of.limit(1).select(F.lit(1).alias("_any")), how="left").filter("_any is null").select("module").unionByName(out_of)
    paths = traverse.nested_routes(entries, roots).withColumn("v", F.from_json("leaf", "verb string, line int, file string, _ord long"))
    trpc = _named(paths.select(F.col("v.verb").alias("method"), "path", F.col("v.line").alias("line"), F.col("v.file").alias("file"), F.lit("trpc").alias("framework"), F.lit("").alias("handler"), F.lit(False).alias("has_auth"), F.struct(F.lit(6), F.col("v.file").alias("file"), F.col("v._ord").alias("_ord")).alias("rank")), F.col("method"), F.concat(F.lit("/trpc#"), "path"))
    return _shape(express).unionByName(_shape(served)).unionByName(_shape(trpc))


def schema_endpoints(facts: DataFrame) -> DataFrame:
    fields = tree.of_kind(facts, "root_field").withColumns({"method": F.col("kind"), "framework": F.lit("graphql"), "handler": F.lit(""), "has_auth": F.lit(False), "rank": F.struct(F.lit(4), "file", "_ord")})
    return _shape(_named(fields, F.col("method"), F.concat(F.lit("/graphql#"), "field")))


def with_contracts(endpoints: DataFrame, facts: DataFrame) -> DataFrame:
    """Endpoints with declared and accepted fields of their models; null where there is no known model. A name's last definition counts."""
    models = tree.of_kind(facts, "contract").groupBy("name").agg(F.max_by(F.struct("bases", "fields", "required"), F.struct("file", "_ord")).alias("m")).select("name", "m.*")
    bases = models.select("name", F.explode("bases").alias("base"))
    above = traverse.closure(bases.select(F.col("name").alias("a"), F.col("base").alias("b")))
    every = lambda c: traverse.fields_above(models.select("name", F.explode(c).alias("field")).unionByName(models.select("name", F.lit(None).cast("string").alias("field"))), above)
    fields, needed = every("fields"), every("required")
    out = endpoints.join(fields.toDF("response_model", "response_fields"), "response_model", "left").join(fields.toDF("request_model", "request_fields"), "request_model", "left")
    return out.join(needed.toDF("request_model", "request_required"), "request_model", "left")


def call_sites(facts: DataFrame, operations: DataFrame | None = None) -> DataFrame:
    """Call sites in the order of files; named client operations through the API document, those unknown to it left out; typed responses by their type."""
    found = tree.of_kind(facts, "call")
    if operations is None:
        found = found.filter("operation_id is null")
    else:
        ops = operations.groupBy("operation_id").agg(F.first(F.struct("method", "path")).alias("_o"))
        found = found.join(ops, "operation_id", "left").filter("operation_id is null or _o is not null").withColumns({"method": F.coalesce("_o.method", "method"), "url": F.coalesce("_o.path", "url")}).drop("_o")
    shapes = tree.of_kind(facts, "type").groupBy(F.col("name").alias("response_type")).agg(F.max_by(F.struct("required", "optional"), F.struct("file", "_ord")).alias("_t"))
    found = found.join(shapes, "response_type", "left").withColumn("expected_fields", F.coalesce("_t.required", "expected_fields")).drop("_t")
    # numbers that grow along the sorted partitions: no single task
    return found.orderBy("file", "_ord").withColumn("ord", F.monotonically_increasing_id()).withColumn("id", F.concat(F.lit("call:"), "file", F.lit(":"), F.col("line").cast("string")))


def static_flags(endpoints: DataFrame, facts: DataFrame, calls: DataFrame) -> DataFrame:
    fns = tree.of_kind(facts, "function").withColumn("handler", F.col("fqn")).drop("file", "line", "end_line", "_ord")
    handled = endpoints.join(fns, "handler")
    ids, here = F.col("id"), lambda line, what: F.concat("file", F.lit(":"), line.cast("string"), F.lit(" "), what)
    loose = handled.filter(~F.col("has_try")).withColumn("x", F.explode("loose_io")).select(*flag(ids, "node", "no_error_handling", "high", "quality", F.lit("I/O in a handler without any try"), here(F.col("x.line"), F.concat(F.lit("`"), "x.name", F.lit("`"))), "Handle the failure"))
    tangled = handled.filter(F.col("complexity") > MOST_COMPLEX).select(*flag(ids, "node", "high_complexity", "medium", "quality", F.concat(F.lit("Complexity "), F.col("complexity").cast("string")), at(), "Split the handler"))
    raw = handled.withColumn("x", F.explode("raw_sql")).select(*flag(ids, "node", "sql_injection_risk", "critical", "security", F.lit("SQL is put together from values"), here(F.col("x.line"), F.col("x.snippet")), "Bind the values as parameters"))
    imports = tree.of_kind(facts, "import").join(tree.of_kind(facts, "function").select("file", "module").distinct(), "file").select("module", "local", "fqn").dropDuplicates(["module", "local"])
    known = tree.of_kind(facts, "function")
    fed = known.select("fqn", F.posexplode("forwards").alias("ord", "x")).select("fqn", "ord", "x.callee", "x.arg_params")
    targets = traverse.resolve_callees(fed, known, imports)
    tainted = traverse.sql_taint(known.select("fqn", "params", "sql_sink_params", F.transform("raw_sql", lambda r: r["line"]).alias("raw_sql_lines")), targets)
    via = endpoints.join(tainted.withColumnRenamed("fqn", "handler").withColumnRenamed("line", "_l"), "handler").filter(F.col("witness") != F.col("handler"))
    far = via.select(*flag(ids, "node", "sql_injection_risk", "critical", "security", F.concat(F.lit("Parameter "), "param", F.lit(" reaches raw SQL in "), "witness"), F.concat(at(), F.lit(" param `"), "param", F.lit("` -> "), "witness", F.lit(":"), F.col("_l").cast("string")), "Bind the value as a parameter"))
    open_ = endpoints.filter(F.col("method").isin(*fx.MUTATING) & ~F.col("has_auth") & F.col("framework").isin("fastapi", "flask", "django", "express", "nextjs")).select(*flag(ids, "node", "missing_auth", "high", "security", F.lit("A mutating route without authentication"), at(), "Require authentication"))
    unhandled = calls.filter(~F.coalesce("has_error_handling", F.lit(False))).select(*flag(ids, "node", "no_error_handling", "medium", "quality", F.lit("A call whose failure is not handled"), F.concat(at(), F.lit(" "), "method", F.lit(" "), "url"), "Handle the failure"))
    endless = calls.filter(~F.coalesce("has_timeout", F.lit(False))).select(*flag(ids, "node", "no_timeout", "low", "operational", F.lit("A call without a time limit"), F.concat(at(), F.lit(" "), "method", F.lit(" "), "url"), "Set a time limit"))
    out = loose
    for more in (tangled, raw, far, open_, unhandled, endless):
        out = out.unionByName(more)
    return out


def scan(spark: SparkSession, backend: str, frontend: str, openapi: tuple[DataFrame, str] | None = None, lines: DataFrame | None = None, observations: tuple[DataFrame, DataFrame] | None = None, config: dict = DEFAULTS, cached: str | None = None) -> Graph:
    """The graph of a backend and a frontend tree. openapi: its operations and file name; lines: coverage; observations: server and client spans in the window; cached: a folder of facts, which unchanged files keep from scan to scan."""

    def read(name: str, root: str, *sections: str) -> DataFrame:
        files = reduce(DataFrame.unionByName, [tree.scan(spark, root, s) for s in sections])
        return cache.updated(f"{cached}/{name}", files) if cached else staged(tree.facts(files), f"facts-{name}")

    facts = {"python": read("python", backend, "python", *tree.FURTHER), "script": read("script", backend, "script"), "schema": read("schema", backend, "schema")}
    if frontend != backend:
        facts["web"] = read("web", frontend, "script")
    py, js, sdl, web = facts["python"], facts["script"], facts["schema"], facts.get("web", facts["script"])
    found = graph.merge_nodes(python_endpoints(py).unionByName(script_endpoints(js)).unionByName(schema_endpoints(sdl)).unionByName(script_endpoints(web)).orderBy("rank").withColumn("ord", F.monotonically_increasing_id()).drop("rank"))
    if openapi is not None:
        from meshlens.sources.specs import openapi_endpoints

        found = graph.fill_gaps(found, openapi_endpoints(*openapi).withColumn("ord", F.lit(1 << 62)))
    endpoints = staged(with_contracts(staged(found, "found"), py), "endpoints")
    calls = staged(call_sites(web, openapi[0] if openapi else None), "calls")
    fns = tree.of_kind(py, "function")
    imports = tree.of_kind(py, "import").join(fns.select("file", "module").distinct(), "file").select("module", "local", "fqn").dropDuplicates(["module", "local"])
    resolved = traverse.resolve_callees(fns.select("fqn", F.posexplode("calls").alias("ord", "callee")), fns, imports)
    models = tree.of_kind(py, "orm_model")
    queries = fns.select("fqn", F.explode("orm_models").alias("model")).join(models.select(F.col("name").alias("model")).distinct(), "model", "left_semi")
    walked = traverse.call_walk(endpoints.filter("handler <> ''").select(F.col("id").alias("parent"), F.col("handler").alias("fqn")), staged(resolved, "resolved"), queries)
    walked = staged(walked, "walked")
    first = lambda df, kind, ident, label, rank: df.select(ident.alias("id"), F.lit(kind).alias("type"), label.alias("label"), "file", "line", F.lit(rank).cast("long").alias("ord"))
    reached = fns.withColumn("_id", F.concat(F.lit("fn:"), "fqn")).join(walked.filter("type = 'calls'").select(F.col("target").alias("_id")).distinct(), "_id", "left_semi")
    owners = calls.select("component", "file", F.col("component_line").alias("line"), "ord")
    nodes = first(models, "db_model", F.concat(F.lit("db:"), "name"), F.col("name"), 0).unionByName(first(endpoints, "endpoint", F.col("id"), F.concat("method", F.lit(" "), "raw_path"), 1)).unionByName(first(reached, "function", F.col("_id"), F.col("qname"), 2)).unionByName(first(owners, "component", F.concat(F.lit("cmp:"), "component"), F.col("component"), 3)).unionByName(first(calls, "api_call", F.col("id"), F.concat("method", F.lit(" "), "url"), 4))
    nodes = graph.merge_nodes(nodes.withColumn("ord", F.struct("ord", "file", "line")))
    nodes = staged(nodes, "nodes")
    calls_once = calls.groupBy("id").agg(F.min_by(F.struct(*[c for c in calls.columns if c != "id"]), "ord").alias("c")).select("id", "c.*")
    calls_once = staged(calls_once, "calls-once")
    made = calls.select("ord", F.concat(F.lit("cmp:"), "component", F.lit("->"), "id").alias("id"), F.concat(F.lit("cmp:"), "component").alias("source"), F.col("id").alias("target"), F.lit("makes_call").alias("type"), F.lit("certain").alias("confidence"))
    wired = match.wires(match.matched(calls_once, endpoints)).drop("method", "pattern")
    walked = walked.withColumns({"ord": F.lit(0).cast("long"), "confidence": F.lit("certain")})
    wired = staged(wired, "wires")
    edges = staged(graph.merge_edges(walked.select(*made.columns).unionByName(made).unionByName(wired.select(*made.columns))), "edges")
    marks = staged(static_flags(endpoints, py, calls_once).unionByName(match.match_flags(calls_once, endpoints)), "static-flags")
    if lines is not None:
        bodies = endpoints.select("id", "file", "line", "end_line", "handler").unionByName(reached.select(F.col("_id").alias("id"), "file", "line", "end_line", F.col("fqn").alias("handler")))
        pct = coverage.body_coverage(bodies, lines)
        marks = marks.unionByName(coverage.coverage_flags(endpoints, pct))
    if observations is not None:
        servers, clients = observations
        seen = runtime.observed(endpoints, servers)
        rolled = runtime.rollup(endpoints, seen)
        owners = calls_once.select(F.col("id").alias("call"), "component", "ord")
        callers = runtime.top_callers(runtime.attributed(wired.select("ord", "id", "source", "target"), calls_once, owners, seen, clients))
        added = runtime.runtime_flags(endpoints, marks, rolled, callers, config)
        marks = runtime.without_replaced(marks, added).unionByName(added)
    marks = marks.unionByName(score.hub_flags(nodes, edges, config))
    flags = graph.merge_flags(marks.withColumn("ord", F.lit(0).cast("long")), nodes.select("id").unionByName(edges.select("id")))
    flags = staged(flags, "flags")
    scores = staged(score.node_scores(nodes, flags, config), "scores")
    return Graph(nodes.join(scores, "id"), edges.join(score.edge_scores(edges, flags, scores, config), "id"), flags, endpoints, calls_once, facts)
