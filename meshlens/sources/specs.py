"""OpenAPI documents, coverage reports and graph or history files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Methods of a path item that are operations.
OPERATIONS = ("get", "post", "put", "delete", "patch")
OPERATION = "struct<operationId:string,security:array<map<string,array<string>>>>"
ITEM = "struct<" + ",".join(f"{m}:{OPERATION}" for m in OPERATIONS) + ">"
OPENAPI = f"struct<security:array<map<string,array<string>>>,paths:map<string,{ITEM}>>"
COVERAGE = "struct<files:map<string,struct<executed_lines:array<int>,missing_lines:array<int>>>>"
GRAPH = "nodes array<struct<id:string,type:string,label:string,file:string,line:int,risk_score:double,risk_flags:array<struct<code:string,severity:string,category:string,message:string,evidence:string,suggestion:string>>>>, edges array<struct<id:string,source:string,target:string,type:string,confidence:string,risk_score:double,risk_flags:array<struct<code:string,severity:string,category:string,message:string,evidence:string,suggestion:string>>>>"


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def operations(texts: DataFrame, column: str = "value") -> DataFrame:
    """(path, method, operation_id, has_auth) of OpenAPI documents; text that is no such document gives no rows."""
    spec = texts.select(F.from_json(column, OPENAPI).alias("s"))
    items = spec.select(F.coalesce(F.size("s.security"), F.lit(0)).alias("_g"), F.explode("s.paths").alias("path", "item"))
    ops = items.select("_g", "path", F.explode(F.array(*[F.struct(F.lit(m.upper()).alias("method"), F.col(f"item.{m}").alias("op")) for m in OPERATIONS])).alias("x"))
    return ops.filter("x.op is not null").select("path", "x.method", F.col("x.op.operationId").alias("operation_id"), F.coalesce((F.coalesce(F.size("x.op.security"), F.lit(0)) > 0) | (F.col("_g") > 0), F.lit(False)).alias("has_auth"))


def openapi_endpoints(ops: DataFrame, file: str) -> DataFrame:
    return ops.select(F.concat(F.lit("ep:"), "method", F.lit(" "), "path").alias("id"), "method", F.col("path").alias("raw_path"), F.lit(file).alias("file"), F.lit(1).alias("line"), F.coalesce("operation_id", F.lit("")).alias("handler"), F.lit("openapi").alias("framework"), "has_auth")


def coverage_lines(texts: DataFrame, column: str = "value") -> DataFrame:
    """(file, line, state) of coverage.py JSON reports. A text without a files map is an error."""
    parsed = texts.select(F.from_json(column, COVERAGE).alias("c"))
    checked = parsed.select(F.when(F.col("c.files").isNull(), F.raise_error(F.lit("not a coverage.py JSON report: no files map"))).otherwise(F.col("c.files")).alias("files"))
    one = checked.select(F.explode("files").alias("file", "x"))
    lines = lambda c, state: one.select(F.regexp_replace("file", r"\\", "/").alias("file"), F.explode(f"x.{c}").alias("line"), F.lit(state).alias("state"))
    return lines("executed_lines", "executed").unionByName(lines("missing_lines", "missing"))


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes, edges and flags of a graph file."""
    raw = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes, edges = raw.select(F.inline("nodes")), raw.select(F.inline("edges"))
    marks = [df.select(F.col("id").alias("owner_id"), F.lit(kind).alias("owner_kind"), F.posexplode("risk_flags").alias("ord", "f")).select("owner_id", "owner_kind", F.col("ord").cast("long").alias("ord"), "f.*") for df, kind in ((nodes, "node"), (edges, "edge"))]
    return {"nodes": nodes.drop("risk_flags"), "edges": edges.drop("risk_flags"), "flags": marks[0].unionByName(marks[1])}


def write_graph(graph: dict[str, DataFrame], path: str) -> None:
    """nodes, edges and flags as one JSON document in a folder; for graphs that a viewer can show."""
    held = graph["flags"].groupBy(F.col("owner_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ord", "code", "severity", "category", "message", "evidence", "suggestion"))).alias("risk_flags"))
    packed = [graph[k].join(held, "id", "left").withColumn("risk_flags", F.coalesce("risk_flags", F.array())).agg(F.collect_list(F.struct("*")).alias(k)) for k in ("nodes", "edges")]
    packed[0].join(packed[1]).coalesce(1).write.mode("overwrite").json(path)
