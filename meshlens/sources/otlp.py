"""OTLP trace export requests, in JSON or protobuf, as tables of server and client spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions.columns import round_exact
from meshlens.sources import protobuf

VALUE = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
SPAN = f"struct<kind:string,startTimeUnixNano:string,endTimeUnixNano:string,traceId:string,attributes:array<struct<key:string,value:{VALUE}>>>"
SCOPES = f"array<struct<spans:array<{SPAN}>>>"
PAYLOAD = f"struct<resourceSpans:array<struct<scopeSpans:{SCOPES},instrumentationLibrarySpans:{SCOPES}>>>"
#: Kinds by number and by name, attribute names new and old.
SERVER, CLIENT = ("2", "SPAN_KIND_SERVER"), ("3", "SPAN_KIND_CLIENT")
METHOD = ("http.request.method", "http.method")
STATUS = ("http.response.status_code", "http.status_code")
PATH = ("url.path", "http.target")
URL = ("url.full", "http.url", "url.path", "http.target")


def attribute_text(value: Column) -> Column:
    """A typed value as text: string, integer, double, boolean, the first that is there."""
    return F.coalesce(value["stringValue"], value["intValue"], value["doubleValue"].cast("string"), value["boolValue"].cast("string"))


def attribute(attributes: Column, name: str) -> Column:
    """The text of an attribute(key, value); the last of equal keys wins, and one without value is not there."""
    return attribute_text(F.try_element_at(F.filter(attributes, lambda a: (a["key"] == name) & a["value"].isNotNull()), F.lit(-1))["value"])


def first_of(attributes: Column, names: tuple[str, ...]) -> Column:
    """The first of these attributes that is not empty."""
    return F.coalesce(*[F.nullif(attribute(attributes, n), F.lit("")) for n in names])


def _picked(found: DataFrame, **columns: Column) -> DataFrame:
    """found with these columns worked out once a row: behind a generator, filters and projections don't write them out again."""
    return found.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def spans(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row a span of JSON payloads: kind, times in nanoseconds (null where they are no numbers), trace_id, attributes."""
    keep = [c for c in payloads.columns if c != column]
    parsed = payloads.select(*keep, F.from_json(column, PAYLOAD).alias("_p"))
    scopes = parsed.select(*keep, F.explode("_p.resourceSpans").alias("_r")).select(*keep, F.explode(F.when(F.size("_r.scopeSpans") > 0, F.col("_r.scopeSpans")).otherwise(F.col("_r.instrumentationLibrarySpans"))).alias("_s"))
    one = scopes.select(*keep, F.explode("_s.spans").alias("_x"))
    return one.select(*keep, F.col("_x.kind").alias("kind"), F.expr("try_cast(_x.startTimeUnixNano as bigint)").alias("start_ns"), F.expr("try_cast(_x.endTimeUnixNano as bigint)").alias("end_ns"), F.coalesce("_x.traceId", F.lit("")).alias("trace_id"), F.col("_x.attributes").alias("attributes"))


def mixed_spans(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """One row a span of payloads in either encoding: JSON, or base64 of protobuf, which never begins with a brace."""
    text = F.ltrim(F.col(column))
    coded = protobuf.spans(payloads.filter(~text.startswith("{")), F.expr(f"try_to_binary(`{column}`, 'base64')"), column)
    return spans(payloads.filter(text.startswith("{")), column).unionByName(coded)


def server_spans(found: DataFrame) -> DataFrame:
    """Requests received: spans without method or times go, and so do those whose status is no number."""
    a = F.col("attributes")
    keep = [c for c in found.columns if c not in ("kind", "start_ns", "end_ns", "trace_id", "attributes")]
    rows = _picked(found.filter(F.col("kind").isin(*SERVER)), _m=first_of(a, METHOD), _route=attribute(a, "http.route"), _path=first_of(a, PATH), _st=F.call_function("try_to_number", F.coalesce(first_of(a, STATUS), F.lit("0")), F.lit("999999999")))
    rows = rows.filter("_m is not null and start_ns is not null and end_ns is not null and _st is not null")
    return rows.select(*keep, F.upper("_m").alias("method"), F.col("_route").alias("route"), F.col("_path").alias("path"), F.col("_st").cast("int").alias("status"), F.expr("start_ns div 1000000").alias("ts_ms"), round_exact((F.col("end_ns") - F.col("start_ns")) / 1_000_000, 1).alias("dur_ms"), "trace_id")


def client_spans(found: DataFrame) -> DataFrame:
    """Requests sent: trace_id, method and path, all of them known."""
    a = F.col("attributes")
    keep = [c for c in found.columns if c not in ("kind", "start_ns", "end_ns", "trace_id", "attributes")]
    rows = _picked(found.filter(F.col("kind").isin(*CLIENT) & (F.col("trace_id") != "")), _m=first_of(a, METHOD), _u=first_of(a, URL)).filter("_m is not null and _u is not null")
    path = F.regexp_replace(F.substring_index("_u", "?", 1), r"^https?://[^/]+", "")
    return rows.select(*keep, "trace_id", F.upper("_m").alias("method"), F.when(path == "", "/").otherwise(path).alias("path"))
