"""Call sites against endpoints: equal method and canonical path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions.columns import canonical_path
from meshlens.plans.staging import staged

DYNAMIC = "<dynamic>"


def keyed_endpoints(endpoints: DataFrame) -> DataFrame:
    """The first endpoint of each method and canonical path; later ones of one key never match. An endpoint without a path has no method in its key."""
    method = F.when(F.coalesce("raw_path", F.lit("")) == "", F.coalesce("raw_path", F.lit(""))).otherwise(F.col("method"))
    keyed = endpoints.withColumns({"_method": method, "_path": canonical_path(F.col("raw_path"))})
    return keyed.groupBy("_method", "_path").agg(F.min_by(F.struct(*endpoints.columns), "ord").alias("ep"))


def _met(calls: DataFrame, endpoints: DataFrame, how: str) -> DataFrame:
    """The endpoint side has one row a route, so Spark broadcasts it while it is small."""
    known = calls.filter(F.col("url") != DYNAMIC).withColumn("pattern", canonical_path(F.col("url")))
    eps = keyed_endpoints(endpoints)
    return known.join(eps, (known["method"] == eps["_method"]) & (known["pattern"] == eps["_path"]), how).drop("_method", "_path")


def matched(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Calls with the endpoint (struct ep) that each reaches."""
    return _met(calls, endpoints, "inner")


def wires(found: DataFrame) -> DataFrame:
    return found.select(F.col("ord"), F.concat("id", F.lit("=>"), "ep.id").alias("id"), F.col("id").alias("source"), F.col("ep.id").alias("target"), F.lit("http").alias("type"), F.coalesce("confidence", F.lit("certain")).alias("confidence"), "method", "pattern")


def orphans(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    known = calls.filter(F.col("url") != DYNAMIC).withColumn("pattern", canonical_path(F.col("url")))
    eps = keyed_endpoints(endpoints).select("_method", "_path")
    return known.join(eps, (known["method"] == eps["_method"]) & (known["pattern"] == eps["_path"]), "left_anti")


def unused(endpoints: DataFrame, found: DataFrame) -> DataFrame:
    return endpoints.join(found.select(F.col("ep.id").alias("id")).distinct(), "id", "left_anti")


def guard(n_matched: Column, n_orphans: Column) -> Column:
    """Whether so few of many calls match that discovery is the likelier fault."""
    total = n_matched + n_orphans
    return (total >= 20) & (4 * n_matched < total)


def match_stats(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """One row: matched, orphan_calls, unused_endpoints, discovery_guard."""
    found = matched(calls, endpoints)
    a = found.agg(F.count("*").alias("matched"))
    b = orphans(calls, endpoints).agg(F.count("*").alias("orphan_calls"))
    c = unused(endpoints, found).agg(F.count("*").alias("unused_endpoints"))
    return a.join(b).join(c).withColumn("discovery_guard", guard(F.col("matched"), F.col("orphan_calls")))


def at(file: str = "file", line: str = "line") -> Column:
    return F.concat(F.col(file), F.lit(":"), F.col(line).cast("string"))


def flag(owner: Column, kind: str, code: str, severity: Column | str, category: str, message: Column, evidence: Column, suggestion: str) -> list[Column]:
    return [owner.alias("owner_id"), F.lit(kind).alias("owner_kind"), F.lit(code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(category).alias("category"), message.alias("message"), evidence.alias("evidence"), F.lit(suggestion).alias("suggestion")]


def missing_fields(found: DataFrame) -> DataFrame:
    """Fields that a call reads and the endpoint's declared response lacks. Null stands for unknown and stays silent."""
    lack = F.array_sort(F.array_except("expected_fields", "ep.response_fields"))
    return found.withColumn("missing", lack).filter(F.size("missing") > 0)


def request_fields(found: DataFrame) -> DataFrame:
    """extra: sent but not accepted; lacking: required but not sent. Only where both sides are fully known."""
    known = found.filter(F.col("ep.request_fields").isNotNull() & F.col("sent_fields").isNotNull() & F.coalesce("sent_complete", F.lit(False)))
    return known.withColumn("extra", F.array_sort(F.array_except("sent_fields", "ep.request_fields"))).withColumn("lacking", F.array_sort(F.array_except(F.coalesce("ep.request_required", F.array().cast("array<string>")), "sent_fields"))).filter((F.size("extra") > 0) | (F.size("lacking") > 0))


def match_flags(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Flags of the matcher, orphan calls downgraded under the discovery guard."""
    every = staged(_met(calls, endpoints, "left"), "met")  # the one join that all but two kinds of flags read
    found, missed = every.filter("ep is not null"), every.filter("ep is null").drop("ep")
    words = lambda c: F.concat_ws(", ", c)
    ep_at = F.concat("ep.file", F.lit(":"), F.col("ep.line").cast("string"))
    dynamic = calls.filter(F.col("url") == DYNAMIC).select(*flag(F.col("id"), "node", "unresolvable_url", "low", "contract", F.lit("The URL is built at run time and can't be traced"), at(), "Build the URL from literals"))
    lack = missing_fields(found).select(*flag(F.col("id"), "node", "contract_mismatch", "high", "contract", F.concat(F.lit("Reads undeclared fields: "), words("missing")), F.concat(at(), F.lit(" reads "), words("expected_fields"), F.lit("; "), ep_at, F.lit(" declares "), words("ep.response_fields")), "Declare the fields or stop reading them"))
    asked = request_fields(found)
    extra = asked.filter(F.size("extra") > 0).select(*flag(F.col("id"), "node", "request_contract_mismatch", "high", "contract", F.concat(F.lit("Sends fields that are not accepted: "), words("extra")), F.concat(at(), F.lit(" sends "), words("sent_fields"), F.lit("; "), ep_at, F.lit(" accepts "), words("ep.request_fields")), "Accept the fields or stop sending them"))
    need = asked.filter(F.size("lacking") > 0).select(*flag(F.col("id"), "node", "missing_request_field", "high", "contract", F.concat(F.lit("Omits required fields: "), words("lacking")), F.concat(at(), F.lit(" sends "), F.when(F.size("sent_fields") == 0, "(none)").otherwise(words("sent_fields")), F.lit("; required: "), words("ep.request_required")), "Send the required fields"))
    stats = every.agg(F.count("ep").alias("_m"), F.count("*").alias("_t")).withColumn("_g", guard(F.col("_m"), F.col("_t") - F.col("_m")))
    lost = missed.join(stats)  # stats is one row
    note = F.when(F.col("_g"), F.concat(F.lit(" (low confidence: "), F.col("_m").cast("string"), F.lit(" of "), F.col("_t").cast("string"), F.lit(" calls match)"))).otherwise("")
    lost = lost.select(*flag(F.col("id"), "node", "orphan_call", F.when(F.col("_g"), "low").otherwise("high"), "contract", F.concat(F.lit("No route answers "), "method", F.lit(" "), "url", note), at(), "Add the route or correct the call"))
    dead = unused(endpoints, found).select(*flag(F.col("id"), "node", "unused_endpoint", "low", "contract", F.lit("No call site reaches this endpoint"), at(), "Remove it or name its consumer"))
    out = dynamic
    for more in (lack, extra, need, lost, dead):
        out = out.unionByName(more)
    return out
