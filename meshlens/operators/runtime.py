"""Span observations laid over endpoints: rollups, attribution to wires, and flags.

An endpoint may hold a third of all observations, so percentiles come from counts by value: summed in each task first, then
narrowed down by histograms.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.functions.columns import bare_path, canonical_path, param_places, round_exact, segments, with_params
from meshlens.operators.match import at, flag
from meshlens.plans.staging import staged
from meshlens.sources.config import DEFAULTS


#: Bins of a histogram, and so the most different values that a group may hold to be ranked at once.
BINS = 1024


def nearest_ranks(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], weight: str | None = None, bins: int = BINS) -> DataFrame:
    """Nearest-rank percentiles, rounded to one place, of each group's values that aren't null; with weight, a row stands for so many.

    The rank is looked for in histograms: a group's values fall into at most ``bins`` bins of equal width, and those of the
    bin that holds the rank go on to the next round, until that bin is one value. No group's values meet in one task.
    """
    n = F.sum(weight) if weight else F.count("*")
    counts = staged(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(n.alias("_n")), "ranks-counts")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(q)).alias("q")) for name, q in quantiles.items()]))
    spans = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    spans = spans.select(*keys, "_all", "_lo", "_hi", wanted.alias("_q"))
    rank = F.least(F.bround(F.col("_q.q") * (F.col("_all") - 1), 0).cast("long"), F.col("_all") - 1)
    open_ = staged(spans.select(*keys, "_q.name", rank.alias("_rank"), "_lo", "_hi"), "ranks-open")
    done = open_.filter("_lo = _hi")
    same = lambda a, b: reduce(Column.__and__, [a[k].eqNullSafe(b[k]) for k in keys])
    while not (left := open_.filter("_lo != _hi")).isEmpty():
        inside = counts.join(left, same(counts, left) & (counts["_v"] >= left["_lo"]) & (counts["_v"] <= left["_hi"])).select(*[left[k] for k in keys], "name", "_rank", "_lo", "_hi", "_v", "_n")
        share = (F.col("_v").cast("double") - F.col("_lo").cast("double")) / (F.col("_hi").cast("double") - F.col("_lo").cast("double"))
        # where doubles don't tell the ends apart, or the width overflows, the ends are bins of their own
        bin_ = F.when(F.col("_v") == F.col("_lo"), 0).when(F.col("_v") == F.col("_hi"), bins + 1).otherwise(1 + F.least(F.lit(bins - 1), F.coalesce(F.floor(F.nanvl(share, F.lit(0.5)) * bins), F.lit(0))).cast("int"))
        binned = inside.groupBy(*keys, "name", "_rank", bin_.alias("_bin")).agg(F.sum("_n").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        row = F.struct(F.col("_bin").alias("bin"), "n", "lo", "hi")
        held = binned.groupBy(*keys, "name", "_rank").agg(F.array_sort(F.collect_list(row)).alias("_bins"))
        # the first bin that the rank falls into, and what is left of the rank in it
        start = F.struct(F.col("_rank").alias("rank"), F.lit(None).cast(binned.select(row.alias("r")).schema["r"].dataType).alias("at"))
        step = lambda s, b: F.when(s["at"].isNotNull(), s).when(s["rank"] < b["n"], F.struct(s["rank"].alias("rank"), b.alias("at"))).otherwise(F.struct((s["rank"] - b["n"]).alias("rank"), s["at"].alias("at")))
        found = held.select(*keys, "name", F.aggregate("_bins", start, step).alias("_f"))
        open_ = staged(found.select(*keys, "name", F.col("_f.rank").alias("_rank"), F.col("_f.at.lo").alias("_lo"), F.col("_f.at.hi").alias("_hi")), "ranks-open")
        done = done.unionByName(open_.filter("_lo = _hi"))
    return done.groupBy(*keys).agg(*[round_exact(F.max(F.when(F.col("name") == name, F.col("_lo"))), 1).alias(name) for name in quantiles])


def split_observations(observations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(routed, with key; unrouted, with path): those with neither go."""
    has_route = F.coalesce("route", F.lit("")) != ""
    routed = observations.filter(has_route).withColumn("key", F.concat("method", F.lit(" "), canonical_path(F.col("route"))))
    return routed, observations.filter(~has_route & (F.coalesce("path", F.lit("")) != ""))


def in_window(df: DataFrame, now_ms: int, window_hours: float) -> DataFrame:
    return df.filter(F.col("ts_ms") >= F.lit(now_ms) - F.lit(window_hours) * 3_600_000)


def last_per_key(df: DataFrame, key: str | None, cap: int = 5000) -> DataFrame:
    """The latest arrivals of each key. Arrival is the ord column; the filter on the rank lets Spark keep only cap rows a task and key."""
    w = Window.partitionBy(key if key else F.lit(1)).orderBy(F.desc("ord"))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= cap).drop("_r")


def observed(endpoints: DataFrame, observations: DataFrame) -> DataFrame:
    """(endpoint, ord, dur_ms, status, trace_id, direct): routed ones by key, others by method and path template.

    Endpoints of one key share all its observations, and a path counts for each template that it meets. Only different
    (method, path) pairs meet the templates, and by equality: a pair is spelled once for each set of parameter places that
    templates of its method and length have.
    """
    routed, unrouted = split_observations(observations)
    eps = endpoints.select(F.col("id").alias("endpoint"), F.col("method").alias("_m"), canonical_path(F.col("raw_path")).alias("_c"))
    keyed = eps.select("endpoint", F.concat("_m", F.lit(" "), "_c").alias("key"))
    columns = ["endpoint", "ord", "dur_ms", "status", "trace_id"]
    direct = routed.join(keyed, "key").select(*columns, F.lit(True).alias("direct"))
    paths = unrouted.withColumn("_b", bare_path(F.col("path")))
    shapes = eps.withColumns({"_s": segments(F.col("_c")), "_places": param_places(F.col("_c"))})
    masks = shapes.groupBy("_m", "_s").agg(F.collect_set("_places").alias("_masks"))
    pairs = paths.select("method", "_b").distinct().withColumn("_s", segments(F.col("_b")))
    spelled = pairs.withColumnRenamed("method", "_m").join(masks, ["_m", "_s"]).select("_m", "_b", F.explode("_masks").alias("_places")).withColumn("_c", with_params(F.col("_b"), F.col("_places")))
    met = spelled.join(shapes, ["_m", "_c", "_places"]).select(F.col("_m").alias("method"), "_b", "endpoint")
    fallback = paths.join(met, ["method", "_b"]).select(*columns, F.lit(False).alias("direct"))
    return direct.unionByName(fallback)


def rollup(endpoints: DataFrame, seen: DataFrame, window_hours: float = 24.0) -> DataFrame:
    """One row an endpoint; without traffic, zero requests and nulls."""
    # counted once: all else comes from these counts
    held = staged(seen.groupBy("endpoint", "dur_ms", (F.col("status") >= 500).alias("_failed"), "direct").agg(F.count("*").alias("_n")), "observed")
    base = held.groupBy("endpoint").agg(F.sum("_n").alias("req_count"), F.coalesce(F.sum(F.when(F.col("_failed"), F.col("_n"))), F.lit(0)).alias("_err"), F.bool_or("direct").alias("_direct"))
    ranks = nearest_ranks(held, ["endpoint"], "dur_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, "_n")
    ids = endpoints.select(F.col("id").alias("endpoint"))
    joined = ids.join(base, "endpoint", "left").join(ranks, "endpoint", "left")
    return joined.select("endpoint", F.coalesce("req_count", F.lit(0)).alias("req_count"), "p50_ms", "p95_ms", round_exact(F.col("_err") / F.col("req_count"), 4).alias("error_rate"), F.lit(float(window_hours)).alias("window_hours"), F.when(F.col("_direct"), "certain").when(F.col("req_count") > 0, "probable").alias("confidence"))


def client_index(clients: DataFrame) -> DataFrame:
    """The last client span of each trace."""
    last = F.max_by(F.struct("method", canonical_path(F.col("path")).alias("canon")), "ord")
    return clients.groupBy("trace_id").agg(last.alias("_c")).select("trace_id", F.col("_c.method").alias("client_method"), F.col("_c.canon").alias("client_path"))


def attributed(wires: DataFrame, calls: DataFrame, owners: DataFrame, seen: DataFrame, clients: DataFrame) -> DataFrame:
    """Traffic of each HTTP wire: an endpoint's requests by client method and path, split evenly among the wires of that key.

    wires(ord, id, source, target), owners(call, component, ord). req_count is null where no client span is known.
    """
    traced = staged(seen.groupBy("endpoint", "trace_id").agg(F.count("*").alias("_n")), "traced")
    hits = traced.join(client_index(clients), "trace_id").groupBy("endpoint", "client_method", "client_path").agg(F.sum("_n").alias("_hits"))
    total = traced.groupBy("endpoint").agg(F.sum("_n").alias("endpoint_req_count"))
    any_hit = hits.select("endpoint").distinct().withColumn("attributed", F.lit(True))
    call = calls.select(F.col("id").alias("source"), F.col("method").alias("client_method"), canonical_path(F.coalesce("url", F.lit(""))).alias("client_path"))
    named = owners.groupBy(F.col("call").alias("source")).agg(F.max_by("component", "ord").alias("component"))
    keyed = wires.select("ord", "id", "source", F.col("target").alias("endpoint")).join(call, "source").join(total, "endpoint")
    sharing = keyed.withColumn("_n", F.count("*").over(Window.partitionBy("endpoint", "client_method", "client_path")))
    joined = sharing.join(hits, ["endpoint", "client_method", "client_path"], "left").join(any_hit, "endpoint", "left").join(named, "source", "left")
    share = round_exact(F.coalesce("_hits", F.lit(0)) / F.col("_n"), 1)
    return joined.select("ord", "id", "endpoint", "component", F.when(F.col("attributed"), share).alias("req_count"), "endpoint_req_count", F.coalesce("attributed", F.lit(False)).alias("attributed"))


def top_callers(traffic: DataFrame) -> DataFrame:
    """The component of each endpoint's busiest wire, the first of equals; none where no wire has any request or it has no component."""
    best = F.max_by(F.struct("component", "req_count"), F.struct("req_count", -F.col("ord")))
    return traffic.filter(F.col("attributed") & (F.col("req_count") > 0)).groupBy("endpoint").agg(best.alias("_b")).select("endpoint", F.col("_b.component").alias("component"), F.col("_b.req_count").alias("caller_req_count")).filter(F.col("component").isNotNull())


def hot_threshold(rolled: DataFrame) -> DataFrame:
    """One row: the nearest-rank 90th percentile of requests over endpoints with traffic."""
    return nearest_ranks(rolled.filter(F.col("req_count") > 0).withColumn("_one", F.lit(1)), ["_one"], "req_count", {"hot": 0.9}).select("hot")


def runtime_flags(endpoints: DataFrame, flags: DataFrame, rolled: DataFrame, callers: DataFrame | None = None, config: dict = DEFAULTS) -> DataFrame:
    """Flags that traffic adds. flags are the static ones, which hot_fragile looks at; confirmed_dead takes the place of unused_endpoint (see without_replaced)."""
    limits = config["runtime"]
    eps = endpoints.join(rolled.withColumnRenamed("endpoint", "id"), "id")
    ids = F.col("id")
    requests = F.col("req_count").cast("string")
    hours = F.regexp_replace(F.col("window_hours").cast("string"), r"\.0$", "")
    static = flags.filter(F.col("owner_kind") == "node").groupBy(F.col("owner_id").alias("id")).agg(F.bool_or(F.col("code") == "unused_endpoint").alias("_unused"), F.array_sort(F.collect_set(F.when(F.col("severity").isin("high", "critical"), F.col("code")))).alias("_codes"))
    known = eps.join(static, "id", "left")
    dead = known.filter((F.col("req_count") == 0) & F.col("_unused")).select(*flag(ids, "node", "confirmed_dead", "medium", "contract", F.concat(F.lit("No reference and no request in "), hours, F.lit(" h")), F.concat(at(), F.lit(" 0 requests in window, no frontend call site")), "Remove it or name its consumer"))
    slow = eps.filter(F.col("p95_ms") > limits["p95_ms_threshold"]).select(*flag(ids, "node", "high_latency", "medium", "operational", F.concat(F.lit("p95 is "), F.col("p95_ms").cast("string"), F.lit(" ms")), F.concat(at(), F.lit(" p95 "), F.col("p95_ms").cast("string"), F.lit("ms over "), requests, F.lit(" requests in "), hours, F.lit("h")), "Profile the handler"))
    share = F.format_number(F.col("error_rate") * 100, 1)
    failing = eps.filter(F.col("error_rate") > limits["error_rate_threshold"]).select(*flag(ids, "node", "high_error_rate", "high", "operational", F.concat(share, F.lit("% of responses fail")), F.concat(at(), F.lit(" error rate "), share, F.lit("% over "), requests, F.lit(" requests in "), hours, F.lit("h")), "Read the logs of failing responses"))
    hot = known.filter(F.size("_codes") > 0).join(hot_threshold(rolled)).filter((F.col("req_count") > 0) & (F.col("req_count") >= F.col("hot")))
    hot = hot.join(callers.withColumnRenamed("endpoint", "id"), "id", "left") if callers is not None else hot.withColumn("component", F.lit(None).cast("string"))
    sends = F.coalesce(F.concat(F.lit("; "), "component", F.lit(" sends most of them")), F.lit(""))
    fragile = hot.select(*flag(ids, "node", "hot_fragile", "critical", "operational", F.concat(requests, F.lit(" requests meet static high or critical flags")), F.concat(at(), F.lit(" carries "), F.concat_ws(", ", "_codes"), F.lit(" while serving "), requests, F.lit(" requests"), sends), "Fix the static flags here first"))
    return dead.unionByName(slow).unionByName(failing).unionByName(fragile)


def without_replaced(flags: DataFrame, added: DataFrame) -> DataFrame:
    """Flags without the unused_endpoint ones that confirmed_dead replaces."""
    gone = added.filter(F.col("code") == "confirmed_dead").select("owner_id", F.lit("unused_endpoint").alias("code"))
    return flags.join(gone, ["owner_id", "code"], "left_anti").select(*flags.columns)
