"""Weighted risk scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.functions.columns import round_exact
from meshlens.operators.match import flag
from meshlens.sources.config import DEFAULTS


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    out = F.lit(float(default))
    for name, value in table.items():
        out = F.when(key == name, F.lit(float(value))).otherwise(out)
    return out


def points(config: dict = DEFAULTS) -> Column:
    """A flag's points: severity times the weight of its category; unknown ones count 1."""
    return _lookup(F.col("severity"), config["severity"], 1) * _lookup(F.col("category"), config["weights"], 1.0)


def as_score(total: Column) -> Column:
    return round_exact(F.least(total / 20.0 * 100, F.lit(100.0)), 1)


def hub_flags(nodes: DataFrame, edges: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """Functions on which many call and query edges meet."""
    fan = edges.filter(F.col("type").isin("calls", "queries")).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("fan_in")).filter(F.col("fan_in") >= config["hub_fanin_threshold"])
    hubs = nodes.filter(F.col("type") == "function").join(fan, "id")
    return hubs.select(*flag(F.col("id"), "node", "hub_function", "medium", "operational", F.concat(F.col("fan_in").cast("string"), F.lit(" wires meet in this function")), F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" `"), "label", F.lit("` fan-in "), F.col("fan_in").cast("string")), "Test it first and handle its failures"))


def node_scores(nodes: DataFrame, flags: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """(id, risk_score) of every node; partial sums before the shuffle."""
    sums = flags.filter(F.col("owner_kind") == "node").groupBy(F.col("owner_id").alias("id")).agg(F.sum(points(config)).alias("_p"))
    return nodes.select("id").join(sums, "id", "left").select("id", as_score(F.coalesce("_p", F.lit(0.0))).alias("risk_score"))


def edge_scores(edges: DataFrame, flags: DataFrame, scores: DataFrame, config: dict = DEFAULTS) -> DataFrame:
    """An edge has the worse of its own score and four fifths of its worse end."""
    own = flags.filter(F.col("owner_kind") == "edge").groupBy(F.col("owner_id").alias("id")).agg(F.sum(points(config)).alias("_p"))
    a, b = scores.select(F.col("id").alias("source"), F.col("risk_score").alias("_a")), scores.select(F.col("id").alias("target"), F.col("risk_score").alias("_b"))
    joined = edges.select("id", "source", "target").join(own, "id", "left").join(a, "source", "left").join(b, "target", "left")
    ends = F.greatest(F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0)))
    return joined.select("id", round_exact(F.greatest(as_score(F.coalesce("_p", F.lit(0.0))), ends * 0.8), 1).alias("risk_score"))


def score_stats(flags: DataFrame, scores: DataFrame) -> DataFrame:
    of_nodes = flags.filter(F.col("owner_kind") == "node")
    a = of_nodes.agg(F.count("*").alias("total_flags"), F.count_if(F.col("severity") == "critical").alias("critical_flags"))
    return a.join(scores.agg(F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("max_risk_score")))


def explained(flags: DataFrame, owner: str, config: dict = DEFAULTS) -> DataFrame:
    """The points of each flag of one element."""
    return flags.filter(F.col("owner_id") == owner).select("code", "severity", "category", points(config).alias("points")).orderBy(F.desc("points"), "code")


def suggestions(nodes: DataFrame, part: str, n: int = 5) -> DataFrame:
    """A few ids that hold a string, for one that isn't found."""
    return nodes.filter(F.contains(F.lower("id"), F.lit(part.lower()))).select("id").orderBy("id").limit(n)
