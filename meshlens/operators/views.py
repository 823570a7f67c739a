"""Rollups that a graph viewer shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.functions.columns import confidence_rank, heat


def rows_of(nodes: DataFrame, flags: DataFrame, most: int = 60) -> DataFrame:
    """(node, row, type): a column of more than ``most`` nodes of a type is shown by file. Row is the node's own id or type and file."""
    n = nodes.groupBy("type").agg(F.count("*").alias("_n"))
    return nodes.join(n, "type").select(F.col("id").alias("node"), F.when(F.col("_n") > most, F.concat("type", F.lit("|"), "file")).otherwise(F.col("id")).alias("row"), "type")


def group_rollup(nodes: DataFrame, flags: DataFrame, most: int = 60) -> DataFrame:
    """(row, type, risk, flags, members): highest risk and number of flags of each shown row, the riskiest first."""
    counted = flags.filter(F.col("owner_kind") == "node").groupBy(F.col("owner_id").alias("node")).agg(F.count("*").alias("_f"))
    placed = rows_of(nodes, flags, most).join(nodes.select(F.col("id").alias("node"), "risk_score"), "node").join(counted, "node", "left")
    return placed.groupBy("row", "type").agg(F.max("risk_score").alias("risk"), F.sum(F.coalesce("_f", F.lit(0))).alias("flags"), F.count("*").alias("members")).orderBy(F.desc("risk"), "row")


def bundles(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """(a, b, risk, n, confidence): wires between shown rows: highest risk, number and least confidence."""
    a, b = rows.select(F.col("node").alias("source"), F.col("row").alias("a")), rows.select(F.col("node").alias("target"), F.col("row").alias("b"))
    least = F.min_by("confidence", confidence_rank(F.col("confidence")))
    return edges.join(a, "source").join(b, "target").groupBy("a", "b").agg(F.max("risk_score").alias("risk"), F.count("*").alias("n"), least.alias("confidence"))


def by_heat(nodes: DataFrame) -> DataFrame:
    """(heat, n): nodes by the heat of their risk."""
    return nodes.groupBy(heat(F.col("risk_score")).alias("heat")).agg(F.count("*").alias("n"))


def sample(df: DataFrame, key: str, ident: str, k: int, seed: int = 45) -> DataFrame:
    """k rows of each key by a seeded digest, which any SQL engine has."""
    w = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(ident).cast("string")).cast("binary")), ident)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def code_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code")


def component_counts(calls: DataFrame) -> DataFrame:
    """One row: different components that call, and their calls."""
    return calls.agg(F.count_distinct("component").alias("components"), F.count("*").alias("calls"))


def summary(nodes: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """(part, name, n): nodes and edges by type, flags by severity and by code."""
    parts = (("node", nodes, "type"), ("edge", edges, "type"), ("flag", flags, "severity"), ("code", flags, "code"))
    return reduce(DataFrame.unionByName, [df.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "name", "n") for part, df, c in parts])
