"""Merging of node, edge and flag tables. Order is in an ord column: rows of a table have none of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _kept(df: DataFrame, keys: list[str], pick: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    best = (F.min_by if pick == "first" else F.max_by)(row, F.col("ord"))
    return df.groupBy(*keys).agg(best.alias("_row"), F.min("ord").alias("_first")).select(*keys, *[F.col("_first").alias(c) if c == "ord" else F.col("_row").getField(c).alias(c) for c in rest]).select(*df.columns)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One node an id: the first written stays."""
    return _kept(nodes, ["id"], "first")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge an id: the last written stays, in the first one's place."""
    return _kept(edges, ["id"], "last")


def merge_flags(flags: DataFrame, owners: DataFrame) -> DataFrame:
    """One flag for each owner, code and evidence, the first; flags of unknown owners go."""
    return _kept(flags, ["owner_id", "code", "evidence"], "first").join(owners.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")


def fill_gaps(found: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of more whose id was not found already go behind the others."""
    return found.unionByName(more.join(found.select("id"), "id", "left_anti"), allowMissingColumns=True)
