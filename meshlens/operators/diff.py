"""Two graphs compared: nodes, wires, flags, total risk, and a gate on new flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.functions.columns import SEVERITY_RANK, round_exact, severity_rank, signed, tenths


def element_status(old: DataFrame, new: DataFrame, watched: list[str]) -> DataFrame:
    """(id, status, old_*, new_*): added, removed, or changed in a watched column; unchanged ones are left out. One join."""
    a = old.select("id", *[F.col(c).alias(f"old_{c}") for c in watched], F.lit(True).alias("_a"))
    b = new.select("id", *[F.col(c).alias(f"new_{c}") for c in watched], F.lit(True).alias("_b"))
    both = a.join(b, "id", "full_outer")
    differs = F.lit(False)
    for c in watched:
        differs = differs | ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differs, "changed")
    return both.withColumn("status", status).filter(F.col("status").isNotNull()).drop("_a", "_b")


def node_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    return element_status(old, new, []).select("id", "status")


def wire_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    return element_status(old, new, ["risk_score", "confidence"])


def first_flags(flags: DataFrame) -> DataFrame:
    """The first flag of each owner and code."""
    return flags.groupBy(F.col("owner_id").alias("owner"), "code").agg(F.min_by(F.struct("severity", "category", "message"), "ord").alias("_f")).select("owner", "code", "_f.severity", "_f.category", "_f.message")


def new_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Flags whose (owner, code) newly appears; the severest first."""
    return first_flags(new).join(first_flags(old), ["owner", "code"], "left_anti").orderBy(F.desc(severity_rank(F.col("severity"))), "owner", "code")


def gone_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    return new_flags(new, old)


def gate(introduced: DataFrame, threshold: str) -> DataFrame:
    """One row: failed, whether a new flag is at least that severe."""
    return introduced.agg(F.coalesce(F.bool_or(severity_rank(F.col("severity")) >= SEVERITY_RANK[threshold]), F.lit(False)).alias("failed"))


def risk_totals(old: DataFrame, new: DataFrame) -> DataFrame:
    total = lambda df, name: df.agg(round_exact(F.coalesce(F.sum("risk_score"), F.lit(0.0)), 1).alias(name))
    both = total(old, "old_total").join(total(new, "new_total"))
    return both.withColumn("delta", round_exact(F.col("new_total") - F.col("old_total"), 1))


def summary(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """One row of counts and risk. Graphs are dicts of nodes, edges and flags."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    wires = wire_diff(old["edges"], new["edges"]).agg(*[F.count_if(F.col("status") == s).alias(f"wires_{s}") for s in ("added", "removed", "changed")])
    nodes = node_diff(old["nodes"], new["nodes"]).agg(*[F.count_if(F.col("status") == s).alias(f"nodes_{s}") for s in ("added", "removed")])
    out = risk_totals(old["nodes"], new["nodes"])
    for part in (nodes, wires, count(new_flags(old["flags"], new["flags"]), "flags_introduced"), count(gone_flags(old["flags"], new["flags"]), "flags_resolved")):
        out = out.join(part)
    return out


def text_lines(old: dict[str, DataFrame], new: dict[str, DataFrame], markdown: bool = False) -> DataFrame:
    """(ord, line): the report, a line a row."""
    mark = "| " if markdown else "  "
    one = summary(old, new)
    cell = lambda name, *parts: F.concat(F.lit(mark + name + (" | " if markdown else "  ")), *parts, F.lit(" |" if markdown else ""))
    text = lambda c: F.col(c).cast("string")
    head = one.select(F.posexplode(F.array(cell("nodes", F.lit("+"), text("nodes_added"), F.lit(" / -"), text("nodes_removed")), cell("wires", F.lit("+"), text("wires_added"), F.lit(" / -"), text("wires_removed"), F.lit(" / ~"), text("wires_changed")), cell("flags", F.lit("+"), text("flags_introduced"), F.lit(" / -"), text("flags_resolved")), cell("risk", tenths(F.col("old_total")), F.lit(" -> "), tenths(F.col("new_total")), F.lit(" ("), signed(F.col("delta")), F.lit(")")))).alias("_k", "line")).select(F.struct(F.lit(0).alias("part"), F.col("_k").alias("rank"), F.lit("").alias("owner"), F.lit("").alias("code")).alias("ord"), "line")
    out = head
    for part, (df, sign) in enumerate(((new_flags(old["flags"], new["flags"]), "+"), (gone_flags(old["flags"], new["flags"]), "-")), 1):
        line = F.concat(F.lit(f"{mark}{sign} ["), "severity", F.lit("] "), "code", F.lit("  "), "owner", F.lit(" |" if markdown else ""))
        out = out.unionByName(df.select(F.struct(F.lit(part).alias("part"), (-severity_rank(F.col("severity"))).alias("rank"), "owner", "code").alias("ord"), line.alias("line")))
    return out.orderBy("ord")


def json_document(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """One row: the whole diff as a JSON document. It holds every change, so it is for graphs that a report can show."""
    flag = (F.col("severity"), F.col("code"), F.col("owner"))
    side = lambda df, name: df.withColumn("_k", F.struct(-severity_rank(F.col("severity")), "owner", "code")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", *flag))), lambda x: F.struct(x["severity"].alias("severity"), x["code"].alias("code"), x["owner"].alias("owner"))).alias(name))
    nodes, wires = node_diff(old["nodes"], new["nodes"]), wire_diff(old["edges"], new["edges"])
    of = lambda status: F.array_sort(F.collect_list(F.when(F.col("status") == status, F.col("id"))))
    a = nodes.agg(*[of(s).alias(f"nodes_{s}") for s in ("added", "removed")])
    b = wires.agg(*[of(s).alias(f"wires_{s}") for s in ("added", "removed", "changed")])
    c = side(new_flags(old["flags"], new["flags"]), "flags_introduced").join(side(gone_flags(old["flags"], new["flags"]), "flags_resolved"))
    one = a.join(b).join(c).join(risk_totals(old["nodes"], new["nodes"]))
    part = lambda prefix, *names: F.struct(*[F.col(f"{prefix}_{n}").alias(n) for n in names]).alias(prefix)
    risk = F.struct(F.col("old_total").alias("old"), F.col("new_total").alias("new"), "delta").alias("risk")
    return one.select(F.to_json(F.struct(part("nodes", "added", "removed"), part("wires", "added", "removed", "changed"), part("flags", "introduced", "resolved"), risk)).alias("document"))


def gate_line(introduced: DataFrame, threshold: str) -> DataFrame:
    """One row: failed as of gate(), and a line that says how many new flags are at least that severe."""
    n = F.count_if(severity_rank(F.col("severity")) >= SEVERITY_RANK[threshold])
    return introduced.agg(n.alias("n")).select((F.col("n") > 0).alias("failed"), F.concat(F.col("n").cast("string"), F.lit(f" new flags are {threshold} or worse")).alias("line"))
