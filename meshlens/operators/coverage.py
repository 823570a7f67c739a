"""Line coverage laid over handlers and functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.functions.columns import round_exact
from meshlens.operators.match import flag


def report_of(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, report): the report file of each source file: the same path, else the only one that ends in /path.

    Report paths are spelled out into their suffixes, so this is a join on equality.
    """
    files = nodes.select(F.regexp_replace("file", r"\\", "/").alias("file")).distinct()
    reports = lines.select(F.regexp_replace("file", r"\\", "/").alias("report")).distinct()
    parts = F.split("report", "/")
    tails = reports.select("report", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, i, F.size(parts))))).alias("_k", "file"))
    met = files.join(tails, "file").groupBy("file").agg(F.max(F.when(F.col("_k") == 0, F.col("report"))).alias("_same"), F.count_if(F.col("_k") > 0).alias("_n"), F.max(F.when(F.col("_k") > 0, F.col("report"))).alias("_one"))
    return met.select("file", F.coalesce("_same", F.when(F.col("_n") == 1, F.col("_one"))).alias("report")).filter(F.col("report").isNotNull())


def body_coverage(nodes: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, coverage_pct) of nodes(id, file, line, end_line) whose body has statements; a line both executed and missing counts as executed."""
    state = lines.groupBy(F.regexp_replace("file", r"\\", "/").alias("report"), F.col("line").alias("_l")).agg(F.max(F.when(F.col("state") == "executed", 1).otherwise(0)).alias("_ran"))
    bodies = nodes.filter(F.coalesce("end_line", F.lit(0)) != 0).withColumn("file", F.regexp_replace("file", r"\\", "/"))
    placed = bodies.join(report_of(bodies, lines), "file").filter("line is not null").select("id", "report", "line", "end_line")
    # lines and the ends of bodies in one order: what stands before a body's end less what stands before its start
    ends = placed.select("report", F.explode(F.array(F.struct(F.col("line").alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("end_line").alias("at"), F.lit(1).alias("sign")))).alias("_e"), "id").select("report", "_e.at", "_e.sign", "id")
    marks = state.select("report", F.col("_l").alias("at"), F.lit(0).alias("sign"), F.lit(None).cast(dict(nodes.dtypes)["id"]).alias("id"), "_ran").unionByName(ends.withColumn("_ran", F.lit(0)))
    order = Window.partitionBy("report").orderBy("at", F.col("sign") != 0).rowsBetween(Window.unboundedPreceding, 0)
    passed = marks.withColumns({"_all": F.sum(F.when(F.col("sign") == 0, 1).otherwise(0)).over(order), "_run": F.sum("_ran").over(order)}).filter("sign != 0")
    inside = passed.groupBy("id").agg(F.sum(F.col("sign") * F.col("_all")).alias("_all"), F.sum(F.col("sign") * F.col("_run")).alias("_run")).filter("_all > 0")
    return inside.select("id", round_exact(F.col("_run") / F.col("_all") * 100, 1).alias("coverage_pct"))


def coverage_flags(endpoints: DataFrame, pct: DataFrame) -> DataFrame:
    low = endpoints.join(pct, "id").filter(F.col("coverage_pct") < 50)
    shown = F.col("coverage_pct").cast("string")
    return low.select(*flag(F.col("id"), "node", "untested_handler", F.when(F.col("coverage_pct") == 0, "high").otherwise("medium"), "quality", F.concat(F.lit("Only "), shown, F.lit("% of the handler is covered")), F.concat("file", F.lit(":"), F.col("line").cast("string"), F.lit(" handler `"), F.coalesce("handler", F.lit("?")), F.lit("` body coverage "), shown, F.lit("%")), "Test this endpoint"))

