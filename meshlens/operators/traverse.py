"""Bounded walks over call, import, inheritance and router tables.

Frontiers are DataFrames; a walk of fixed depth is unrolled into that many joins. Nesting of unknown depth goes on in rounds
that are written, until one brings no new row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.plans.staging import staged


def resolve_callees(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """calls(fqn, ord, callee) with target, the known function that is meant, or null.

    ``self.x`` is a method of the caller's class; ``obj.x`` goes through the import of obj; a bare name through its import,
    without falling back to the module if that names no known function, else to the caller's module.
    """
    info = functions.select("fqn", "module", "qname")
    head, tail = F.substring_index("callee", ".", 1), F.regexp_replace("callee", r"^[^.]*\.", "")
    dotted = F.contains("callee", F.lit("."))
    joined = calls.join(info, "fqn").withColumns({"_dotted": dotted, "_head": head, "_tail": tail})
    via = imports.select("module", F.col("local").alias("_head"), F.col("fqn").alias("_via"))
    joined = joined.join(via, ["module", "_head"], "left")
    dot = lambda a, b: F.when(a == "", b).otherwise(F.concat(a, F.lit("."), b))
    own_class = F.regexp_replace("qname", r"\.[^.]*$", "")
    method = F.col("_dotted") & (F.col("_head") == "self") & F.contains("qname", F.lit("."))
    named = F.when(method, dot(F.col("module"), F.concat(own_class, F.lit("."), "_tail"))).when(F.col("_dotted"), F.concat("_via", F.lit("."), "_tail")).otherwise(F.coalesce("_via", dot(F.col("module"), F.col("callee"))))
    known = functions.select(F.col("fqn").alias("target"))
    return joined.withColumn("_t", named).join(known, F.col("_t") == known["target"], "left").select(*calls.columns, "target")


def call_walk(handlers: DataFrame, resolved: DataFrame, queries: DataFrame, depth: int = 4) -> DataFrame:
    """(id, source, target, type): edges met from each handler(parent, fqn) over resolved(fqn, target) calls and queries(fqn, model).

    A function is left for its callees once in each walk, at most depth steps from the handler; a callee one step further is
    still an edge. Walks are breadth-first: each function is met at its least depth.

    Edges below a handler don't name it, so all walks go on together, and a function is kept with the two nearest handlers
    at most: two, since a handler's own walk doesn't leave it a second time as a function, but another handler's does.
    """
    hops = resolved.filter(F.col("target").isNotNull() & (F.col("target") != F.col("fqn"))).select("fqn", "target").distinct()
    front = handlers.select("fqn", F.col("fqn").alias("handler")).distinct()
    seen = front
    for _ in range(depth):
        onward = front.join(hops, "fqn").select(F.col("target").alias("fqn"), "handler").join(seen, ["fqn", "handler"], "left_anti")
        held = seen.groupBy("fqn").agg(F.count("*").alias("_held"))
        met = onward.groupBy("fqn").agg(F.min("handler").alias("_a"), F.max("handler").alias("_b")).join(held, "fqn", "left")
        room = 2 - F.coalesce("_held", F.lit(0))
        found = F.slice(F.array_distinct(F.array("_a", "_b")), F.lit(1), F.greatest(room, F.lit(0)).cast("int"))
        # written: later steps read it, and what came before, without working it out again
        front = staged(met.select("fqn", F.explode(found).alias("handler")), "walk")
        seen = seen.unionByName(front)
    below = seen.filter("fqn != handler").select("fqn").distinct().select("fqn", F.concat(F.lit("fn:"), "fqn").alias("at"))
    left = handlers.select("fqn", F.col("parent").alias("at")).unionByName(below).distinct()
    call = left.join(hops, "fqn").select(F.col("at").alias("source"), F.concat(F.lit("fn:"), "target").alias("target"), F.lit("calls").alias("type")).withColumn("id", F.concat("source", F.lit("->"), "target"))
    query = left.join(queries, "fqn").select(F.col("at").alias("source"), F.concat(F.lit("db:"), "model").alias("target"), F.lit("queries").alias("type"), F.concat("at", F.lit("->q:"), "model").alias("id"))
    return call.select("id", "source", "target", "type").unionByName(query.select("id", "source", "target", "type")).distinct()


def sql_taint(functions: DataFrame, forwards: DataFrame) -> DataFrame:
    """(fqn, param, witness, line): a parameter that reaches raw SQL within two calls.

    functions(fqn, params, sql_sink_params, raw_sql_lines), forwards(fqn, ord, target, arg_params): positions only. A
    function's own first sink wins over its forwards; of these the first whose callee is tainted at a position fed by a
    parameter.
    """
    direct = functions.filter(F.size("sql_sink_params") > 0).select("fqn", F.get("sql_sink_params", F.lit(0)).alias("param"), F.col("fqn").alias("witness"), F.get("raw_sql_lines", F.lit(0)).alias("line"))
    params = functions.select(F.col("fqn").alias("target"), "params")

    def through(found: DataFrame) -> DataFrame:
        sub = found.select(F.col("fqn").alias("target"), F.col("param").alias("_sink"), "witness", "line")
        place = F.array_position("params", F.col("_sink")) - 1
        fed = forwards.filter(F.col("target").isNotNull() & (F.col("target") != F.col("fqn"))).join(sub, "target").join(params, "target")
        fed = fed.withColumn("param", F.when(place >= 0, F.get("arg_params", place.cast("int")))).filter(F.coalesce("param", F.lit("")) != "")
        first = fed.groupBy("fqn").agg(F.min_by(F.struct("param", "witness", "line"), "ord").alias("_r")).select("fqn", "_r.param", "_r.witness", "_r.line")
        return direct.unionByName(first.join(direct, "fqn", "left_anti"))

    return through(through(direct))


def closure(links: DataFrame) -> DataFrame:
    """(a, b) for every b that links(a, b) reach from a in one step or more.

    Pairs double their length each round, so a chain of n links takes log n rounds; each round joins only new pairs, and
    what is known goes by an anti join, so cycles and diamonds end as soon as they bring nothing new.
    """
    new = known = staged(links.select("a", "b").filter("a is not null and b is not null").distinct(), "closure")
    while not new.isEmpty():
        on, to = known.select("a", F.col("b").alias("_m")), new.select(F.col("a").alias("_m"), "b")
        back, far = new.select("a", F.col("b").alias("_m")), known.select(F.col("a").alias("_m"), "b")
        longer = on.join(to, "_m").select("a", "b").unionByName(back.join(far, "_m").select("a", "b")).distinct()
        new = staged(longer.join(known, ["a", "b"], "left_anti"), "closure-new")
        known = known.unionByName(new)
    return known


def inherited_fields(fields: DataFrame, bases: DataFrame) -> DataFrame:
    """(name, fields): own fields(name, field) and those of bases(name, base), sorted; cycles are cut."""
    return fields_above(fields, closure(bases.select(F.col("name").alias("a"), F.col("base").alias("b"))))


def fields_above(fields: DataFrame, above: DataFrame) -> DataFrame:
    """inherited_fields() from a closure above(a, b) of the bases."""
    own = fields.select("name").distinct()
    every = own.select("name", F.col("name").alias("_above")).unionByName(own.join(above, F.col("name") == F.col("a")).select("name", F.col("b").alias("_above"))).distinct()
    held = fields.select(F.col("name").alias("_above"), "field").distinct()
    return every.join(held, "_above").groupBy("name").agg(F.array_sort(F.collect_set("field")).alias("fields"))


def nested_routes(entries: DataFrame, roots: DataFrame, joint: str = "") -> DataFrame:
    """(path, module, leaf): entries(module, pattern, include, leaf) spelled out from roots(module), prefixes joined by joint; a module inside itself is cut.

    A row is a different (module, prefix). Which modules a prefix has come through matters only where includes run in a
    circle, so only modules of the circle at hand are kept with it.
    """
    entries = staged(entries, "entries")
    leaves = entries.filter("include is null").select("module", "pattern", "leaf")
    steps = staged(entries.filter("include is not null").select("module", "pattern", "include").distinct(), "includes")
    if steps.isEmpty():
        return roots.select("module").distinct().join(leaves, "module").select(F.col("pattern").alias("path"), "module", "leaf").distinct()
    above = closure(steps.select(F.col("module").alias("a"), F.col("include").alias("b")))
    back = above.select(F.col("a").alias("include"), F.col("b").alias("module"))  # include leads back to module
    steps = staged(steps.join(back.withColumn("_circle", F.lit(True)), ["module", "include"], "left").select("module", "pattern", "include", F.coalesce("_circle", F.lit(False)).alias("_circle")), "includes")
    none = F.array().cast("array<string>")
    front = staged(roots.select("module", F.lit("").alias("prefix"), none.alias("_through")).distinct(), "nested")
    walked = front
    while not front.isEmpty():
        through = F.when(F.col("_circle"), F.array_sort(F.array_union("_through", F.array("module")))).otherwise(none)
        on = front.join(steps, "module").withColumn("_t", through).filter((F.col("include") != F.col("module")) & ~F.array_contains("_t", F.col("include")))
        onward = on.select(F.col("include").alias("module"), F.concat("prefix", "pattern", F.lit(joint)).alias("prefix"), F.col("_t").alias("_through")).distinct()
        front = staged(onward.join(walked, ["module", "prefix", "_through"], "left_anti"), "nested")
        walked = walked.unionByName(front)
    return walked.select("module", "prefix").distinct().join(leaves, "module").select(F.concat("prefix", "pattern").alias("path"), "module", "leaf").distinct()


def root_modules(entries: DataFrame) -> DataFrame:
    """Modules that no entry includes."""
    return entries.select("module").distinct().join(entries.select(F.col("include").alias("module")).filter("module is not null"), "module", "left_anti")
