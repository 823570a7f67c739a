"""Source trees as tables: a recursive scan of files, and their facts by kind."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlens.plans.shipping import ship
from meshlens.sources.extract import graphql_source, python_source, script_source

#: Folders that are never read.
SKIPPED = {"python": (".git", "node_modules", "__pycache__", ".venv", "venv", "migrations"), "script": (".git", "node_modules", "dist", "build", ".next", "coverage"), "schema": (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build")}
GLOBS = {"python": "*.py", "script": "*.{js,jsx,mjs,ts,tsx}", "schema": "*.{graphql,gql}"}
#: Shapes of facts by kind.
FACTS = {
    "failed": "error string",
    "none": "",
    "import": "local string, fqn string",
    "auth_alias": "name string",
    "url": "pattern string, include string, view string, by_class boolean, line int, regex boolean",
    "viewset": "prefix string, view string, line int",
    "orm_model": "name string, line int",
    "contract": "name string, bases array<string>, fields array<string>, required array<string>",
    "function": "fqn string, qname string, module string, line int, end_line int, params array<string>, calls array<string>, has_try boolean, loose_io array<struct<line:int,name:string>>, raw_sql array<struct<line:int,snippet:string>>, complexity int, orm_models array<string>, sql_sink_params array<string>, forwards array<struct<callee:string,arg_params:array<string>>>, methods array<string>, auth_hint boolean",
    "resolver": "kind string, field string, handler string, line int",
    "route": "method string, path string, prefix string, handler string, line int, end_line int, framework string, has_auth boolean, response_model string, request_model string, annotations array<string>",
    "root_field": "kind string, field string, line int",
    "call": "method string, url string, confidence string, line int, component string, component_line int, has_error_handling boolean, has_timeout boolean, operation_id string, graphql boolean, trpc boolean, response_type string, expected_fields array<string>, sent_fields array<string>, sent_complete boolean",
    "type": "name string, required array<string>, optional array<string>",
    "require": "local string, spec string",
    "export": "local string",
    "mount": "router string, prefix string, target string",
    "express_route": "router string, method string, path string, line int, has_auth boolean",
    "file_route": "method string",
    "procedure": "router string, key string, verb string, nested string, exported boolean, line int",
}


def scan(spark: SparkSession, root: str, section: str) -> DataFrame:
    """(section, path, content) of the files of a section under root; paths are relative with forward slashes."""
    base = root.rstrip("/") + "/"
    glob = GLOBS[section] if section in GLOBS else FURTHER[section][0]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    relative = F.regexp_extract("path", r"\Q" + base.removeprefix("file://") + r"\E(.*)$", 1)
    skipped = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED.get(section, SKIPPED["python"])) + ")/"
    return files.select(F.lit(section).alias("section"), relative.alias("path"), "content").filter(~F.col("path").rlike(skipped))


def _parse(section: str, path: str, text: str) -> Iterator[tuple[str, dict]]:
    if section == "python":
        yield from python_source.parse(path, text)
    elif section == "schema":
        yield from graphql_source.schema_fields(text)
    else:
        s = script_source.Script(text, elements=not path.endswith(".ts"))
        yield from script_source.call_sites(s)
        yield from script_source.types(s)
        if not path.endswith(("x",)):
            yield from script_source.express(s)
            parts = path.split("/")
            if "api" in parts and "app" in parts and parts[-1].startswith("route."):
                yield from script_source.file_routes(s, "app")
            elif "api" in parts and "pages" in parts and parts.index("pages") < parts.index("api"):
                yield from script_source.file_routes(s, "pages")
            if "router" in text or "procedure" in text.lower():
                yield from script_source.trpc(s)


#: Further extractors by section: the glob of their files, and a function from (path, text) to (kind, fact) of the shapes above.
FURTHER: dict[str, tuple[str, Callable[[str, str], Iterator[tuple[str, dict]]]]] = {}


def register(section: str, glob: str, parse: Callable[[str, str], Iterator[tuple[str, dict]]]) -> None:
    """Adds an extractor; scans read its files in the backend's tree, and its facts join those of Python sources."""
    if section in GLOBS:
        raise ValueError(f"{section} is a section of this package")
    FURTHER[section] = (glob, parse)


FACT_ROWS = "section string, path string, sha string, ord long, kind string, fact string"
#: Characters of facts that leave a task in one batch; a file's own facts are never parted.
FACTS_A_BATCH = 1 << 20


def fact_batches(batches: Iterable[pa.RecordBatch], further: dict[str, Callable[[str, str], Iterator[tuple[str, dict]]]]) -> Iterator[pa.RecordBatch]:
    """Facts of (section, path, content, sha), a bounded number at a time."""
    names = ["section", "path", "sha", "ord", "kind", "fact"]
    for batch in batches:
        rows, size = [], 0
        for section, path, sha, content in zip(*(batch.column(c) for c in ("section", "path", "sha", "content")), strict=True):
            section, path, sha = section.as_py(), path.as_py(), sha.as_py()
            try:
                text = content.as_py().decode("utf-8", "replace")
                found = list(further[section](path, text) if section in further else _parse(section, path, text)) or [("none", {})]
            except (RecursionError, IndexError, KeyError, MemoryError) as e:
                found = [("failed", {"error": type(e).__name__})]
            for k, (kind, fact) in enumerate(found):
                spelled = json.dumps(fact)
                size += len(spelled)
                rows.append((section, path, sha, k, kind, spelled))
            if size > FACTS_A_BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names)


def facts(files: DataFrame) -> DataFrame:
    """(section, path, sha, ord, kind, fact) of files; one that can't be read has the one fact ``failed``, one without facts ``none``. Files are dealt out anew: many small ones come in few splits."""
    ship(files.sparkSession)
    further = {section: parse for section, (_, parse) in FURTHER.items()}  # goes to executors with the function below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fact_batches(batches, further)

    dealt = files.withColumn("sha", F.sha2("content", 256)).repartition("path")
    return dealt.mapInArrow(run, FACT_ROWS)


def of_kind(found: DataFrame, kind: str) -> DataFrame:
    """One kind of facts, typed, with file, and ord that follows files and places in them."""
    typed = found.filter(F.col("kind") == kind).select(F.col("path").alias("file"), F.col("ord").alias("_ord"), F.from_json("fact", FACTS[kind]).alias("f"))
    return typed.select("file", "_ord", "f.*")
