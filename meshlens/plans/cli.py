"""Command line: scan, collect, serve, ingest, diff and explain."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import threading
import time
import urllib.error
import urllib.request

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import meshlens
from meshlens import schema
from meshlens.operators import diff, history, score, views
from meshlens.plans import scan as scanning
from meshlens.plans import viewer
from meshlens.sources import cache, config, specs
from meshlens.streaming import http_receiver, spans, state


def _spark() -> SparkSession:
    return SparkSession.builder.appName("meshlens").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _openapi(spark: SparkSession, *folders: str) -> tuple[DataFrame, str] | None:
    found = next((p for p in (os.path.join(f, "openapi.json") for f in folders) if os.path.exists(p)), None)
    return (specs.operations(specs.whole_text(spark, found)), os.path.relpath(found, folders[0])) if found else None


def document(out: str) -> str | None:
    """The JSON document of the last scan."""
    parts = glob.glob(f"{out}/graph.json/part-*")
    return open(parts[0], encoding="utf-8").read().strip() if parts else None  # noqa: SIM115


def stored_window(spark: SparkSession, store: str) -> float:
    """Hours that a store keeps."""
    return spark.read.schema("window_hours double").json(f"{store}/settings").first()["window_hours"] if os.path.isdir(f"{store}/settings") else 24.0


def run_ingest(folder: str, store: str, window_hours: float | None = None) -> None:
    """Takes the payloads of a folder into a store, once each, which keeps what is in its window; a window that is given is kept with the store."""
    spark = _spark()
    if window_hours:
        spark.createDataFrame([(float(window_hours),)], "window_hours double").coalesce(1).write.mode("overwrite").json(f"{store}/settings")
    os.makedirs(folder, exist_ok=True)
    state.keep_stream(spans.payload_stream(spark, folder), f"{store}/checkpoint", stored_window(spark, store)).awaitTermination()


def run_serve(root: str, folder: str, out: str, port: int, tokens: dict[str, str] | None, every: float | None = None) -> http_receiver.ThreadingHTTPServer:
    """A server of the viewer, the last graph and the collector; a scan runs on POST /rescan and, if given, every so many seconds."""

    def pages(path: str) -> tuple[bytes, str] | None:
        if path in ("/", "/graph.html"):
            return viewer.page().encode(), "text/html; charset=utf-8"
        held = document(out) if path == "/graph.json" else None
        return (held.encode(), "application/json") if held else None

    def rescan() -> dict:
        run_ingest(folder, f"{out}/store")
        graph = run_scan(root, None, None, out, store=f"{out}/store")
        return score.score_stats(graph.flags, graph.nodes).first().asDict()

    server = http_receiver.make_server(folder, port, tokens, pages, rescan)

    def timed() -> None:
        bearer = {"Authorization": f"Bearer {next(iter(tokens))}"} if tokens else {}
        while True:
            time.sleep(every)
            try:  # by the same way as everyone, so that one scan runs at a time
                urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/rescan", b"", bearer)).close()  # noqa: S310
            except urllib.error.HTTPError as e:
                print(f"rescan: {e}", file=sys.stderr)
            except urllib.error.URLError:
                return

    if every:
        threading.Thread(target=timed, daemon=True).start()
    return server


def run_scan(root: str, backend: str | None, frontend: str | None, out: str, coverage: str | None = None, store: str | None = None, window_hours: float | None = None, use_cache: bool = True) -> scanning.Graph:
    """Writes graph.json, graph.html, history and the parse cache under out, and gives the graph. The window is that of the store unless one is given."""
    spark, guessed = _spark(), config.guess_folders(root)
    sides = [os.path.join(root, given or found or "") for given, found in zip((backend, frontend), guessed, strict=True)]
    for folder in sides:
        if not os.path.isdir(folder):
            raise SystemExit(f"no such folder: {folder}")
    now = int(time.time() * 1000)
    observations = None
    if store and os.path.isdir(f"{store}/checkpoint/state"):
        observations = state.kept(spark, f"{store}/checkpoint", now, window_hours or stored_window(spark, store))
    lines = specs.coverage_lines(specs.whole_text(spark, coverage)) if coverage else None
    kept_facts = f"{out}/cache-v{cache.VERSION}"
    graph = scanning.scan(spark, *sides, cached=kept_facts if use_cache else None, openapi=_openapi(spark, root, sides[0]), lines=lines, observations=observations, config=config.load_config(os.path.join(root, "meshlens.yaml")))
    specs.write_graph({"nodes": graph.nodes.drop("ord"), "edges": graph.edges, "flags": graph.flags}, f"{out}/graph.json")
    with open(f"{out}/graph.html", "w", encoding="utf-8") as f:
        f.write(viewer.page(document(out)))
    taken = history.snapshot(graph.nodes, graph.edges, graph.flags, now)
    kept = spark.read.schema(schema.HISTORY).json(f"{out}/history.json") if os.path.isdir(f"{out}/history.json") else taken.limit(0)
    rows = history.recorded(kept.unionByName(taken)).collect()  # at most the cap of snapshots
    spark.createDataFrame(rows, schema.HISTORY).coalesce(1).write.mode("overwrite").json(f"{out}/history.json")
    return graph


def run_diff(old: str, new: str, form: str, fail_on: str | None) -> int:
    spark = _spark()
    try:
        a, b = specs.read_graph(spark, old), specs.read_graph(spark, new)
        lines = [diff.json_document(a, b).first()["document"]] if form == "json" else [r["line"] for r in diff.text_lines(a, b, form == "markdown").select("line").collect()]
    except Exception as e:  # noqa: BLE001
        print(f"unreadable graph: {e}", file=sys.stderr)
        return 2
    print("\n".join(lines))
    if not fail_on:
        return 0
    told = diff.gate_line(diff.new_flags(a["flags"], b["flags"]), fail_on).first()
    print(told["line"], file=sys.stderr)
    return int(told["failed"])


def run_explain(path: str, owner: str) -> int:
    g = specs.read_graph(_spark(), path)
    if g["nodes"].unionByName(g["edges"], allowMissingColumns=True).filter(F.col("id") == owner).isEmpty():
        print("unknown; near: " + ", ".join(r["id"] for r in score.suggestions(g["nodes"], owner).collect()))
        return 2
    for r in score.explained(g["flags"], owner).collect():
        print(f"{r['points']:6.1f}  {r['severity']:8}  {r['category']:12}  {r['code']}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="meshlens", description=__doc__)
    parser.add_argument("--version", action="version", version=meshlens.__version__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    s = verbs.add_parser("scan")
    s.add_argument("root")
    for name in ("--backend", "--frontend", "--coverage", "--store"):
        s.add_argument(name)
    s.add_argument("--out", default="meshlens-out")
    s.add_argument("--window-hours", type=float)
    s.add_argument("--no-cache", action="store_true")
    c = verbs.add_parser("collect")
    v = verbs.add_parser("serve")
    v.add_argument("root")
    v.add_argument("--out", default="meshlens-out")
    v.add_argument("--every", type=float, help="seconds between scans")
    for p in (c, v):
        p.add_argument("folder")
        p.add_argument("--port", type=int, default=4318)
    i = verbs.add_parser("ingest")
    i.add_argument("folder")
    i.add_argument("store")
    i.add_argument("--window-hours", type=float)
    d = verbs.add_parser("diff")
    d.add_argument("old")
    d.add_argument("new")
    d.add_argument("--format", choices=["text", "markdown", "json"], default="text")
    d.add_argument("--fail-on", choices=["low", "medium", "high", "critical"])
    e = verbs.add_parser("explain")
    e.add_argument("graph")
    e.add_argument("owner")
    a = parser.parse_args(argv)
    if a.verb == "scan":
        graph = run_scan(a.root, a.backend, a.frontend, a.out, a.coverage, a.store, a.window_hours, not a.no_cache)
        print(score.score_stats(graph.flags, graph.nodes).first().asDict())
        print(views.component_counts(graph.calls).first().asDict())
        print({r["heat"]: r["n"] for r in views.by_heat(graph.nodes).collect()})  # four rows at most
        for r in views.summary(graph.nodes, graph.edges, graph.flags).orderBy("part", F.desc("n"), "name").collect():  # a row a type or code
            print(f"{r['part']:5} {r['name']:28} {r['n']:8}")
        return 0
    if a.verb == "ingest":
        run_ingest(a.folder, a.store, a.window_hours)
        return 0
    if a.verb == "collect":
        http_receiver.make_server(a.folder, a.port).serve_forever()
        return 0
    if a.verb == "serve":
        tokens = config.parse_tokens(os.environ.get("MESHLENS_TOKENS"), os.environ.get("MESHLENS_TOKEN"))
        run_serve(a.root, a.folder, a.out, a.port, tokens, a.every).serve_forever()
        return 0
    return run_diff(a.old, a.new, a.format, a.fail_on) if a.verb == "diff" else run_explain(a.graph, a.owner)


if __name__ == "__main__":
    sys.exit(main())
