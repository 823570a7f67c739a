"""Scalar functions of the engine as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SEVERITY_RANK = {"low": 0, "medium": 1, "high": 2, "critical": 3}
CONFIDENCE_RANK = {"inferred": 0, "probable": 1, "certain": 2}
AUTH_HINTS = ("auth", "token", "user", "login", "permission", "jwt", "session")
HTTP_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")
MUTATING = ("POST", "PUT", "PATCH", "DELETE")


def round_exact(value: Column, digits: int) -> Column:
    """Half-even on the exact binary value, as Python rounds."""
    return F.call_function("format_number", value, F.lit("0." + "0" * digits if digits else "0")).cast("double")


def tenths(value: Column) -> Column:
    """A number of one decimal place as text, without exponent however large."""
    return F.call_function("format_number", value, F.lit("0.0"))


def canonical_path(path: Column) -> Column:
    """Query and trailing slashes cut; path parameters of any syntax and all-digit segments become :p."""
    out = F.rtrim(F.substring_index(path, "?", 1), F.lit("/"))
    out = F.when(out == "", "/").otherwise(out)
    for pattern in (r"\{[^}/]+\}", r"<[^>/]+>", r":param", r":[A-Za-z_](?U:\w)*"):
        out = F.regexp_replace(out, pattern, ":p")
    return F.regexp_replace(out, r"/(?U:\d)+(?=/|$)", "/:p")


def param_places(canonical: Column) -> Column:
    """Where a canonical path has parameters, by number of segment."""
    return F.filter(F.transform(F.split(canonical, "/"), lambda s, i: F.when(s == ":p", i)), lambda i: i.isNotNull())


def with_params(path: Column, places: Column) -> Column:
    """A concrete path with parameters in these places; null where one of these segments is empty."""
    parts = F.transform(F.split(path, "/"), lambda s, i: F.when(~F.array_contains(places, i), s).when(s != "", ":p"))
    return F.when(F.forall(parts, lambda s: s.isNotNull()), F.array_join(parts, "/"))


def segments(path: Column) -> Column:
    return F.size(F.split(path, "/"))


def bare_path(path: Column) -> Column:
    """A concrete path without query and trailing slashes."""
    out = F.rtrim(F.substring_index(path, "?", 1), F.lit("/"))
    return F.when(out == "", "/").otherwise(out)


def strip_origin(url: Column) -> Column:
    """scheme://host removed; the rest begins with a slash."""
    out = F.regexp_replace(url, r"^https?://[^/]+", "")
    return F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))


def join_path(prefix: Column, path: Column) -> Column:
    out = F.rtrim(F.concat(F.rtrim(prefix, F.lit("/")), F.lit("/"), F.ltrim(path, F.lit("/"))), F.lit("/"))
    return F.when(out == "", "/").otherwise(out)


def template_of_regex(pattern: Column) -> Column:
    """A regular-expression route as a template: named groups by name, others as <p>, anchors and escapes dropped."""
    out = F.regexp_replace(pattern, r"\(\?P<(\w+)>[^)]*\)", "<$1>")
    out = F.regexp_replace(out, r"\([^)]*\)", "<p>")
    out = F.regexp_replace(F.regexp_replace(out, r"^\^", ""), r"\$$", "")
    return F.regexp_replace(out, r"\\([/.])", "$1")


def module_of(path: Column) -> Column:
    """Dotted module of a source path; a package's __init__ is the package."""
    out = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), "/", ".")
    return F.regexp_replace(F.regexp_replace(out, r"\.__init__$", ""), r"^__init__$", "")


def next_route(path: Column) -> Column:
    """struct(route, kind) of a file under pages/api or app/api/**/route.*; null for other files."""
    parts = F.split(path, "/")
    last = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    api, pages = F.array_position(parts, "api"), F.array_position(parts, "pages")
    folders = F.slice(parts, api.cast("int"), F.greatest(F.size(parts) - api, F.lit(0)).cast("int"))
    shape = lambda segs: F.concat(F.lit("/"), F.concat_ws("/", F.transform(segs, lambda s: F.regexp_replace(s, r"^\[(?:\.\.\.)?(\w+)\]$", ":$1"))))
    app = (last == "route") & F.array_contains(parts, "app")
    page = (pages > 0) & (pages < api)
    named = F.when(last == "index", folders).otherwise(F.concat(folders, F.array(last)))
    return F.when(api > 0, F.when(app, F.struct(shape(folders).alias("route"), F.lit("app").alias("kind"))).when(page, F.struct(shape(named).alias("route"), F.lit("pages").alias("kind"))))


def severity_rank(severity: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY_RANK.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE_RANK.items():
        out = F.when(confidence == name, rank).otherwise(out)
    return out


def heat(score: Column) -> Column:
    return F.when(score >= 70, "critical").when(score >= 40, "high").when(score >= 15, "medium").otherwise("low")


def signed(value: Column) -> Column:
    text = F.regexp_replace(tenths(value), r"\.0$", "")
    return F.when(value > 0, F.concat(F.lit("+"), text)).otherwise(text)


def iso_second(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def require_candidates(from_file: Column, spec: Column) -> Column:
    """Files that a relative require may name, best first."""
    folder = F.regexp_replace(from_file, r"[^/]*$", "")
    parts = F.filter(F.split(F.concat(folder, spec), "/"), lambda p: (p != "") & (p != "."))
    # each .. takes the name before it along
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda held, p: F.when((p == "..") & (F.size(held) > 0), F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(F.concat(held, F.array(p))))
    joined = F.array_join(kept, "/")
    return F.transform(F.array(*map(F.lit, ("", ".js", ".ts", ".mjs", "/index.js", "/index.ts"))), lambda s: F.concat(joined, s))
