import pytest
from pyspark.sql import functions as F

from meshlens.functions import columns as fx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [("/u/{id}", "/u/:p"), ("/u/<int:id>/x", "/u/:p/x"), ("/u/:id", "/u/:p"), ("/u/:param/1/22", "/u/:p/:p/:p"), ("/v2/things", "/v2/things"), ("/a/?q=1", "/a"), ("/", "/"), ("", "/"), ("//", "/"), ("/en/25#top", "/en/25#top")],
)
def test_canonical_path(spark, raw, expected):
    assert one(spark, raw, fx.canonical_path) == expected


def test_templates_are_literal_but_for_parameters(spark):
    df = spark.createDataFrame([("/a.b/:p", "/a.b/7"), ("/a.b/:p", "/axb/7"), ("/a/:p", "/a/b/c"), ("/a/:p", "/a/"), ("/:p/x/:p", "/1/x/2"), ("/a", "/a"), ("/:p", "/:p")], "c string, x string")
    assert [r[0] for r in df.select(fx.with_params(F.col("x"), fx.param_places(F.col("c"))).eqNullSafe(F.col("c"))).collect()] == [True, False, False, False, True, True, True]


def test_rounding_is_half_even_on_the_binary_value(spark):
    values = [0.15, 0.25, 66.65, 2.5, 1234567.25, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(fx.round_exact(F.col("v"), 1)).collect()] == [round(v, 1) for v in values]


@pytest.mark.parametrize(("path", "route"), [("web/pages/api/users/[id].ts", "/api/users/:id"), ("pages/api/index.ts", "/api"), ("src/app/api/x/[...all]/route.ts", "/api/x/:all"), ("src/lib/api/x.ts", None)])
def test_next_route(spark, path, route):
    found = one(spark, path, fx.next_route)
    assert (found["route"] if found else None) == route


def test_names(spark):
    assert one(spark, "app/api/__init__.py", fx.module_of) == "app.api"
    assert one(spark, "^items/(?P<pk>\\d+)\\/(\\w+)\\.x$", fx.template_of_regex) == "items/<pk>/<p>.x"
    assert one(spark, "api", lambda c: fx.join_path(F.lit("/v1/"), c)) == "/v1/api"


def test_require_candidates_go_up(spark):
    df = spark.createDataFrame([("a/b/c.js", "../../d"), ("a/b/c.js", "./x/../y"), ("c.js", "./z"), ("a/b/c.js", ".././q")], "f string, s string")
    assert [r[0] for r in df.select(fx.require_candidates(F.col("f"), F.col("s"))[1]).collect()] == ["d.js", "a/b/y.js", "z.js", "a/q.js"]
