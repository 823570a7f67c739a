"""Main text of pages: markup, marks, templates of a host, and the table against SQL."""

import duckdb
import pytest

from meshlens.llm import html_text, queries
from meshlens.llm.html_text import main_text

SF = "/root/testdata/sf0.01"

RICH = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p><article>";</script></head>
<body class="has-sidebar"><header class="site"><h1>Site</h1></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav>
<div id="cookie-notice">We use cookies</div><aside>Side</aside>
<article class="post"><header><h1>Tom &amp; Jerry&nbsp;&#8212; caf&eacute;</h1></header>
<p>One <b>bold</b>
  <i>slanted</i><br>line<script>if (a < b) {}</script> end<p>Two unclosed
<div class="ad">Buy</div><ul><li>first<li>second</ul><blockquote>Said</blockquote><pre>a
   b</pre><table><tr><td>x<td>y</table><!-- <p>hidden</p> --><form><p>Mail?</p><input></form>
<div class="share-buttons">Tweet</div><p hidden>Unseen</p><footer>By me</footer>
<section id="comments"><article class="comment"><p>Long comment, longer than the whole text of the article itself, which must not be taken for it in any case.</p></article></section>
</article><div class="sidebar">More</div><footer>&copy; site</footer></body></html>"""


def test_rich_page():
    assert main_text(RICH).split("\n\n") == ["Tom & Jerry — café", "One bold slanted line end", "Two unclosed", "first", "second", "Said", "a b", "x", "y"]


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt; text", "plain <b> text"),
        ("<p>a<p>b", "a\n\nb"),
        ("<body><main><p>in</p></main><p>out</p>", "in"),
        ("<p>x<!-- never closed <p>y", "x"),
        ("<p>x<script>never closed <p>y", "x"),
        ("<p>x <a href='>'>y</a> <a title=it's>z</a>", "x y z"),
        ("<p>x<b y", "x"),
        ("<P>&amp &ampx &am &notit; &#x41;&#0; &unknown;</P>", "& &x &am ¬it; A� &unknown;"),
        ("<div><p>a</div></b></p>b", "a\n\nb"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<textarea><p>x</p></textarea><p>y", "y"),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", "a\n\nb\n\nc"),
        ("<div role=navigation>n</div><h2 class=header>T</h2> a  b ", "T\n\na b"),
        ("<article><p>short</p></article><article><p>the longer one</p></article>", "the longer one"),
    ],
)
def test_small_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("html", ["<a <" * 300_000, '<a b="' * 300_000, "<" * 1_000_000, "&" * 1_000_000, "<p>" * 300_000, "</p>" * 300_000, "<a b='" * 200_000 + ">", "<!--" * 300_000, "<script>" * 200_000, "<div><b>" * 100_000, "<li>" * 200_000, "<div>" * 100_000 + "</section>" * 100_000 + "<li>" * 50_000, "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000])
def test_hostile_pages_take_linear_time(html):
    assert isinstance(main_text(html), str)


def page(k, unique=None, article=False):
    body = f"<p>Story {k} tells of {unique or k * 7919} things.</p><p>{'Shared line.' if k % 2 else 'Other line.'}</p>"
    menu = "<div><div><a href='/'>Home</a> <a href='/news'>News</a></div><span>Your daily paper</span></div>"
    inner = f"<article>{body}<div>Follow us everywhere</div></article>" if article else f"<div>{body}</div>"
    return f"<html><body>{menu}{inner}<div>Terms of use</div></body></html>"


def extracted(spark, rows, **options):
    df = spark.createDataFrame([(i, u, h, "x", 1, "y") for i, u, h in rows], "page_id long, url string, html string, host string, subtree int, text string")
    found = html_text.extracted(df, **options)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(tuple(r) for r in found.collect())
    assert all(n == len(t) for _, _, t, n in got)
    return {i: t for i, _, t, _ in got} if len({r[0] for r in rows}) == len(rows) else got


def test_templates_of_a_host_go(spark):
    rows = [(k, f"https://a.example.com/{k}", page(k)) for k in range(12)]
    rows += [(100 + k, f"http://B.example.com?{k}", page(k, article=True)) for k in range(12)]
    rows += [(200 + k, f"http://c.example.com/{k}", page(7, "same")) for k in range(12)]  # copies are one page: nothing recurs
    rows += [(300, "http://d.example.com/", page(1)), (301, None, page(2)), (302, "nowhere", page(3)), (303, "http://d.example.com/", None)]
    got = extracted(spark, rows)
    for k in range(12):
        # without an article, a paragraph that half of the pages share is a template too
        assert got[k] == f"Story {k} tells of {k * 7919} things."
        line = "Shared line." if k % 2 else "Other line."
        assert got[100 + k] == f"Story {k} tells of {k * 7919} things.\n\n{line}"  # prose of an article stays, its repeated container goes
        assert got[200 + k].startswith("Home News") and "Terms of use" in got[200 + k]
    assert got[300].startswith("Home News") and got[301].startswith("Home News") and got[302].startswith("Home News") and got[303] == ""
    kept = extracted(spark, rows, share=0.6)
    assert kept[1] == "Story 1 tells of 7919 things.\n\nShared line."


def test_odd_tables(spark):
    assert extracted(spark, []) == {}
    rows = [(1, "http://x/", "<p>a</p>")] * 3 + [(2, "http://x/", "<article><p>" + "word " * 500_000 + "</article>")]
    got = extracted(spark, rows)
    assert [t for _, _, t, _ in got[:3]] == ["a"] * 3 and len(got[3][2]) == 2_499_999


def test_table_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    found = db.execute(queries.SQL["op11_html"])
    names = [c[0] for c in found.description]
    got = queries.op11_html(spark, SF)
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == sorted(found.fetchall())
