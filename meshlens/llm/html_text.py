"""Main text of web pages, without what a site repeats: element subtrees are hashed and counted by host.

A page becomes a list of text blocks and of subtrees. A subtree's hash is made of its tags, texts and its children's hashes,
without attributes. In Spark each host's subtrees are counted over its pages, pages of equal main text as one; a subtree that
stands on many of them is the site's template, and is deleted from the host's pages. What has marks of its own (navigation,
forms, adverts, comments and so on, by tag, role, class or id) goes from every page.

The main text is that of the article that holds most text, else of the ``main`` element, else of the body. Nothing outside
is kept. Inside the article, plain prose (paragraphs, headings, lists, tables, quotations) is no template even where it
recurs, as copies of articles share it; outside, and in the article's other containers, every subtree may be.

Defined cases: a null html is the empty text; a null URL, or one without a host, has no template; repeated rows give a row
each; broken markup is read as far as it goes: unclosed elements end with their parents, an unclosed comment, script or tag
swallows the rest of the page; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import ship, slices, staged

#: A subtree is a template if it stands on so many different pages of its host at least, and on such a share of them.
LEAST, SHARE = 5, 0.3

# Fixed values of HTML: elements without content, with text for content, with text that isn't shown, and those that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK = HEADINGS | frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption search".split())
#: Elements of prose, which inside an article are no template.
PROSE = HEADINGS | frozenset("p li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
#: An opening tag that ends an open one of these, up to the border named.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
#: Opening tags that end an open paragraph.
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption body html legend summary li dd dt".split()) | frozenset(["li", "dd", "dt"])

# What is no main text by tag, by role, and by a word of its class or id.
DROPPED = RAW | frozenset("head nav footer aside form dialog menu search template object embed svg math canvas audio video map select button input label datalist progress meter".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status note".split())
MARKS = frozenset(
    """nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager toc
    masthead topbar header footer sidebar sidebars aside rail widget widgets
    notice notices cookie cookies consent gdpr alert popup modal overlay paywall disclaimer
    ad ads adv advert adverts advertisement advertisements advertising adsbygoogle banner banners sponsor sponsored sponsors promo promos promotion promoted
    newsletter subscribe subscription signup login search searchbox form forms
    share sharing social related recommended recommendations outbrain taboola
    comment comments commentlist respond replies reply disqus discussion""".split()
)
MAINS = frozenset("content article post entry story main maincontent articlebody".split())
KEPT = frozenset("html body main".split())

_TAG = re.compile(r"""<(?:!--|(/?)([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>|[!?/][^>]*+>)""")
_OPENS = re.compile(r"<[A-Za-z/!?]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _marks(tag: str, raw: str) -> tuple[bool, int]:
    """Whether an element with these attributes is no main text, and whether it is the main one: 2 by tag or role, 1 by a name."""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if raw and not raw.isspace() else {}
    role = found.get("role", "").strip().lower()
    named = {w.lower() for k in ("class", "id") if k in found for w in _WORD.findall(found[k])}
    dropped = tag in DROPPED or (tag not in KEPT and (role in ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool(_HIDES.search(found.get("style", "")))))
    if not dropped and tag not in KEPT and tag not in HEADINGS and named & MARKS:
        dropped = True
    return dropped, 2 if role == "main" or tag == "main" else int(tag in ("div", "section", "td") and bool(named & MAINS))


class Page:
    """A page's elements in order of their opening (parents first), and its text in order: (element, text), or None at a break of line."""

    def __init__(self, html: str, hashed: bool) -> None:
        self.tags, self.parents, self.dropped, self.main, self.hashes = ["#page"], [-1], [False], [0], [0]
        self.flow: list[tuple[int, str] | None] = []
        self.hashed = hashed
        self._open, self._parts = [0], [[]]
        self._places: dict[str, list[int]] = defaultdict(list)  # where in the stack of open elements each tag stands
        self._blocks: list[int] = []  # where blocks stand
        self._read(html)
        while self._open:
            self._close()

    def _close(self) -> None:
        node, parts = self._open.pop(), self._parts.pop()
        if self._open:
            self._places[self.tags[node]].pop()
            if self.tags[node] in BLOCK:
                self._blocks.pop()
        if self.hashed and parts:
            self.hashes[node] = xxhash.xxh3_64_intdigest(f"{self.tags[node]}\0" + "\0".join(parts)) or 1
            if self._parts:
                self._parts[-1].append(f"\1{self.hashes[node]:x}")

    def _close_from(self, place: int) -> None:
        while len(self._open) > place:
            self._close()

    def _close_to(self, tags: set[str], borders: set[str]) -> None:
        """Ends the open elements of these tags, and all in them, that stand inside the innermost border."""
        border = max((self._places[b][-1] for b in borders if self._places[b]), default=0)
        places = [self._places[t][k] for t in tags if (k := bisect(self._places[t], border)) < len(self._places[t])]
        if places:
            self._close_from(min(places))

    def _text(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.flow.append((self._open[-1], text))
        if self.hashed and not text.isspace():
            self._parts[-1].append(" ".join(text.split()))

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">") + 1
        while at < last:
            m = _TAG.search(html, at, last)
            if m is None:
                break
            if m.start() > at:
                self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                if m[0] == "<!--":
                    at = html.find("-->", m.start() + 2)
                    if at < 0:
                        return
                    at += 3
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
                continue
            self._begin(tag, m[3])
            if tag in RAW and not (m[3].endswith("/") and tag not in ("script", "style")):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>", re.I).search(html, at)
                self._close()
                if end is None:
                    return
                at = end.end()
        rest = html[at:]
        cut = _OPENS.search(rest)  # an unclosed tag
        if rest[: cut.start()] if cut else rest:
            self._text(rest[: cut.start()] if cut else rest)

    def _begin(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.flow.append((self._open[-1], " "))
            return
        if tag in ENDS_P:
            self._end_paragraph()
        if tag in ENDS:
            self._close_to(*ENDS[tag])
        if tag in BLOCK:
            self.flow.append(None)
        if tag in VOID:
            return
        dropped, main = _marks(tag, attributes)
        self.tags.append(tag), self.parents.append(self._open[-1]), self.dropped.append(dropped), self.main.append(main), self.hashes.append(0)
        self._places[tag].append(len(self._open))
        if tag in BLOCK:
            self._blocks.append(len(self._open))
        self._open.append(len(self.tags) - 1)
        self._parts.append([])

    def _end_paragraph(self) -> None:
        """Ends an open paragraph that no table cell, list item or the like stands in."""
        if self._blocks and self.tags[self._open[self._blocks[-1]]] == "p":
            self._close_from(self._blocks[-1])

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flow.append(None)
        places = self._places[tag]
        # a stray end tag of an inline element doesn't end blocks
        if places and (tag in BLOCK or not self._blocks or places[-1] > self._blocks[-1]):
            self._close_from(places[-1])

    # ------------------------------------------------------------- what is main

    def scope(self) -> int:
        """The element that holds the main text; sets gone, what is dropped with its content."""
        n = len(self.tags)
        in_article = [False] * n
        self.gone = gone = [False] * n
        for i in range(1, n):
            up = self.parents[i]
            in_article[i] = in_article[up] or self.tags[i] in ("article", "main")
            gone[i] = gone[up] or self.dropped[i] or (self.tags[i] == "header" and not in_article[up])
        size = [0] * n
        for piece in self.flow:
            if piece is not None and not gone[piece[0]]:
                size[piece[0]] += len(piece[1])
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                size[self.parents[i]] += size[i]
        best = lambda found: max(found, key=lambda i: (size[i], -i), default=0)
        chosen = best(i for i in range(n) if self.tags[i] == "article" and not gone[i] and size[i])
        self.sure = chosen > 0
        if not chosen:  # what is only named so counts if it holds half of the text
            chosen = best(i for i in range(n) if self.main[i] == 2 and not gone[i] and size[i]) or best(i for i in range(n) if self.main[i] and not gone[i] and 2 * size[i] >= size[0] > 0)
            self.sure = chosen > 0
        return chosen or best(i for i in range(n) if self.tags[i] == "body")

    def inside(self, scope: int) -> list[bool]:
        held = [False] * len(self.tags)
        held[scope] = True
        for i in range(scope + 1, len(self.tags)):
            held[i] = held[self.parents[i]]
        return held

    def subtrees(self, scope: int, held: list[bool]) -> list[int]:
        """The elements that may be a template: blocks with text, but for those that hold the main text and the prose of an article."""
        above, i = set(), scope
        while i >= 0:
            above.add(i)
            i = self.parents[i]
        return [i for i in range(1, len(self.tags)) if self.hashes[i] and self.tags[i] in BLOCK and i not in above and not (held[i] and self.sure and self.tags[i] in PROSE)]

    def text(self, scope: int, held: list[bool], templates: frozenset[int] = frozenset()) -> str:
        gone = self.gone
        if templates:
            gone = list(gone)
            for i in self.subtrees(scope, held):
                gone[i] = gone[i] or self.hashes[i] in templates
            for i in range(1, len(self.tags)):
                gone[i] = gone[i] or gone[self.parents[i]]
        blocks: list[str] = []
        here: list[str] = []
        for piece in [*self.flow, None]:
            if piece is not None:
                if held[piece[0]] and not gone[piece[0]]:
                    here.append(piece[1])
            elif here:
                block = " ".join("".join(here).split())
                here = []
                if block:
                    blocks.append(block)
        return "\n\n".join(blocks)


def main_text(html: str | None, templates: frozenset[int] = frozenset()) -> str:
    """The main text of a page of a host with these templates."""
    page = Page(html or "", bool(templates))
    scope = page.scope()
    return page.text(scope, page.inside(scope), templates)


# ------------------------------------------------------------- Spark


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next slash, question mark or number sign, in lower case; empty where there is none."""
    host = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


SEEN = "host string, subtree long, main long"


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's different (host, subtree, main text); subtree 0 stands for the page itself."""
    for whole in batches:
        for batch in slices(whole, "html"):
            found = set()
            for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = Page(html or "", True)
                scope = page.scope()
                held = page.inside(scope)
                main = _signed(xxhash.xxh3_64_intdigest(page.text(scope, held)))
                found.add((host, 0, main))
                found.update((host, _signed(page.hashes[i]), main) for i in page.subtrees(scope, held))
            if found:
                hosts, subtrees, mains = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(subtrees, pa.int64()), pa.array(mains, pa.int64())], names=["host", "subtree", "main"])


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(host, templates): the hashes of subtrees that stand on many pages of a host.

    Pages of equal main text count once. A template stands on a share of its host's pages, so a host has no more of them
    than its average page has subtrees, over that share: a row holds no more than a page or two.
    """
    ship(pages.sparkSession)
    hosted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).filter("host != ''")
    seen = hosted.mapInArrow(_seen, SEEN).distinct()
    counted = staged(seen.groupBy("host", "subtree").agg(F.count("*").alias("pages")).filter((F.col("pages") >= least) | (F.col("subtree") == 0)), "html-subtrees")
    total = counted.filter("subtree = 0").select(F.col("host").alias("_host"), F.col("pages").alias("_pages"))
    many = counted.filter("subtree != 0").join(total, F.col("host") == F.col("_host")).filter(F.col("pages") >= F.col("_pages") * share)
    return many.groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = [main_text(html, frozenset(h % (1 << 64) for h in found or ())) for html, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:2], "text", "n_chars"])


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    The pages meet their host's templates in a join whose small side Spark broadcasts if its written size allows it, and
    which is dealt by host otherwise, where a host with very many pages is split as a skewed partition.
    """
    found = staged(templates(pages, url_col, html_col, least, share), "html-templates").withColumnRenamed("host", "_host")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("_of"))
    met = rows.join(found, F.col("_of") == F.col("_host"), "left").select("_id", "_url", "html", "templates")
    kind = dict(pages.dtypes)[id_col]
    return met.mapInArrow(_extracted, f"_id {kind}, _url string, text string, n_chars long").select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", "n_chars")
