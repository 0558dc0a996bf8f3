"""Main text of web pages by site style trees.

The pages of one host are merged into a tree: a node is the path of tags, classes and ids
that leads to an element, however often it repeats. Across the pages of the host a node
has a presentation importance, the entropy of the child sequences seen under it, and a
content importance, one minus the mean entropy of its texts: a text that many pages repeat
at the same node tells little, one that a single page has tells all. A branch is as
important as its most important node, and branches of low importance are cut from each
page. Nodes that fewer than ``MIN_PAGES`` pages of the host have are judged by the tree of
all hosts, at every size of host; nodes that as few pages of all hosts have stay.

Elements whose tag, role, class or id says what they are (menus, adverts, scripts ...) are
cut on every page; text inside ``article`` or ``main`` is preferred to text outside. A class
or id of several parts says so only if one part names such an element and all others are
words of layout: ``cookie-notice`` and ``footer-links`` are cut, ``share-price`` and
``side-effects`` are not. Should nothing be left, the low-importance branches stay.

A page is read once from start to end, at a cost in proportion to its length however broken
it is: a quote that is never closed is an ordinary character, and where quotes leave no end
for a tag they count no more from there on.

Defined results: null or empty html gives the empty text; a null url is the host "";
unclosed and stray tags are read much as browsers do; repeated pages each get their row; the
columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut, in_batches, marked

MIN_PAGES = 8
LOW = 0.3

# Kinds of HTML elements, and names that say what an element is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
CUT_TAGS = RAW | frozenset("head nav footer aside form button select option svg canvas object dialog menu audio video map label fieldset input datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote body center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
SAME_CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "tbody": "tbody thead tfoot tr td th", "tfoot": "tbody thead tfoot tr td th"}
SCOPE = frozenset("ul ol dl table html body article section div main nav footer aside header #root".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CUT_NAMES = frozenset(
    "ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs pagination pager "
    "sidebar side aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login "
    "comment comments commentlist respond reply replies disqus discussion share sharing social related recommended recommendations widget widgets search form copyright skip hidden tags".split()
)
LAYOUT = frozenset(
    "area bar block body bottom box button buttons container content global group heading holder icon icons inner item items layer left link links list "
    "main mobile module outer page panel primary region right row secondary section site slot sticky text title top unit wrap wrapper".split()
)
KEEP_TAGS = frozenset("html body article main #root".split())

_NAME = re.compile(r"/?[A-Za-z][^\s/>]*")
_END_OR_QUOTE = re.compile("[>\"']")
_PARTS = re.compile(r"[-_0-9]+")
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/=>]*)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")


def _says_cut(name: str) -> bool:
    """Whether a class or id says that its element is none of the article."""
    if name in CUT_NAMES:
        return True
    parts = {p for p in _PARTS.split(name) if p}
    return bool(parts & CUT_NAMES) and parts <= CUT_NAMES | LAYOUT


class _Tokens:
    """The markup of a page in order: (start, end, "/" or "", tag, attributes); the tag of a comment is empty."""

    def __init__(self, html: str):
        self.html, self.quotes, self.last = html, True, html.rfind(">")
        self.open_ended: set[str] = set()  # quotes that are not closed any more

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        html = self.html
        while (start := html.find("<", at)) >= 0:
            name = _NAME.match(html, start + 1)
            if name:
                end = self._end(name.end())
                if end < 0:
                    return None
                tag = name[0].lower()
                slash = tag[0] == "/"
                return start, end + 1, "/" if slash else "", tag[slash:], html[name.end():end]
            if html.startswith("<!--", start):
                end = html.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(html), "", "", ""
            if html[start + 1:start + 2] in ("!", "?", "/") and start < self.last:
                return start, html.find(">", start) + 1, "", "", ""
            at = start + 1
        return None

    def _end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, quoted ones left out; -1 if there is none."""
        place = at
        while self.quotes and (found := _END_OR_QUOTE.search(self.html, place)):
            place = found.end()
            if found[0] == ">":
                return found.start()
            if found[0] not in self.open_ended:
                closed = self.html.find(found[0], place)
                if closed < 0:
                    self.open_ended.add(found[0])
                else:
                    place = closed + 1
        self.quotes = False
        return self.html.find(">", at) if at <= self.last else -1


class Page:
    """Elements (parent, key, tag, whether cut, whether inside the main part) and texts (element, block, raw text)."""

    def __init__(self, html: str):
        self.parent, self.key, self.tag, self.cut, self.main = [-1], ["#root"], ["#root"], [False], [False]
        self.children: list[list[str]] = [[]]
        self.texts: list[tuple[int, int, str]] = []
        self.stack = [0]
        self.depths: dict[str, list[int]] = {"#root": [0]}  # where in the stack each tag is open
        self.scopes = [0]  # where tags of SCOPE are
        tokens, block, at = _Tokens(html), 0, 0
        while at < len(html):
            found = tokens.next(at)
            if found is None:
                self.texts.append((self.stack[-1], block, html[at:]))
                break
            start, end, closing, tag, attributes = found
            if start > at:
                self.texts.append((self.stack[-1], block, html[at:start]))
            at = end
            if not tag:
                continue
            if tag not in INLINE:
                block += 1
            if closing:
                depth = self.depths.get(tag) or [0]
                if depth[-1] > 0 and (tag in SCOPE or depth[-1] > self.scopes[-1]):
                    self._close_to(depth[-1])
                continue
            # an open paragraph, or an item or cell of the same list or row, ends
            ends = [*SAME_CLOSES.get(tag, "").split(), *(["p"] if tag in CLOSES_P else [])]
            depth = max((self.depths[t][-1] for t in ends if self.depths.get(t)), default=0)
            if depth > 0 and depth >= self.scopes[-1]:
                self._close_to(depth)
            self._open(self.stack, tag, attributes)
            self.depths.setdefault(tag, []).append(len(self.stack) - 1)
            if tag in SCOPE:
                self.scopes.append(len(self.stack) - 1)
            if tag in RAW:
                at = self._raw_end(html, tag, at)
                self._close_to(len(self.stack) - 1)
            elif tag in VOID:
                self._close_to(len(self.stack) - 1)

    @staticmethod
    def _raw_end(html: str, tag: str, at: int) -> int:
        closing = re.compile(rf"</{re.escape(tag)}\b", re.I).search(html, at)
        end = html.find(">", closing.end()) if closing else -1
        return end + 1 if end >= 0 else len(html)

    def _close_to(self, depth: int) -> None:
        """Close the elements from this depth of the stack on."""
        while len(self.stack) > depth:
            self.depths[self.tag[self.stack.pop()]].pop()
        while self.scopes[-1] >= depth:
            self.scopes.pop()

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        above = stack[-1]
        names: list[str] = []
        role, hidden = "", False
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                name = name.lower()
                if name == "hidden":
                    hidden = True
                elif name == "role":
                    role = value.strip("\"'").lower()
                elif name in ("class", "id"):
                    names += value.strip("\"'").lower().split()
        drop = tag in CUT_TAGS or hidden or role in CUT_ROLES or tag not in KEEP_TAGS and any(map(_says_cut, names)) or tag == "header" and not self.main[above]
        if tag == "article" and any("comment" in _PARTS.split(n) for n in names):
            drop = True
        self.parent.append(above)
        self.key.append(f"{tag}.{'.'.join(sorted(re.sub(r'[0-9]+', '0', n) for n in names))}")
        self.tag.append(tag)
        self.cut.append(self.cut[above] or drop)
        self.main.append(self.main[above] or tag in ("article", "main") or role == "main")
        if not self.children[above] or self.children[above][-1] != tag:
            self.children[above].append(tag)  # equal neighbours count once
        self.children.append([])
        stack.append(len(self.tag) - 1)

    def paths(self) -> list[int]:
        """The style node of each element: a hash of the keys that lead to it."""
        out: list[int] = []
        for parent, key in zip(self.parent, self.key, strict=True):
            out.append(_hash(f"{out[parent] if parent >= 0 else 0}/{key}"))
        return out

    def text(self, keep: list[bool] | None = None) -> str:
        """The text of the elements that are not cut (and are kept), blocks joined by a space."""
        for inside in ((True, False) if any(self.main) else (False,)):
            parts, last = [], None
            for element, block, raw in self.texts:
                if self.cut[element] or (inside and not self.main[element]) or (keep is not None and not keep[element]):
                    continue
                if last is not None and block != last:
                    parts.append(" ")
                parts.append(raw if "&" not in raw else entities.unescape(raw))
                last = block
            found = " ".join("".join(parts).split())
            if found:
                return found
        return ""


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def site_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


PRESENT, STYLE, CONTENT = 0, 1, 2


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, path, kind, feature): what each page adds to its site's tree, once per page."""
    for batch in batches:
        columns: tuple[list, list, list, list] = ([], [], [], [])
        for site, html in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            page = Page(html.as_py() or "")
            paths = page.paths()
            rows = {(p, PRESENT, 0) for p in paths}
            rows |= {(p, STYLE, _hash(" ".join(c))) for p, c in zip(paths, page.children, strict=True)}
            rows |= {(paths[e], CONTENT, _hash(" ".join(raw.split()))) for e, _, raw in page.texts if not raw.isspace()}
            for path, kind, feature in rows:
                for column, value in zip(columns, (site, path, kind, feature), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["site", "path", "kind", "feature"])


def _importance(features: DataFrame, *site: str) -> DataFrame:
    """(site, path, pages, importance) from how many pages (f) have each feature."""
    f = F.col("f")

    def over(kind: int, value: Column) -> Column:
        return F.sum(F.when(F.col("kind") == kind, value))

    nodes = features.groupBy(*site, "path").agg(
        over(PRESENT, f).alias("pages"), over(STYLE, f).alias("styles"), over(STYLE, f * F.log(f)).alias("style_logs"),
        over(CONTENT, f).alias("texts"), over(CONTENT, f * F.log(f)).alias("text_logs"),
    )
    base = F.log(F.col("pages"))
    style = (F.log("styles") - F.col("style_logs") / F.col("styles")) / base
    content = 1 - F.col("text_logs") / F.col("texts") / base
    return nodes.where(F.col("pages") >= MIN_PAGES).select(*site, "path", "pages", F.greatest(F.coalesce(content, F.lit(0.0)), 0.5 * F.coalesce(style, F.lit(0.0))).alias("importance"))


def low_nodes(pages: DataFrame) -> DataFrame:
    """(node, path): the nodes of every site that are of low importance; node is a hash of site and path.

    A node is judged by its site's tree where ``MIN_PAGES`` pages of the site have it, else by
    the tree of all sites where as many pages have it, else it is important.
    """
    counted = cut(pages.select("site", "html").mapInArrow(_features, "site string, path long, kind int, feature long").groupBy("site", "path", "kind", "feature").agg(F.count("*").alias("f")))
    low = F.col("importance") < LOW
    own = _importance(counted, "site").where(low).select("site", "path")
    every = counted.groupBy("path", "kind", "feature").agg(F.sum("f").alias("f"))
    common = _importance(every).where(low).select("path")
    thin = counted.where(F.col("kind") == PRESENT).where(F.col("f") < MIN_PAGES).select("site", "path")  # one row of this kind per site and path
    return own.union(thin.join(common, "path").select("site", "path")).select(_node(F.col("site"), F.col("path")).alias("node"), "path")


def _node(site: Column, path: Column) -> Column:
    return F.xxhash64(site, path)


def _page_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, again, site, path): the distinct style nodes of each page."""
    for batch in batches:
        found = [np.unique(np.array(Page(html.as_py() or "").paths(), np.int64)) for html in batch.column(3)]
        rows = pa.array(np.repeat(np.arange(len(found)), [len(p) for p in found]))
        path = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(rows) for i in range(3)), path], names=["key", "again", "site", "path"])


def low_paths(rows: DataFrame) -> DataFrame:
    """(key, again, low): the low nodes of each page that has any; only equal rows share a key.

    Only nodes that are likely low leave their task; what is gathered for a page is at most its own nodes.
    """
    low = cut(low_nodes(rows))
    each = rows.select("key", "again", "site", "html").mapInArrow(_page_paths, "key long, again long, site string, path long")
    each = each.select("key", "again", _node(F.col("site"), F.col("path")).alias("node"), "path")
    likely = marked(each, "node", low.select("node")).where("_marked").select("key", "again", "node", "path")
    return likely.join(low, ["node", "path"], "left_semi").groupBy("key", "again").agg(F.collect_set("path").alias("low"))


def _kept(page: Page, low: frozenset[int]) -> list[bool]:
    """Which elements stay: those with a node that is not low in or below them, or above them nothing cut."""
    best = [p not in low for p in page.paths()]
    for element in range(len(best) - 1, 0, -1):
        above = page.parent[element]
        best[above] = best[above] or best[element]
    keep = [True] * len(best)
    for element in range(1, len(best)):
        keep[element] = keep[page.parent[element]] and best[element]
    return keep


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row."""
    rows = in_batches(pages).select("page_id", "url", site_of(F.col("url")).alias("site"), "html")
    # two hashes of the row: its low nodes depend on no more, and copies under other ids are no hot key
    rows = rows.withColumns({"key": F.xxhash64("page_id", "url", "html"), "again": F.xxhash64("html", F.length("html"), "url")})
    joined = rows.join(low_paths(rows), ["key", "again"], "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for html, low in zip(batch.column(2), batch.column(3), strict=True):
                page = Page(html.as_py() or "")
                found.append(page.text(_kept(page, frozenset(low.as_py() or ()))) or page.text())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])

    types = dict(pages.dtypes)
    return joined.select("page_id", "url", "html", "low").mapInArrow(task, f"page_id {types['page_id']}, url string, text string")
