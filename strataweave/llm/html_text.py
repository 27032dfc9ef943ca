"""Main text of web pages by differencing pages of nearby URLs.

Within each host, pages are ordered by URL path; each page is paired with the
neighbour whose path shares the longer prefix with its own. The text lines
(blocks) of the two are aligned by longest common subsequence, and lines that
both have are template, not text, and are deleted. This is done for every page.

Differencing alone can't tell a menu that differs from page to page from text,
nor a passage that two articles share from template. So markup is the check of
what differencing found, line by line (kept): elements that are never text
(menus, forms, scripts, comment sections, ...) take no part, shared or not; a
shared line in an article or main element comes back; a line of the page's own
outside its article goes. On pages without such an element the difference
stands. A page without a line of its own against its neighbour, or whose
neighbour has none, is taken for a copy, and nothing is deleted; a page without
article is aligned with its neighbour's lines outside articles, any other with
all of them. What follows an element without an end belongs to it, as in browsers.

Names mislead, so they are judged once a page is read. A class or id counts
only as a whole word ("nav-collapsed" is no menu), and not for an element that
holds more than half of a page's text while no article stands outside. An
element that holds the page's only article, with more than half of its text,
is no menu either, whatever its name. Articles that hold little of a page
(teasers beside a story that is in none) aren't its main text.

A page's time grows with its length, however its tags are nested.

The order is global and distributed: pages are range-partitioned by host and
path, so no host has to fit in one task; the first and last page of a partition
also visit the partition beside theirs. Only hashes of lines are ordered and
paired. Pages are parsed twice, for the hashes and for the text that meets its
neighbour's hashes, as storing texts and shuffling them takes more disk.

Defined results: null html or html without text gives an empty string; a null
url takes part as an empty one; repeated rows get the same text; an empty
table gives no rows. Other columns, whatever their names, take no part.
"""

from __future__ import annotations

import bisect
import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataweave.llm.tables import stored

# Element and attribute names of the HTML standard, and common class words.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</[^>]*>|<[!?][^>]*>|[^<]+|<", re.S)
NAME = re.compile(r"</?\s*([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+)""")
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NOT_TEXT = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "object", "canvas", "video", "audio", "map", "math"}
MAIN = {"article", "main"}
WHOLE = {"html", "body", "article", "main"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main",
    "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
ENDS_ITSELF = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "p": {"div", "section", "article", "body"}, "option": {"select"}}
CLASS_NAMES = {
    "nav", "navbar", "navigation", "main-nav", "site-nav", "nav-menu", "menu", "header", "site-header", "masthead", "footer", "site-footer", "page-footer",
    "sidebar", "side-bar", "aside", "ad", "ads", "advert", "adverts", "advertisement", "ad-banner", "ad-slot", "ad-container", "banner", "promo", "promotion",
    "sponsor", "sponsored", "cookie", "cookies", "cookie-notice", "cookie-banner", "cookie-consent", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "newsletter", "newsletter-signup", "subscribe", "subscription", "signup", "share", "share-buttons", "sharing", "social", "social-links", "social-share",
    "related", "related-posts", "related-articles", "recommended", "breadcrumb", "breadcrumbs", "pagination", "pager", "comment", "comments", "comment-list",
    "comment-section", "comments-area", "respond", "disqus", "disqus_thread", "widget", "toolbar", "login", "search", "search-form", "skip", "skip-link", "copyright", "disclaimer",
}
CONTENT_NAMES = {"content", "main", "article", "main-content", "article-body", "article-content", "post-content", "post-body", "entry-content", "articlebody"}
#: Matching pairs of places for each line from which two pages are aligned by bit vectors.
PAIRS_A_LINE = 32
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}


@dataclass
class Doubtful:
    """An element that may be no text, within another such (by number; 0 is the page)."""

    outer: int
    by_name: bool  # by class or id, or as a form; else by what HTML says of its tag or role
    size: int = 0  # characters inside


@dataclass
class Candidate:
    """An element that may hold the main text; doubtful is the innermost such element around it."""

    doubtful: int
    sure: bool  # a main element, of which a page has one
    size: int = 0  # characters inside, without doubtful elements'


def _marks(name: str, text: str, inside: bool) -> tuple[bool, Doubtful | None, Candidate | None]:
    """Whether an element is hidden, whether it may be no text, and whether it may be the main text, by its start tag."""
    maybe = Doubtful(0, name == "form") if name in NOT_TEXT and not (name == "header" and inside) else None  # an article's own header holds its title
    main = Candidate(0, name == "main") if name in MAIN else None
    if name in WHOLE or "=" not in text and "hidden" not in text:
        return name == "head", maybe, main
    found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(text)}
    if name == "head" or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")) or re.search(r"\shidden(?:[\s>/]|\Z)", ATTRIBUTE.sub(" ", text).lower()):
        return True, None, None
    if found.get("role") in ROLES:
        return False, maybe or Doubtful(0, False), None
    names = {*found.get("class", "").split(), found.get("id", "")}
    if found.get("role") == "main" or not CONTENT_NAMES.isdisjoint({*names, found.get("itemprop", "")}):
        return False, maybe, Candidate(0, found.get("role") == "main")
    return False, maybe or (None if CLASS_NAMES.isdisjoint(names) else Doubtful(0, True)), main


class Page:
    """One pass over a page's tags: its lines as pieces (text, doubtful element, main candidate)."""

    def __init__(self, page: str) -> None:
        self.lines: list[list[tuple[str, int, int]]] = []
        self.doubtful = [Doubtful(0, False)]
        self.mains = [Candidate(0, False)]
        self.line: list[tuple[str, int, int]] = []
        self.stack: list[tuple[str, int, int, int]] = []  # name, depth of hidden elements, doubtful element, main candidate
        self.open: dict[str, list[int]] = {}  # where in the stack elements of a name are
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self.line:
            self.lines.append(self.line)
            self.line = []

    def _back(self, to: int) -> None:
        for name, *_ in self.stack[to:]:
            self.open[name].pop()
        del self.stack[to:]

    def _last(self, name: str) -> int:
        return self.open[name][-1] if self.open.get(name) else -1

    def _text(self, text: str) -> None:
        _, hidden, doubtful, main = self.stack[-1] if self.stack else ("", 0, 0, 0)
        if not hidden:
            self.line.append((entities.unescape(text) if "&" in text else text, doubtful, main))

    def _start(self, name: str, text: str) -> None:
        if name in ENDS_ITSELF:
            at = self._last(name)
            if at > max(map(self._last, ENDS_ITSELF[name])):
                self._back(at)
        elif name in BLOCK and self.stack and self.stack[-1][0] == "p":
            self._back(len(self.stack) - 1)
        _, hidden, doubtful, main = self.stack[-1] if self.stack else ("", 0, 0, 0)
        closed, maybe, candidate = _marks(name, text, main > 0)
        if maybe is not None:
            maybe.outer = doubtful
            doubtful = len(self.doubtful)
            self.doubtful.append(maybe)
        if candidate is not None and not main:
            candidate.doubtful = doubtful
            main = len(self.mains)
            self.mains.append(candidate)
        self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, hidden + closed, doubtful, main))

    def _read(self, page: str) -> None:
        scan, at, end, last = TOKEN.match, 0, len(page), page.rfind(">")
        while at < end:
            opens = page[at] == "<" and page[at + 1 : at + 2].isalpha() or page[at : at + 2] in ("</", "<!", "<?")
            if opens and at > last:  # the page breaks off within a tag
                break
            text = scan(page, at).group()
            if opens and len(text) == 1:
                text = page[at : page.index(">", at) + 1]
            at += len(text)
            if not opens:
                self._text(text)
                continue
            named = NAME.match(text)
            if not named:
                if not (text.startswith("</") or text[1] in "!?"):
                    self._text(text)
                continue
            name = named.group(1).lower()
            if name in BLOCK:
                self._flush()
            if text[1] == "/":
                if self._last(name) >= 0:
                    self._back(self._last(name))
            elif name in RAW and not text.endswith("/>"):
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else end
            elif name not in VOID and not (text.endswith("/>") and name not in BLOCK):
                self._start(name, text)

    def marked(self) -> list[tuple[str, bool]]:
        """The blocks that may be text, in page order, each with whether it is in an article or main element."""
        sizes = [[(len(t.strip()), d, m) for t, d, m in line] for line in self.lines]
        total = 0
        for n, doubtful, main in (x for line in sizes for x in line):
            total += n
            self.doubtful[doubtful].size += n
            if main and doubtful == self.mains[main].doubtful:
                self.mains[main].size += n
        for one in reversed(self.doubtful[1:]):
            self.doubtful[one.outer].size += one.size
        chosen = [m for m in range(1, len(self.mains)) if self.mains[m].size and not self.mains[m].doubtful]
        text_after_all: set[int] = set()
        if not chosen:
            m = max(range(len(self.mains)), key=lambda m: self.mains[m].size)
            if m and 2 * self.mains[m].size > total:
                chosen, at = [m], self.mains[m].doubtful
                while at:
                    text_after_all.add(at)
                    at = self.doubtful[at].outer
            else:
                text_after_all = {i for i, x in enumerate(self.doubtful) if x.by_name and 2 * x.size > total}
        no_text = [False] * len(self.doubtful)
        for i, one in enumerate(self.doubtful):
            no_text[i] = i > 0 and (no_text[one.outer] or i not in text_after_all)
        left = sum(n for line in sizes for n, doubtful, _ in line if not no_text[doubtful])
        held = sum(self.mains[m].size for m in chosen)
        if not any(self.mains[m].sure for m in chosen) and (4 if len(chosen) == 1 else 2) * held < left:
            chosen = []
        wanted, found = {*chosen}, []
        for line in self.lines:
            kept = [x for x in line if not no_text[x[1]]]
            joined = " ".join("".join(x[0] for x in kept).split())
            if joined:
                found.append((joined, any(x[2] in wanted for x in kept)))
        return found


def blocks(page: str) -> tuple[list[str], list[str]]:
    """The blocks inside article or main elements, and the others that may be text."""
    marked = Page(page).marked()
    return [x for x, inside in marked if inside], [x for x, inside in marked if not inside]


def common(a: list[int], b: list[int]) -> set[int]:
    """Places of a in a longest common subsequence of a and b (Hunt and Szymanski;
    by bit vectors where lines repeat so often that most pairs of places match)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    found = {*range(lo), *range(len(a) - hi, len(a))}
    places: dict[int, list[int]] = {}
    for j in range(len(b) - hi - 1, lo - 1, -1):
        places.setdefault(b[j], []).append(j)
    if sum(len(places.get(x, ())) for x in a[lo : len(a) - hi]) > PAIRS_A_LINE * (len(a) + len(b)):
        return found | {lo + i for i in common_by_bits(a[lo : len(a) - hi], b[lo : len(b) - hi])}
    ends: list[int] = []
    chains: list[tuple | None] = []
    for i in range(lo, len(a) - hi):
        for j in places.get(a[i], ()):
            k = bisect.bisect_left(ends, j)
            chain = (i, chains[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chains.append(chain)
            else:
                ends[k], chains[k] = j, chain
    link = chains[-1] if chains else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def common_by_bits(a: list[int], b: list[int]) -> set[int]:
    """As common(): a row of the table of lengths is a number whose bit j is 0 where the length grows at b[j].

    Every step-th row is held, those between are made again on the way back.
    """
    at: dict[int, int] = {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    full, step = (1 << len(b)) - 1, math.isqrt(len(a)) + 1

    def rows(row: int, part: list[int]) -> Iterator[int]:
        for x in part:
            both = row & at.get(x, 0)
            row = ((row + both) | (row - both)) & full
            yield row

    held = [full]
    for lo in range(0, len(a), step):
        *_, last = rows(held[-1], a[lo : lo + step])
        held.append(last)
    found, j = set(), len(b)
    for lo in range((len(a) - 1) // step * step, -1, -step):
        table = [held[lo // step], *rows(held[lo // step], a[lo : lo + step])]
        i = len(table) - 1
        while i and j:
            if table[i] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if table[i] >> (j - 1) & 1:
                    found.add(lo + i)
                    j -= 1
    return found


def line_hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - 2**64 if h >= 2**63 else h


def template(own: list[int], twin: list[int]) -> set[int]:
    """Places of own, a page's line hashes, that its neighbour has too."""
    shared = common(own, twin)
    return set() if len(shared) in (len(own), len(twin)) else shared  # copies, or one a part of the other


def differenced(lines: list[str], twin: list[int] | None) -> list[str]:
    """The lines that a page has of its own, given the line hashes of its neighbour."""
    shared = template([line_hash(x) for x in lines], twin or [])
    return [x for i, x in enumerate(lines) if i not in shared]


def kept(marked: list[tuple[str, bool]], twin: list[int], twin_inside: list[bool]) -> list[str]:
    """The lines of the main text: those of the page's own, as markup corrects them.

    marked: as Page.marked() gives them; twin and twin_inside: the neighbour's
    line hashes, and whether each is in an article or main element.
    """
    article = any(inside for _, inside in marked)
    met = [h for h, inside in zip(twin, twin_inside, strict=True) if article or not inside]
    shared = template([line_hash(x) for x, _ in marked], met)
    return [x for i, (x, inside) in enumerate(marked) if inside or (i not in shared and not article)]


def text_of(page: str, twin: list[int] | None) -> str:
    """The page's text, given the line hashes of its neighbour, none of them in an article."""
    twin = twin or []
    return " ".join(kept(Page(page).marked(), twin, [False] * len(twin)))


def parsed(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", hashes: bool = False) -> DataFrame:
    """id, url, host, path, key (a hash of the row), lines (the blocks that may be
    text, or their hashes), inside (whether each is in an article or main element)."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://"
    target = F.coalesce(F.col(url), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url).alias("url"), F.lower(F.regexp_extract(target, scheme + "([^/?#]*)", 1)).alias("host"), F.regexp_replace(target, scheme + "[^/?#]*", "").alias("path"),
        F.xxhash64(F.col(id_col), F.col(url), F.col(html)).alias("key"), F.coalesce(F.col(html), F.lit("")).alias("html"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = [Page(page.as_py()).marked() for page in batch.column("html")]
            lines = pa.array([[line_hash(x) if hashes else x for x, _ in page] for page in marked], pa.list_(pa.int64() if hashes else pa.string()))
            inside = pa.array([[m for _, m in page] for page in marked], pa.list_(pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], lines, inside], names=["id", "url", "host", "path", "key", "lines", "inside"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, url string, host string, path string, key bigint, lines array<{'bigint' if hashes else 'string'}>, inside array<boolean>")


def neighbours(rows: DataFrame) -> DataFrame:
    """key, twin and twin_inside for every page: the line hashes of the paired page, null without one.

    rows: as parsed() gives them with hashes. Rows of one key are one page.
    """
    order = ["host", "path", "key"]
    slim = stored(rows.select(*order, "lines", "inside"), "page-hashes")
    # A key's rows have one host and path, so they are in one partition already.
    ranged = slim.repartitionByRange(*order).dropDuplicates(order).sortWithinPartitions(*order)
    placed = stored(ranged.withColumn("n", F.monotonically_increasing_id()), "page-lines").withColumn("part", F.shiftright("n", 33))
    ends = placed.groupBy("part").agg(F.min("n").alias("first"), F.max("n").alias("last")).orderBy("part").collect()  # a row a partition
    guests = [(n, part) for a, b in zip(ends, ends[1:], strict=False) for n, part in ((a["last"], b["part"]), (b["first"], a["part"]))]
    visits = rows.sparkSession.createDataFrame(guests, "n bigint, visited bigint")
    visiting = placed.join(F.broadcast(visits), "n").withColumn("part", F.col("visited")).select(*placed.columns, F.lit(True).alias("guest"))
    both = placed.withColumn("guest", F.lit(False)).unionByName(visiting)
    by_place = Window.partitionBy("part").orderBy("n")
    page = F.struct("host", "path", "lines", "inside")
    beside = both.select("key", "host", "path", "guest", F.lag(page).over(by_place).alias("before"), F.lead(page).over(by_place).alias("after")).filter("not guest")

    def agree(their: Column) -> Column:
        """How far the paths agree: the first place where they differ; null on another host."""
        at = F.array_position(F.zip_with(F.split("path", ""), F.split(their["path"], ""), lambda x, y: x.eqNullSafe(y)), False)
        return F.when(their["host"] == F.col("host"), F.coalesce(F.nullif(at, F.lit(0)), F.lit(2**31 - 1)))

    known = beside.withColumns({"a": agree(F.col("before")), "b": agree(F.col("after"))})
    twin = F.when(F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b") > F.col("a"))), F.col("after")).when(F.col("a").isNotNull(), F.col("before"))
    return known.select("key", twin.alias("t")).select("key", F.col("t.lines").alias("twin"), F.col("t.inside").alias("twin_inside"))


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """id, url, text and n_chars for every row of pages."""
    twins = neighbours(parsed(pages, id_col, url, html, hashes=True))
    met = parsed(pages, id_col, url, html).select("id", "url", "key", "lines", "inside").join(twins.hint("merge"), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("lines", "inside", "twin", "twin_inside")), strict=True)
            out = [" ".join(kept([*zip(lines, inside, strict=True)], twin or [], twin_inside or [])) for lines, inside, twin, twin_inside in rows]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(out, pa.string())], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    made = met.select("id", "url", "lines", "inside", "twin", "twin_inside").mapInArrow(run, f"id {kind}, url string, text string")
    return made.select(F.col("id").alias(id_col), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
