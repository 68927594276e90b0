"""Main text of web pages by paths that a host's pages agree on.

Every page's containers are scored by the text they hold, and the page votes for
the generalised path (tags with their classes, digits left out) of the one that
holds its article. Votes are summed by host. The text is then taken from the
containers on the host's winning paths, with all that stands inside them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom import scratch
from linkloom.llm import arrow

#: A quote opens a string only after an equals sign. Nothing is read twice: what isn't closed goes on to the end.
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)(>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption option select".split())
_CONTAINERS = frozenset("html body main article section div td center blockquote".split())
_CLOSES = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
_SCOPES = frozenset("table ul ol dl div section article main body td th aside nav form blockquote header footer".split())
_DROPPED_TAGS = frozenset("nav footer aside form button select menu dialog template svg math canvas object audio video head".split())
#: What a class, id or role with one of these words names is not the article, unless it holds the article.
_DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent copyright disqus footer footnav gdpr login masthead menu menubar modal nav navbar navigation newsletter notice notices notification pager pagination paywall popup promo promoted promotion replies reply respond share sharing shares sidebar sidebars signup skip social sponsor sponsored subscribe subscription".split()
)
#: The same for what stands outside an article.
_HEADER_WORDS = frozenset(["header"])
#: A class or id that has one of these words says how a page is laid out, not what the element is.
_LAYOUT_WORDS = frozenset("has no not with without is open closed enabled disabled on off".split())
#: Words that sections of an article have in their names, too: these drop an element only if half of its text is links.
_LINKED_WORDS = frozenset("dialog form overlay recommended related search".split())
#: A path wins on a host if it has this share of the host's votes, or more.
WINNING_SHARE = 0.001
#: Shares of a page's text: what its article holds at least, and what a path of the host must hold to be taken for it.
MOST, HALF = 0.8, 0.5
#: Stands for all article and main elements of a page in place of a path.
ARTICLES = "//"
_SHELL = ("", "html", "body")
#: Characters of a path, and of one component, that are written out; what comes before is a hash.
PATH_CHARS, NAME_CHARS = 300, 80
#: Longer attributes aren't remembered.
_REMEMBERED = 1000
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for tag in _RAW}


def _words(found: dict[str, str]) -> set[str]:
    """Words of the classes, id, role and label that say what an element is."""
    out: set[str] = set()
    for token in (t for a in ("class", "id", "role", "aria-label") for t in found.get(a, "").split()):
        words = {w.lower() for w in _WORD.findall(token)}
        if not words & _LAYOUT_WORDS:
            out |= words
    return out


class _Element(NamedTuple):
    """What a start tag says: its path component, and whether it is dropped anywhere, outside an article, or for its words."""

    name: str
    dropped: bool
    outside: bool
    by_word: bool
    outside_by_word: bool
    if_linked: bool


def _element(tag: str, attributes: str) -> _Element:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    body = tag in ("html", "body", "main", "article")
    words = _words(found) if found and not body else set()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    name = ".".join([tag, *sorted({_DIGITS.sub("", c) for c in found.get("class", "").split()} - {""})])
    if len(name) > NAME_CHARS:
        name = f"{tag}.#{xxhash.xxh3_64_hexdigest(name)}"
    return _Element(name, tag in _DROPPED_TAGS or hidden, tag == "header", bool(words & _DROPPED_WORDS), bool(words & _HEADER_WORDS), bool(words & _LINKED_WORDS))


_remembered = lru_cache(maxsize=4096)(_element)


def _path(outer: str, name: str) -> str:
    """The path of a container inside another; as long as ``PATH_CHARS`` at most, and different for different paths."""
    if len(outer) + len(name) >= PATH_CHARS:
        outer = f"#{xxhash.xxh3_64_hexdigest(outer)}"
    return f"{outer}>{name}" if outer else name


class _Open(NamedTuple):
    tag: str
    dropped: bool
    named: int
    container: int
    article: bool
    link: bool


class _Stack:
    """Open elements, with where each tag and each scope is, so that no search reads the stack."""

    def __init__(self) -> None:
        self.open = [_Open("", False, 0, 0, False, False)]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.scopes: list[int] = []

    def push(self, x: _Open) -> None:
        self.at[x.tag].append(len(self.open))
        if x.tag in _SCOPES:
            self.scopes.append(len(self.open))
        self.open.append(x)

    def cut(self, k: int) -> None:
        while len(self.open) > k:
            tag = self.open.pop().tag
            self.at[tag].pop()
            if tag in _SCOPES:
                self.scopes.pop()

    def end(self, tag: str) -> None:
        """An end tag closes the last element of its name; one of no block doesn't reach out of the scope it is in."""
        places = self.at.get(tag)
        if places and (tag in _BLOCKS or not self.scopes or places[-1] >= self.scopes[-1]):
            self.cut(places[-1])

    def block(self, tag: str) -> None:
        """The start tag of a block closes a paragraph, and what it follows in a list or a table, in the same scope."""
        closes = _CLOSES.get(tag, frozenset())
        j = len(self.scopes) - 1
        while j >= 0 and self.open[self.scopes[j]].tag in closes:
            j -= 1
        scope = self.scopes[j] if j >= 0 else 0
        if not closes:
            if (places := self.at.get("p")) and places[-1] > scope:
                self.cut(places[-1])
            return
        lowest = []
        for t in ("p", *closes):
            places = self.at.get(t, [])
            if (k := bisect_right(places, scope)) < len(places):
                lowest.append(places[k])
        if lowest:
            self.cut(min(lowest))


class Container(NamedTuple):
    path: str
    outer: int
    tag: str
    article: bool


class Page(NamedTuple):
    """Containers, outer ones first, with the number of the one around each; and ``(container, text, characters in links)`` of each block."""

    containers: list[Container]
    blocks: list[tuple[int, str, int]]


class _Named:
    """Elements that their words would drop, by the number of the one around each; the first is the page."""

    def __init__(self) -> None:
        self.outer, self.if_linked = [-1], [False]
        self.articles, self.sizes, self.linked = [0], [0], [0]

    def add(self, outer: int, if_linked: bool) -> int:
        for column, x in zip((self.outer, self.if_linked, self.articles, self.sizes, self.linked), (outer, if_linked, 0, 0, 0)):
            column.append(x)
        return len(self.outer) - 1

    def kept(self) -> list[bool]:
        """Whether what stands in each is kept.

        One that holds an article or most of the unlinked text is kept unless an
        article stands outside; one whose words only matter among links, unless
        half of its text is in them.
        """
        articles, sizes, linked = self.articles.copy(), self.sizes.copy(), self.linked.copy()
        for k in range(len(sizes) - 1, 0, -1):
            articles[self.outer[k]] += articles[k]
            sizes[self.outer[k]] += sizes[k]
            if self.if_linked[k] and linked[k] < sizes[k]:  # the links of what is dropped say nothing of what is around
                linked[self.outer[k]] += linked[k]
        kept, free = [True], self.articles[0] > 0
        for k in range(1, len(sizes)):
            holds = not free and (articles[k] > 0 or 2 * sizes[k] > sizes[0])
            kept.append(kept[self.outer[k]] and (holds or (self.if_linked[k] and linked[k] < sizes[k])))
            free = free or (kept[k] and self.articles[k] > 0)
        return kept


def blocks(html: str) -> Page:
    """Every block that isn't menu, notice or the like, in page order, and the containers that they stand in.

    Inside an article or main element, that element is the container; elsewhere
    it is the nearest element that can hold an article. Elements that their words
    would drop are judged at the end, by what they hold. Time is in proportion to
    the page, however it is nested or malformed; a tag that never ends is markup.
    """
    #: Containers, and pieces of text with the element that may drop each and whether it is in a link.
    out: list[tuple[int, list[tuple[str, int, bool]]]] = []
    named, stack = _Named(), _Stack()
    containers = [Container("", -1, "", False)]
    text: list[tuple[str, int, bool]] = []
    where = 0

    def flush() -> None:
        nonlocal text
        if text:
            out.append((where, text))
            text = []

    def add(piece: str) -> None:
        nonlocal where
        top = stack.open[-1]
        if piece and not top.dropped:
            piece = unescape(piece) if "&" in piece else piece
            if top.container != where:
                flush()
                where = top.container
            text.append((piece, top.named, top.link))
            (named.linked if top.link else named.sizes)[top.named] += len("".join(piece.split()))

    position, end = 0, len(html)
    while position < end:
        m = _TAG.search(html, position)
        if m is None:
            add(html[position:])
            break
        add(html[position : m.start()])
        position = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in _BLOCKS:
                flush()
            stack.end(tag)
            continue
        if tag == "br" or tag == "hr":
            add(" ")
        if tag in _BLOCKS:
            flush()
            stack.block(tag)
        if tag in _RAW:
            close = _RAW_END[tag].search(html, position)
            position = close.end() if close else end
            continue
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCKS:
            continue
        says = (_remembered if len(m[3]) <= _REMEMBERED else _element)(tag, m[3])
        top = stack.open[-1]
        dropped = top.dropped or says.dropped or (says.outside and not top.article)
        inner, container, article = top.named, top.container, top.article
        by_word = says.by_word or (says.outside_by_word and not top.article)
        if not dropped and (by_word or says.if_linked):
            inner = named.add(inner, not by_word)
        if tag in _CONTAINERS:
            if not dropped and tag in ("article", "main"):
                named.articles[inner] += 1
            article = article or tag in ("article", "main")
            if not top.article or tag == "article":
                containers.append(Container(_path(containers[container].path, says.name), container, tag, article))
                container = len(containers) - 1
        stack.push(_Open(tag, dropped, inner, container, article, top.link or tag == "a"))
    flush()
    kept = named.kept()
    found = []
    for container, pieces in out:
        pieces = [x for x in pieces if kept[x[1]]]
        if joined := " ".join("".join(piece for piece, _, _ in pieces).split()):
            found.append((container, joined, sum(len(piece) for piece, _, link in pieces if link)))
    return Page(containers, found)


class Shares:
    """Each container's share of the page's text, with all inside it, and the shares summed by path.

    Text in links doesn't count, that of articles counts twice. The path of the
    whole page is empty; ``ARTICLES`` stands for all its article elements.
    """

    def __init__(self, page: Page) -> None:
        n = len(page.containers)
        own = [0.0] * n
        for container, text, links in page.blocks:
            own[container] += max(0, len(text) - 2 * links) * (2.0 if page.containers[container].article else 1.0)
        for k in range(n - 1, 0, -1):
            own[page.containers[k].outer] += own[k]
        self.shares = [x / own[0] for x in own] if own[0] else []
        self.by_path: dict[str, float] = defaultdict(float)
        self.articles, self.outermost = [], []
        for k, (c, share) in enumerate(zip(page.containers, self.shares)):
            outer = page.containers[c.outer] if k else c
            if k:
                self.by_path[c.path] += share
            if c.article and not outer.article:
                self.articles.append(c.path)
                self.by_path[ARTICLES] += share
            elif k and c.tag not in _SHELL and outer.tag in _SHELL:
                self.outermost.append(c.path)
        self.by_path[""] = 1.0

    def article(self) -> str:
        """The path that holds the article, as far as the page alone tells.

        One path of article elements or all of them, else an outermost container
        below body, else the whole page: what else there is must be little.
        """
        if (best := max(self.articles, key=self.by_path.get, default=None)) and self.by_path[best] >= MOST:
            return best
        if self.by_path.get(ARTICLES, 0.0) >= HALF:
            return ARTICLES
        best = max(self.outermost, key=self.by_path.get, default="")
        return best if self.by_path.get(best, 0.0) >= MOST else ""


def vote(page: Page) -> tuple[str, float] | None:
    """The path that holds the page's article, and its share; nothing for a page without text."""
    shares = Shares(page)
    return (best := shares.article(), shares.by_path[best]) if shares.shares else None


def main_text(page: Page, winners: list[str]) -> str:
    """All blocks in the first of the host's winning paths that holds half of the page's text, else in the page's own.

    Where nothing counts, all blocks.
    """
    shares = Shares(page)
    if not shares.shares:
        return " ".join(text for _, text, _ in page.blocks)
    best = next((p for p in winners if shares.by_path.get(p, 0.0) >= HALF), None)
    best = shares.article() if best is None else best
    inside: list[bool] = []
    for c in page.containers:
        inside.append(c.path == best or (best == ARTICLES and c.article) or (c.outer >= 0 and inside[c.outer]))
    return " ".join(text for container, text, _ in page.blocks if inside[container])


def host_column(url_col: str):
    """The url's host in lower case; empty if it has none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url_col).cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, paths``: each host's winning paths by summed votes, best first, ties by name.

    Votes are summed in each slice before they are shuffled, so a hot host sends
    a few rows a slice. A path wins with ``WINNING_SHARE`` of the host's votes,
    so a host has 1 / ``WINNING_SHARE`` of them at most.
    """
    rows = pages.select(host_column(url_col).alias("host"), F.col(html_col).cast("string").alias("html"))

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        sums: dict[tuple[str, str], float] = defaultdict(float)
        for host, html in zip(arrow.col(batch, "host").to_pylist(), arrow.texts(batch, "html")):
            if found := vote(blocks(html)):
                sums[host, found[0]] += found[1]
        return pa.RecordBatch.from_arrays([pa.array([h for h, _ in sums], pa.string()), pa.array([p for _, p in sums], pa.string()), pa.array([round(v * 1e6) for v in sums.values()], pa.int64())], names=["host", "path", "score"])

    votes = scratch.written(arrow.map_text(rows, of_slice, "host string, path string, score long", "html").groupBy("host", "path").agg(F.sum("score").alias("score")), "votes")
    totals = votes.groupBy("host").agg(F.sum("score").alias("total"))
    won = votes.join(totals, "host").where(F.col("score") >= F.col("total") * WINNING_SHARE)
    ranked = won.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "path"))).alias("x"))
    return ranked.select("host", F.transform("x", lambda x: x["path"]).alias("paths"))


#: The most hosts, and the most paths of theirs, that are sent to every task; beyond that both sides are dealt by salted host.
BROADCAST_HOSTS, BROADCAST_PATHS = 50_000, 100_000
#: Parts that each host's pages are dealt to in that case.
SALTS = 64


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Per row: ``page_id, url, text, n_chars`` (code points).

    A null or empty page, or one of menus and the like alone, has an empty text. A null
    url belongs to the host without a name. Null ids stay null, repeated rows
    each give a row, an empty table gives none; other columns are ignored.
    """
    paths = scratch.written(consensus(pages, url_col, html_col), "hosts")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), host_column(url_col).alias("host"))
    size = paths.agg(F.count(F.lit(1)).alias("hosts"), F.sum(F.size("paths")).alias("paths")).first()
    if size.hosts <= broadcast_hosts and (size.paths or 0) <= BROADCAST_PATHS:
        joined = rows.join(F.broadcast(paths), "host", "left")
    else:
        salted = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("url", "page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "paths")
    schema = arrow.struct(joined, ["page_id", "url"], "text string, n_chars long")

    def of_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [main_text(blocks(html), paths or []) for html, paths in zip(arrow.texts(batch, "html"), arrow.col(batch, "paths").to_pylist())]
        return pa.RecordBatch.from_arrays([arrow.col(batch, "page_id"), arrow.col(batch, "url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=schema.fieldNames())

    return arrow.map_text(joined, of_slice, schema, "html")
