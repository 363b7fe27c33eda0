"""Main text of web pages, with site templates found by counting subtrees.

Every page is parsed once. Each element that may belong to a template gets a hash of its whole
subtree (tags, classes, ids and texts, bottom up) and the stretch of blocks that it covers.
Spark counts, for each host, the distinct pages on which a hash occurs; a subtree on at least
MIN_PAGES of them and SHARE of the host's pages, or on MANY_PAGES of them whatever their share,
is a template and its blocks go. Pages that are copies of each other count once, so a page that
is served under many urls is no template of itself. Headings, paragraphs, lists, tables and
quotations inside an article are prose and never a template.

What differs from page to page can't be counted as a subtree. So blocks also go by their markup:
navigation, headers, footers, asides, forms, hidden elements and everything without readable text,
by tag, role or style; and, if a page has an ``article`` or a ``main``, whatever stands outside
all of them. Last come names (notices, adverts, comments and the like as a class, id or label).
A name counts as a whole: a class or id is one, and so is a label, and each of its pieces must
say so (``cookie-notice``, but not ``with-sidebar``). An ``article`` or ``main``, and an element
that contains one, is never dropped by its name. Names are a guess, so counting checks them: on a
host of COUNTED_PAGES or more, an element's tag and names must occur on MIN_PAGES of its pages.
If names alone leave nothing of a page without ``article`` and ``main``, they are not followed.

A block is the text between tags that break lines. Character references are decoded, white space
inside a block becomes one space, blocks are trimmed and joined in page order by an empty line.

A null html is an empty page and gives an empty text. A url without ``://`` has an empty host.
Repeated rows are separate rows; empty tables give empty ones; other columns are ignored. Unclosed
and misnested tags are closed where their parents end; markup that never ends is text, but for
comments, scripts, styles and other raw text, which then last to the end. Elements nested deeper than
DEPTH take the place of the innermost open one. Parsing takes time in proportion to the page: once the
quotes of a tag hide every ``>`` behind it, tags of that page end at the first one from there on.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from posthorn.llm.arrow import slices, utf8
from posthorn.llm.url_filters import host_of
from posthorn.plans.scratch import materialise

MIN_PAGES = 3
SHARE = 0.3
MANY_PAGES = 1000
#: Distinct pages of a host from which on names are checked by counting.
COUNTED_PAGES = 20
#: Open elements of a page.
DEPTH = 512
#: Verdicts (host and hash) up to which their table is broadcast; more are joined by row.
BROADCAST_TEMPLATES = 200_000

# Tags and names: fixed values.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video select noembed noframes xmp".split())
#: Raw text that lasts to the end of a page if it isn't closed; other tags of _RAW are then ignored.
_ENDLESS = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: The only raw elements for which ``/>`` is an end.
_FOREIGN = frozenset(("svg", "math"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"html", "head", "body", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "option"}
#: An open element of these tags ends when one of the same group starts.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SIBLING_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_DROP_TAGS = frozenset("nav aside form fieldset button dialog menu head search".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_DROP_NAMES = frozenset(
    "ad ads adbox adsbygoogle adsense adslot adunit advert advertisement advertising advertorial adverts alert aside banner breadcrumb breadcrumbs "
    "byline comment commentlist comments consent cookie cookiebar cookies copyright disclaimer discussion disqus form gdpr login menu menubar modal nav "
    "navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related "
    "replies reply respond search searchbox share sharing sidebar signup skip skyscraper social sponsor sponsored subscribe subscription teaser toolbar "
    "widget widgets".split()
)
_EDGE_NAMES = frozenset("header footer masthead topbar".split())
#: Pieces that name nothing by themselves and may stand beside the others.
_NEUTRAL_NAMES = frozenset("block box buttons links list site".split())
_CONTENT_NAMES = frozenset("article body content entry main post story text".split())
_PROSE = frozenset("blockquote caption code dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 li ol p pre table tbody td tfoot th thead tr ul".split())

# A quote counts only behind a ``=``, and only if it is closed.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z][a-zA-Z-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class _Node:
    """An open element. ``number`` is its place among the candidates, ``named`` the innermost name around or on it."""

    __slots__ = ("tag", "dropped", "named", "inside", "number", "own_name", "parts")

    def __init__(self, tag: str, dropped: bool, named: int, inside: bool, number: int, own_name: int, first: bytes) -> None:
        self.tag, self.dropped, self.named, self.inside, self.number, self.own_name = tag, dropped, named, inside, number, own_name
        self.parts = [first]


@dataclass
class Page:
    """What parsing finds: blocks with whether their markup drops them, and stretches (hash, first block, end) of
    template candidates and of elements that a name drops."""

    root: int
    texts: list[str]
    said: list[bool]
    subtrees: list[tuple[int, int, int]]
    names: list[tuple[int, int, int]]
    areas: bool


def _is_named(name: str, dropped: frozenset[str]) -> bool:
    """Whether all pieces of a class, id or label are in ``dropped`` or neutral, and not all neutral."""
    pieces = set(_NAME.findall(name))
    return not pieces.isdisjoint(dropped) and pieces <= dropped | _NEUTRAL_NAMES


def _says_drop(tag: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether an element's tag, role or style marks it as no main text; whether a name does; and its names."""
    drop = tag in _DROP_TAGS or tag == "footer" or (tag == "header" and not inside)
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return drop, False, ""
    names, whole = [], []
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id", "aria-label"):
            names.append(value)
            whole += [value] if key == "aria-label" else value.split()
        elif key == "role":
            drop = drop or not _DROP_ROLES.isdisjoint(value.split())
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            drop = True
    joined = " ".join(names)
    named = False
    if whole and tag not in ("html", "body", "article", "main"):
        named = any(_is_named(n, _DROP_NAMES) for n in whole) or (
            any(_is_named(n, _DROP_NAMES | _EDGE_NAMES) for n in whole) and _CONTENT_NAMES.isdisjoint(_NAME.findall(joined))
        )
    return drop, named, joined


def _signed(digest: int) -> int:
    return digest - 2**63


class _Parser:
    """One page, read from front to back."""

    def __init__(self) -> None:
        self.stack = [_Node("", False, 0, False, -1, 0, b"")]
        self.words: list[str] = []
        self.blocks: list[tuple[str, bool, bool]] = []  # text, dropped, inside an article or main
        self.subtrees: list[list[int]] = []
        # Elements with such a name, until an article or main is found in them, and the next ones around them.
        self.names: list[list[int]] = [[0, 0, 0]]
        self.names_drop, self.around = [False], [0]
        self.areas = False

    def flush(self) -> None:
        if self.words:
            text = " ".join("".join(self.words).split())
            self.words.clear()
            if text:
                top = self.stack[-1]
                top.parts.append(text.encode())
                self.blocks.append((text, top.dropped, top.inside))

    def close(self, n: int) -> None:
        """Close the open elements from number n on."""
        while len(self.stack) > n:
            node = self.stack.pop()
            digest = xxhash.xxh64(b"\x00".join(node.parts))
            self.stack[-1].parts.append(digest.digest())
            if node.number >= 0:
                self.subtrees[node.number][::2] = _signed(digest.intdigest()), len(self.blocks)
            if node.own_name:
                self.names[node.own_name][2] = len(self.blocks)

    def end(self, tag: str) -> None:
        stack = self.stack
        block = tag in _BLOCK
        n = len(stack) - 1
        while n and stack[n].tag != tag and (block or stack[n].tag not in _BLOCK):
            n -= 1
        found = n and stack[n].tag == tag
        if block or found and (stack[n].dropped, stack[n].named) != (stack[n - 1].dropped, stack[n - 1].named):
            self.flush()
        if found:
            self.close(n)

    def make_room(self, tag: str) -> None:
        """Close what the start of a block element ends."""
        stack = self.stack
        if tag in _CLOSES_P:
            n = len(stack) - 1
            while n and (stack[n].tag not in _BLOCK):
                n -= 1
            if n and stack[n].tag == "p":
                self.close(n)
        if tag in _SIBLINGS:
            n = len(stack) - 1
            while n and stack[n].tag not in _SIBLINGS[tag] and stack[n].tag not in _SIBLING_SCOPE[tag]:
                n -= 1
            while n and stack[n].tag in _SIBLINGS[tag]:
                low, n = n, n - 1
                if stack[n].tag not in _SIBLINGS[tag]:
                    self.close(low)
                    break

    def start(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCK
        if block:
            self.flush()
            self.make_room(tag)
        top = self.stack[-1]
        says, named, names = _says_drop(tag, attributes, top.inside)
        drop, inside, by_name = top.dropped or says, top.inside, top.named
        if not drop and tag in ("article", "main"):
            k = by_name
            while self.names_drop[k]:
                self.names_drop[k] = False
                k = self.around[k]
            inside = self.areas = True
        if not block and (named or drop != top.dropped):
            self.flush()
        if len(self.stack) > DEPTH:
            self.flush()
            self.close(len(self.stack) - 1)
        what = f"{tag} {names}".encode()
        if named:
            self.names.append([_signed(xxhash.xxh64_intdigest(what)), len(self.blocks), 0])
            self.names_drop.append(True)
            self.around.append(by_name)
            by_name = len(self.names) - 1
        gone = drop or self.names_drop[by_name]
        number = -1
        if block and tag not in ("html", "head", "body", "main", "article") and not (inside and not gone and tag in _PROSE):
            number = len(self.subtrees)
            self.subtrees.append([0, len(self.blocks), 0])
        self.stack.append(_Node(tag, drop, by_name, inside, number, by_name if named else 0, what))

    def page(self, page: str) -> Page:
        at = since = 0
        last = page.rfind(">")
        quotes = True  # until the quotes of a tag hide every > behind it
        unclosed: set[str] = set()
        while 0 <= (at := page.find("<", at)) < last:
            after = page[at + 1 : at + 2]
            tag, ends, attributes = "", False, ""
            if page.startswith("<!--", at):
                to = page.find("-->", at + 4)
                to = to + 3 if to >= 0 else len(page)
            elif after in ("!", "?"):
                to = page.find(">", at) + 1
            else:
                m = _TAG.match(page, at) if quotes else None
                if m is None:
                    m = _PLAIN_TAG.match(page, at)
                    quotes = quotes and m is None
                if m is None:
                    at += 1
                    continue
                tag, ends, attributes, to = m[2].lower(), bool(m[1]), m[3], m.end()
            if at > since:
                data = page[since:at]
                self.words.append(_html.unescape(data) if "&" in data else data)
            at = since = to
            if not tag:
                continue
            if tag == "br":
                self.words.append(" ")
            elif ends:
                self.end(tag)
            elif tag in _RAW:
                if not (tag in _FOREIGN and attributes.endswith("/")) and tag not in unclosed:
                    close = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(page, at)
                    if close:
                        at = since = close.end()
                    elif tag in _ENDLESS:
                        since = len(page)
                        break
                    else:
                        unclosed.add(tag)
            elif tag in _VOID:
                if tag in _BLOCK:
                    self.flush()
            else:
                self.start(tag, attributes)
        if since < len(page) and page.startswith("<!--", at if at >= 0 else len(page)):
            page = page[:at]  # a comment that never ends
        if since < len(page):
            self.words.append(_html.unescape(page[since:]))
        self.flush()
        self.close(1)
        root = _signed(xxhash.xxh64_intdigest(b"\x00".join(self.stack[0].parts)))
        return Page(
            root, [b[0] for b in self.blocks], [d or (self.areas and not inside) for _, d, inside in self.blocks],
            [tuple(x) for x in self.subtrees if x[1] < x[2]],
            [tuple(x) for x, drops in zip(self.names, self.names_drop, strict=True) if drops and x[1] < x[2]], self.areas,
        )


def parse(page: str) -> Page:
    """Blocks, template candidates and named elements of one page."""
    return _Parser().page(page)


def kept(page: Page, templates: set[int] = frozenset(), refuted: set[int] = frozenset()) -> tuple[list[str], int, int]:
    """The texts of a page's main blocks, and how many of the others go with templates and only by a name."""
    n = len(page.texts)

    def cover(stretches: list[tuple[int, int, int]]) -> np.ndarray:
        steps = np.zeros(n + 1, np.int64)
        for _, first, end in stretches:
            steps[first] += 1
            steps[end] -= 1
        return np.cumsum(steps)[:n] > 0

    foreign = cover([x for x in page.subtrees if x[0] in templates])
    left = ~foreign & ~np.array(page.said, bool)
    named = left & cover([x for x in page.names if x[0] not in refuted])
    if not page.areas and np.array_equal(named, left):
        named[:] = False
    return [t for t, ok in zip(page.texts, left & ~named, strict=True) if ok], int(foreign.sum()), int(named.sum())


_STRETCHES = pa.list_(pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("end", pa.int32())]))
_STRETCHES_SQL = "array<struct<hash:bigint,first:int,end:int>>"


def _stretches(rows: list[list[tuple[int, int, int]]]) -> pa.Array:
    flat = [x for r in rows for x in r]
    columns = zip(*flat, strict=True) if flat else [()] * 3
    struct = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _STRETCHES.value_type, strict=True)], fields=list(_STRETCHES.value_type))
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), struct).cast(_STRETCHES)


def parsed(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Row number, ``key``, ``url``, ``host`` and what ``parse`` finds of every page, written once."""
    picked = pages.select(
        pages[key].alias("key"), pages[url].cast("string").alias("url"), host_of(pages[url]).alias("host"), pages[html].cast("string").alias("html")
    )
    kind = picked.schema["key"].dataType.simpleString()
    schema = (
        f"key {kind}, url string, host string, root long, texts array<string>, said array<boolean>, "
        f"subtrees {_STRETCHES_SQL}, names {_STRETCHES_SQL}, areas boolean"
    )
    names = ["key", "url", "host", "root", "texts", "said", "subtrees", "names", "areas"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [parse(x.decode()) for x in utf8(batch.column(3))]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array([f.root for f in found], pa.int64()), pa.array([f.texts for f in found], pa.list_(pa.string())),
                    pa.array([f.said for f in found], pa.list_(pa.bool_())), _stretches([f.subtrees for f in found]), _stretches([f.names for f in found]),
                    pa.array([f.areas for f in found], pa.bool_()),
                ],
                names,
            )

    return materialise(picked.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "html-parsed")


def _hashes() -> Column:
    """The different hashes of a page's subtrees and names: array<struct<named, hash>>."""
    marked = lambda c, named: F.transform(c, lambda x: F.struct(F.lit(named).alias("named"), x["hash"].alias("hash")))
    return F.array_distinct(F.concat(marked("subtrees", False), marked("names", True)))


def judged(
    found: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE, many_pages: int = MANY_PAGES, counted_pages: int = COUNTED_PAGES
) -> DataFrame:
    """``host``, ``named`` and ``hash``: subtrees that recur on many pages of a host (not ``named``) and names that don't (``named``)."""
    each = found.select("host", "root", F.explode(_hashes()).alias("x"))
    counted = each.select("host", "root", "x.named", "x.hash").distinct().groupBy("host", "named", "hash").agg(F.count("*").alias("n"))
    # Subtrees on less pages are none of both; they go before the join.
    counted = counted.where(F.col("named") == (F.col("n") < min_pages))
    pages = found.select("host", "root").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    recurs = (F.col("n") >= share * F.col("pages")) | (F.col("n") >= many_pages)
    return counted.join(pages, "host").where(F.when(F.col("named"), F.col("pages") >= counted_pages).otherwise(recurs)).select("host", "named", "hash")


def _main_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        out = []
        for texts, said, subtrees, names, areas, known in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            triples = lambda xs: [(x["hash"], x["first"], x["end"]) for x in xs]
            told = [{x["hash"] for x in known or () if x["named"] == named} for named in (False, True)]
            main, n_template, n_named = kept(Page(0, texts, said, triples(subtrees), triples(names), areas), *told)
            out.append(("\n\n".join(main), n_template, n_named))
        columns = zip(*out, strict=True) if out else [()] * 3
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True))],
            ["key", "url", "text", "n_template_blocks", "n_named_blocks"],
        )


def extract(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE,
    broadcast_templates: int = BROADCAST_TEMPLATES, counted_pages: int = COUNTED_PAGES,
) -> DataFrame:
    """``key``, ``url``, ``text``, ``n_chars``, and how many blocks templates and names take, for every page."""
    found = parsed(pages, key, url, html)
    known = materialise(judged(found, min_pages, share, counted_pages=counted_pages), "html-templates")
    own = _hashes()
    if known.count() <= broadcast_templates:
        # A template is on a share of a host's pages or on many, so a host has few; their number is checked.
        per_host = known.groupBy("host").agg(F.collect_set(F.struct("named", "hash")).alias("all"))
        told = found.join(F.broadcast(per_host), "host", "left").withColumn("known", F.array_intersect(own, F.col("all")))
    else:
        each = found.select("row", "host", F.explode(own).alias("x")).select("row", "host", "x.named", "x.hash")
        per_row = each.join(known, ["host", "named", "hash"]).groupBy("row").agg(F.collect_set(F.struct("named", "hash")).alias("known"))
        told = found.join(per_row, "row", "left")
    kind = found.schema["key"].dataType.simpleString()
    told = told.select("key", "url", "texts", "said", "subtrees", "names", "areas", "known")
    out = told.mapInArrow(_main_text, f"key {kind}, url string, text string, n_template_blocks long, n_named_blocks long")
    return out.select(F.col("key").alias(key), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"), "n_template_blocks", "n_named_blocks")
