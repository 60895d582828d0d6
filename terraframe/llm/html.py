"""Main text of web pages by templates that are deduced from pages of the same host.

1. Every page is cut into tokens: opening tags with the path of their
   ancestors (tag, id and class), and text nodes. For each host and token Spark
   adds up the occurrence vector over the pages as sums (pages, occurrences,
   and two sums of page hashes), so equal sums mean equal vectors. Empty pages have no tokens and count for nothing.
2. Tokens of a host with the same vector form an equivalence class. Classes on
   at least ``SUPPORT`` of the host's pages are kept. A class is valid if its
   tags nest: each lies, on its path, inside a tag of its own or of another valid class, or
   at the top. Valid classes nest in one another by these paths; together they are the template.
3. Text nodes of a class on nearly all pages (``FIXED``) are text of the template, whatever
   their tag: mastheads, imprints, notices. On a host whose pages are copies of one page
   everything is on all pages, so there nothing is taken to be fixed.
4. What is between the template's tags are its slots. The article's root is the
   deepest template element that still holds nearly all (``MASS``) of the host's varying text
   outside furniture; every slot below it that is no menu, header, footer, side
   bar, notice, advert, form or comment is extracted, and blocks are joined in page order.

Pages of hosts with fewer than ``HOST_PAGES`` pages, and pages that lack the
host's root, use the page's own ``article``, ``main`` or ``body``.

Pages are read in one pass that is linear in their length, however broken they are.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.llm.storage import small, stored
from terraframe.llm.urls import host

#: Pages from which a host has a template; shares of them that a class, and a fixed text, must be on; share of varying text
#: that the article's root holds; share of a host's text that must vary for any of it to be fixed.
HOST_PAGES, SUPPORT, FIXED, MASS, VARIES = 5, 0.5, 0.8, 0.9, 0.1

# Fixed values of HTML: elements without content, elements that start a block, elements whose text is no page text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody "
    "td tfoot th thead title tr ul".split()
)
RAW = "script|style|noscript|template|textarea|iframe|title|xmp|noframes"
FURNITURE = frozenset("nav header footer aside form button dialog menu".split())
#: Elements that a name never makes furniture: the page itself and its article.
NEVER = frozenset("html body main article".split())
#: What can be the article's root.
CONTAINERS = frozenset("article main section div body td center".split())
#: A tag that may be left open is closed by these.
CLOSES = {"p": BLOCKS - {"html", "body", "title"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words of an id, class or role that mark furniture, as a whole name or as a part of one between hyphens;
#: a name that begins with a word of STATES says something about the page, not what the element is.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion cookie cookies consent gdpr "
    "notice notices alert popup modal overlay comment comments commentlist disqus replies respond sidebar sidebars menu menus nav "
    "navbar navigation breadcrumb breadcrumbs pagination pager share sharing social related recommended recommendations newsletter "
    "subscribe subscription signup login search searchform footer masthead widget widgets toolbar complementary contentinfo "
    "side-bar site-header page-header skip-link skip-links".split()
)
STATES = frozenset("has no not with without is in on".split())

_RAW = re.compile(rf"(?i)(?:{RAW})(?=[\s/>])")
#: Attributes up to the end of the tag. A quote counts only behind "=", and only if it is closed.
_TAG = re.compile(r"""</?+([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_NAMES = re.compile(r"""(?is)(?<![\w-])(?:id|class|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""")


def marked(names: str) -> bool:
    """Whether one of the names says that the element is furniture."""
    for name in names.lower().split():
        parts = re.split(r"[-_]+", name)
        if name in MARKS or (parts[0] not in STATES and not MARKS.isdisjoint(parts)):
            return True
    return False


class Element:
    __slots__ = ("tag", "furniture", "link", "article", "key", "above", "depth", "block", "text")

    def __init__(self, tag: str, names: str, parent: Element | None, place: int):
        self.tag, self.depth, self.text = tag, place, 0
        self.article = tag in ("article", "main") or bool(parent and parent.article)
        mark = tag not in NEVER and bool(names) and marked(names)
        # a header inside the article holds its title; a menu or form in it is still one
        own = mark or (tag in FURNITURE and not (tag == "header" and parent is not None and parent.article))
        self.furniture = own or bool(parent and parent.furniture)
        self.link = tag == "a" or bool(parent and parent.link)
        self.above = parent.key if parent else 0
        self.key = crc32(f"/{tag}.{names}".encode(), self.above)
        self.block = self if tag in BLOCKS else parent.block if parent else None


def walk(html: str) -> Iterator[tuple[str, Element | None, str]]:
    """("open" | "close" | "text", element, text) in page order; elements left open are closed as browsers do."""
    stack: list[Element] = []
    opened: Counter[str] = Counter()

    def close() -> Element:
        e = stack.pop()
        opened[e.tag] -= 1
        return e

    at, low = 0, None
    while True:
        start = html.find("<", at)
        # a "<" that begins nothing is text
        while start >= 0 and not (start + 1 < len(html) and (html[start + 1] in "!/?" or html[start + 1].isalpha())):
            start = html.find("<", start + 1)
        end = start if start >= 0 else len(html)
        if end > at:
            yield "text", stack[-1] if stack else None, html[at:end]
        if start < 0:
            break
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            at = len(html) if stop < 0 else stop + 3
            continue
        if html[start + 1] in "!?" or (html[start + 1] == "/" and not html[start + 2 : start + 3].isalpha()):
            stop = html.find(">", start)
            at = len(html) if stop < 0 else stop + 1
            continue
        m = _TAG.match(html, start)
        if m is None:  # no tag ends from here on
            yield "text", stack[-1] if stack else None, html[start:]
            break
        at = m.end()
        tag, rest = m.group(1).lower(), m.group(2)
        if html[start + 1] == "/":
            if opened[tag]:
                while True:
                    e = close()
                    yield "close", e, ""
                    if e.tag == tag:
                        break
            continue
        if _RAW.match(html, start + 1):
            low = html.lower() if low is None else low  # lengths agree but for a few letters; then search on as it is
            stop = low.find(f"</{tag}", at) if len(low) == len(html) else _find(html, tag, at)
            if stop < 0:
                at = len(html)
            else:
                gt = html.find(">", stop)
                at = len(html) if gt < 0 else gt + 1
            continue
        # an open paragraph ends with the next block, whatever inline elements are open in it
        block = stack[-1].block if stack else None
        if block is not None and tag in CLOSES.get(block.tag, ()):
            while True:
                e = close()
                yield "close", e, ""
                if e is block:
                    break
        names = " ".join(x.strip("\"' ") for x in _NAMES.findall(rest)) if rest else ""
        e = Element(tag, names, stack[-1] if stack else None, len(stack))
        yield "open", e, ""
        if tag in VOID or rest.endswith("/"):
            yield "close", e, ""
        else:
            stack.append(e)
            opened[tag] += 1
    while stack:
        yield "close", close(), ""


def _find(html: str, tag: str, at: int) -> int:
    m = re.compile(rf"(?i)</{tag}").search(html, at)
    return m.start() if m else -1


def _clean(text: str) -> str:
    return " ".join(unescape(text).split())


def page_tokens(html: str) -> dict[tuple[int, int], list]:
    """(kind, hash) -> [occurrences, first position, text below, key above, depth, container] of a page; kind 0 are tags, 1 text nodes.

    Text below an element, and the length of a text node, count only where no furniture is around them and they are no link.
    """
    found: dict[tuple[int, int], list] = {}
    order = 0
    sums: list[list] = []  # of the open elements
    for what, e, text in walk(html):
        if what == "open":
            order += 1
            t = found.setdefault((0, e.key), [0, order, 0, e.above, e.depth, int(e.tag in CONTAINERS)])
            t[0] += 1
            sums.append([t, 0])
        elif what == "close":
            t, n = sums.pop()
            t[2] += n
            if sums:
                sums[-1][1] += n
        elif text := _clean(text):
            order += 1
            t = found.setdefault((1, crc32(text.encode())), [0, order, 0, 0, 0, 0])
            t[0] += 1
            if not e or (not e.furniture and not e.link):
                t[2] += len(text)
                if sums:
                    sums[-1][1] += len(text)
    return found


def main_text(html: str, main: frozenset[int] = frozenset(), fixed: frozenset[int] = frozenset()) -> str:
    """Text of the elements with a key in ``main``, else of the outermost ``article``s, ``main`` or the whole page.

    Text nodes with a hash in ``fixed`` belong to the template and are left out.
    """
    events = list(walk(html))
    keys = {e.key for what, e, _ in events if what == "open"}
    if not keys & main:
        tags = {e.tag for what, e, _ in events if what == "open" and not e.furniture}
        wanted = next((t for t in ("article", "main") if t in tags), None)
        main = frozenset(e.key for what, e, _ in events if what == "open" and e.tag == wanted and not e.furniture) if wanted else frozenset()
    blocks, now, depth = [], [], 0 if main else 1

    def flush() -> None:
        if line := " ".join("".join(now).split()):
            blocks.append(line)
        now.clear()

    for what, e, text in events:
        if what == "text":
            if depth and not (e and e.furniture):
                text = unescape(text)
                if not (fixed and crc32(" ".join(text.split()).encode()) in fixed):
                    now.append(text)
            continue
        if e.tag == "br":
            now.append(" ")
        elif e.tag in BLOCKS:
            flush()
        if e.key in main and e.tag not in VOID:
            depth += 1 if what == "open" else -1
    flush()
    return "\n".join(blocks)


def deduce(pages: int, mass: int, tokens: list[dict]) -> tuple[int | None, list[int]]:
    """Root key and fixed texts of a host from its tokens on at least ``SUPPORT`` of its ``pages``.

    tokens: ``kind, token, pages, total, s1, s2, place, below, above, depth, container``. mass: characters of all text outside furniture and links.
    """
    classes: dict[tuple, list[dict]] = defaultdict(list)
    for t in tokens:
        if t["pages"] >= SUPPORT * pages:
            classes[t["pages"], t["total"], t["s1"], t["s2"]].append(t)
    # classes with more pages first: what nests in them comes later
    valid: dict[int, dict] = {}
    for _, members in sorted(classes.items(), key=lambda x: (-x[0][0], min(t["depth"] for t in x[1]), x[0])):
        tags = sorted((t for t in members if t["kind"] == 0), key=lambda t: (t["depth"], t["place"]))
        own = {t["token"] for t in tags}
        if all(t["depth"] == 0 or t["above"] in own or t["above"] in valid for t in tags):
            valid.update((t["token"], t) for t in tags)
    texts = [t for t in tokens if t["kind"] == 1 and t["pages"] >= FIXED * pages and (t["pages"], t["total"], t["s1"], t["s2"]) in classes]
    repeated = sum(t["below"] for t in texts)
    varies = mass - repeated
    fixed = [t["token"] for t in texts] if varies >= VARIES * mass else []
    # text that varies, below each template element: all text below it is an upper bound once fixed text is out
    root = None
    whole = max((t["below"] for t in valid.values()), default=0)
    heavy = [t for t in valid.values() if whole and t["container"] and t["below"] >= MASS * whole]
    if heavy:
        root = max(heavy, key=lambda t: (t["depth"], t["pages"], -t["token"]))["token"]
    return root, fixed


_SUMS = ["pages", "total", "s1", "s2", "place", "below"]


def templates(pages: DataFrame, html: str) -> DataFrame:
    """(``host``, ``main``, ``fixed``) of hosts with a template: key of the article's root and hashes of template texts.

    pages: ``host`` and ``html``. What is left after the support test is
    bounded by the size of a page, for each host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["host", "kind", "token", *_SUMS, "above", "depth", "container"]
        types = [pa.string(), *[pa.int64()] * 11]
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                sums: dict[tuple, list] = defaultdict(lambda: [0] * 9)
                part = b.slice(i, 1000)
                for h, mark, page in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = page_tokens(page or "")
                    if not own:
                        continue
                    mass = sum(t[2] for (kind, _), t in own.items() if kind == 1)
                    own[(2, 0)] = [1, 0, mass, 0, 0, 0]  # the page itself
                    for (kind, token), (n, place, below, above, depth, container) in own.items():
                        s = sums[(h, kind, token)]
                        s[0] += 1
                        s[1] += n
                        s[2] += n * (mark & 0x7FFFFFFF)
                        s[3] += n * (mark >> 33 & 0x7FFFFFFF)
                        s[4] += place
                        s[5] += below
                        s[6:] = [above, depth, container]
                rows = [(*k, *v) for k, v in sums.items()]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

    mark = F.xxhash64(*[F.col(c) for c in pages.columns])
    longs = ", ".join(f"{c} long" for c in ["kind", "token", *_SUMS, "above", "depth", "container"])
    tokens = pages.select("host", mark.alias("mark"), F.col(html)).mapInArrow(run, f"host string, {longs}")
    same = [F.min(c).alias(c) for c in ("above", "depth", "container")]  # a key names one path
    sums = tokens.groupBy("host", "kind", "token").agg(*[F.sum(c).alias(c) for c in _SUMS], *same)
    # a token of one page only can't be part of a template
    sums = stored(sums.where("pages > 1 OR kind = 2"))
    size = sums.where("kind = 2").select("host", F.col("pages").alias("n"), F.col("below").alias("mass")).where(F.col("n") >= HOST_PAGES)
    often = sums.where("kind < 2").join(size, "host").where(F.col("pages") >= SUPPORT * F.col("n"))
    member = F.struct("kind", "token", *_SUMS, "above", "depth", "container")
    hosts = often.groupBy("host", "n", "mass").agg(F.collect_list(member).alias("tokens"))  # at most two pages' worth

    def of_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(h, *deduce(n, mass, tokens)) for h, n, mass, tokens in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * 3
            types = [pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["host", "main", "fixed"])

    return hosts.select("host", "n", "mass", "tokens").mapInArrow(of_host, "host string, main long, fixed array<long>")


def extract(pages: DataFrame, url: str, html: str, text: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` but ``html``, and the main ``text`` (empty if none).

    Character references are decoded, white space inside a block is one space,
    blocks are joined by newlines. Null pages and urls count as empty ones; a repeated page is one more page
    of its host. A column of ``pages`` called ``text`` is replaced.
    """
    kept = [c for c in pages.columns if c not in (html, text)]
    named = pages.select(
        *[F.col(f"`{c}`") for c in kept],
        host(F.coalesce(F.col(f"`{url}`"), F.lit(""))).alias("__host"),
        F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("__html"),
    )
    of_host = stored(templates(named.select(F.col("__host").alias("host"), "__html"), "__html"))
    met = named.join(small(of_host.withColumnsRenamed({"host": "__host", "main": "__main", "fixed": "__fixed"})), "__host", "left")
    met = met.select(*[F.col(f"`{c}`") for c in kept], "__main", "__fixed", "__html")
    schema = T.StructType([met.schema[c] for c in kept]).add(text, "string")
    at = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                out = [
                    main_text(page, frozenset() if m is None else frozenset([m]), frozenset(f or ()))
                    for m, f, page in zip(*(part.column(c).to_pylist() for c in (at, at + 1, at + 2)), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(out, pa.string())], names=schema.fieldNames())

    return met.mapInArrow(run, schema)
