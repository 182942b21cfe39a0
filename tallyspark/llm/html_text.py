"""Main text of web pages by consensus of a host's pages on where it stands, and on what stands beside it.

Each page scores its containers and names the innermost that holds all its text, and tells what stands beside the chain of
elements that hold most of it. Spark counts both by generalised tag-class paths, host by host. What says the same at one
path of most of a host's pages, while the rest of these pages differs, is the site's and is taken out; a winning path then
extracts the pages of the host whose remaining text it holds whole.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import parts, table, written

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+")
# Kinds of elements in HTML, and names that sites give to what isn't the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes svg".split())
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = set("html body div article main section td center".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OTHER = set("nav footer aside form button select dialog menu head object audio video canvas".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOT_TEXT = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs cc comment comments consent cookie cookies copyright disqus "
    "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
# Words that say where something stands or how it is laid out; beside one of NOT_TEXT they don't change what it names.
LAYOUT = set("area bar block body bottom box btn button buttons col column content container count el fixed float head inner item items js left link links list main message mobile msg outer page post posts right section site slot sticky text thread top unit wrap wrapper zone".split())
# Words that themes also give to what wraps the whole page or its article, as in content-sidebar-wrap.
WRAPS = set("banner footer form header masthead menu nav navbar navigation search sidebar toolbar widget widgets".split())
HEADINGS = {f"h{n}" for n in range(1, 7)}


@dataclass
class Element:
    tag: str
    parent: int
    path: int  # number of its path
    dropped: bool
    inside: bool  # in an article or main part, or one itself
    wraps: bool = False  # dropped by itself, but for a reason that a wrapper of the page may give as well
    text: int = 0  # characters of kept blocks below it, links left out
    whole: int = 0  # the same of all blocks below it
    holds: int = 0  # 2 with a main part below it, 1 with an article


@dataclass
class Page:
    """steps: each path as its parent's number and its last step, known by its own number through numbers."""

    elements: list[Element] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)  # of blocks, links left out
    text: int = 0  # the same of all kept blocks, also those outside every element
    steps: list[tuple[int, str]] = field(default_factory=list)
    numbers: dict[tuple[int, str], int] = field(default_factory=dict)

    def numbered(self, parent: int, step: str) -> int:
        if (parent, step) not in self.numbers:
            self.numbers[parent, step] = len(self.steps)
            self.steps.append((parent, step))
        return self.numbers[parent, step]

    def written(self, path: int) -> str:
        out = []
        while path >= 0:
            path, step = self.steps[path]
            out.append(step)
        return "".join(f">{x}" for x in reversed(out))

    def known(self, path: str) -> int | None:
        """The number of a written path, if the page has it."""
        at = -1
        for step in path[1:].split(">"):
            if (at := self.numbers.get((at, step))) is None:
                return None
        return at


def general(tag: str, names: str) -> str:
    """A step of a path: the tag with its class and id, in which numbers are the same."""
    return tag + "".join(f".{re.sub(r'[0-9]+', '#', x)}" for x in sorted(set(names.lower().replace(">", "").split())))


def furniture(names: str) -> bool:
    """Whether a class or id names what isn't the article: one of its parts does, and all others are of layout alone. So
    cookie-notice and site-footer do, and search-results or social-history, which may as well be a title, don't."""
    return any(not NOT_TEXT.isdisjoint(p := set(PARTS.findall(x))) and p <= NOT_TEXT | LAYOUT for x in names.lower().split())


def wrapper(tag: str, attributes: dict[str, str]) -> bool:
    """Whether what drops an element is only a form, or names that a wrapper may have too."""
    if tag in OTHER - {"form"} or tag == "header" or attributes.get("role", "").lower() in ROLES or "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return False
    named = [p for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split() if furniture(x) for p in PARTS.findall(x)]
    return NOT_TEXT.isdisjoint(set(named) - WRAPS)


def away(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element isn't part of the article. An id isn't asked in headings, where it is made from the title, nor any name in
    the first heading, which is the title."""
    if tag in OTHER or tag == "header" and not inside or attributes.get("role", "").lower() in ROLES:
        return True
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("html", "body", "article", "main", "h1"):
        return False
    names = attributes.get("class", "") if tag in HEADINGS else f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return furniture(" ".join(x for x in names.split() if not inside or "header" not in x.lower()))


def parsed(source: str) -> Page:
    """Elements and text blocks of a page; markup may be unclosed or cut off anywhere."""
    page, stack, held, links = Page(), [-1], [], [0, 0]
    elements = page.elements

    def flush() -> None:
        said = " ".join(html.unescape("".join(held)).split())
        held.clear()
        at, linked = stack[-1], links[1]
        links[1] = 0
        if said:
            page.blocks.append((at, said))
            page.sizes.append(max(len(said) - 2 * linked, 0))

    def add(text: str) -> None:
        held.append(text)
        links[1] += len(text) if links[0] else 0

    at = 0
    while m := TAG.search(source, at):
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        tag, close, rest = m[2] or m[5], m[1] or m[4], m[3] or m[6] or ""
        if not tag:
            continue
        tag = tag.lower()
        if tag == "a":
            links[0] = 0 if close else 1
        if tag == "br":
            add(" ")
        if tag in BLOCK or tag in RAW or tag in OTHER:
            flush()
        if close:
            if tag in BLOCK or tag in OTHER:
                for k in range(len(stack) - 1, 0, -1):
                    if elements[stack[k]].tag == tag:
                        del stack[k:]
                        break
            continue
        if tag in RAW:
            if not rest.rstrip().endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else len(source)
            continue
        if tag in VOID or tag not in BLOCK and tag not in OTHER:
            continue
        if tag in CLOSES:
            while len(stack) > 1 and elements[stack[-1]].tag in CLOSES[tag]:
                stack.pop()
        elif len(stack) > 1 and elements[stack[-1]].tag == "p":
            stack.pop()
        if tag == "hr":
            continue
        attributes = {a.lower(): x or y or z for a, x, y, z in reversed(ATTRIBUTE.findall(rest))} if rest else {}
        up = stack[-1]
        over = elements[up] if up >= 0 else Element("", -1, -1, False, False)
        step = general(tag, f"{attributes.get('class', '')} {attributes.get('id', '')}")
        gone = away(tag, attributes, over.inside)
        elements.append(Element(tag, up, page.numbered(over.path, step), gone, over.inside or tag in ("article", "main"), gone and wrapper(tag, attributes)))
        stack.append(len(elements) - 1)
    add(source[at:])
    flush()
    settle(page)
    return page


def settle(page: Page) -> None:
    """What is dropped with the elements that hold it, and how much text is left where.

    An element that seems to be furniture, but is named as wrappers are too, stays if it has the page's main part, more than half of the
    page's text with an article, or more than nine tenths of it. Comments, adverts and the like never stay by that.
    """
    elements = page.elements
    for (at, _), size in zip(page.blocks, page.sizes, strict=True):
        if at >= 0:
            elements[at].whole += size
    for x in reversed(elements):  # what is inside an element comes after it
        if x.parent >= 0:
            over = elements[x.parent]
            over.whole += x.whole
            over.holds = max(over.holds, x.holds, 2 if x.tag == "main" else 1 if x.tag == "article" else 0)
    total = sum(page.sizes)
    for x in elements:
        if x.wraps and (x.holds == 2 or 2 * x.whole > total and x.holds or 10 * x.whole > 9 * total):
            x.dropped = False
        x.dropped = x.dropped or x.parent >= 0 and elements[x.parent].dropped
    weigh(page)


def weigh(page: Page) -> None:
    """How much kept text there is on the page and in each element."""
    page.text = 0
    for x in page.elements:
        x.text = 0
    for (at, _), size in zip(page.blocks, page.sizes, strict=True):
        if at < 0 or not page.elements[at].dropped:
            page.text += size
            if at >= 0:
                page.elements[at].text += size
    for x in reversed(page.elements):
        if x.parent >= 0:
            page.elements[x.parent].text += x.text


def digest(*said: bytes) -> bytes:
    return hashlib.blake2b(b"".join(said), digest_size=16).digest()


def beside(page: Page) -> dict[bytes, list[int]]:
    """Elements of each path, by the path's digest, that stand beside the page's spine: the containers that hold more than half
    of its kept text, down to an article. What is right inside the innermost of them is the article's own, as headings are.
    Paths that together hold more than half themselves aren't among them."""
    spine: dict[int, bytes] = {-1: b""}
    steps: dict[int, bytes] = {}
    found: dict[bytes, list[int]] = {}
    last = -1
    for i, x in enumerate(page.elements if page.text else ()):
        if x.dropped or x.parent not in spine or x.parent >= 0 and page.elements[x.parent].tag == "article":
            continue
        if x.path not in steps:
            steps[x.path] = digest(spine[x.parent], page.steps[x.path][1].encode("utf-8", "surrogatepass"))
        if 2 * x.text > page.text and x.tag in CONTAINER:
            spine[i], last = steps[x.path], i
        elif x.tag not in HEADINGS:
            found.setdefault(steps[x.path], []).append(i)
    outer = {key: those for key, those in found.items() if page.elements[those[0]].parent != last}
    return {key: those for key, those in outer.items() if 2 * sum(page.elements[i].text for i in those) <= page.text}


def said_beside(page: Page) -> Iterator[tuple[bytes, bytes, int]]:
    """For each path beside the spine with kept text: its digest, that of its text, and one of 64 numbers of the page's rest."""
    owner: list[bytes | None] = [None] * len(page.elements)
    for key, those in beside(page).items():
        for i in those:
            owner[i] = key
    said: dict[bytes, int] = {}
    whole = 0
    for i, x in enumerate(page.elements):
        if owner[i] is None and x.parent >= 0:
            owner[i] = owner[x.parent]
    for at, text in page.blocks:
        if at < 0 or not page.elements[at].dropped:
            one = int.from_bytes(digest(text.encode("utf-8", "surrogatepass")))
            whole += one
            if at >= 0 and (key := owner[at]) is not None:
                said[key] = said.get(key, 0) + one
    for key, own in said.items():
        yield key, (own % (1 << 128)).to_bytes(16), (whole - own) % 64


def without(page: Page, shared: set[bytes]) -> Page:
    """The page with what its host shares taken out, where it stands beside the spine."""
    gone = [i for key, those in beside(page).items() if key in shared for i in those]
    for i in gone:
        page.elements[i].dropped = True
    if gone:
        for x in page.elements:
            x.dropped = x.dropped or x.parent >= 0 and page.elements[x.parent].dropped
        weigh(page)
    return page


def choice(page: Page) -> int | None:
    """The page's own path: the innermost container that holds all of its kept text, links left out; None without one."""
    return next((x.path for x in reversed(page.elements) if x.tag in CONTAINER and not x.dropped and x.text == page.text), None) if page.text else None


def text_at(page: Page, path: int | None) -> str:
    """Kept blocks under elements of a path (of the whole page for None), joined by two line feeds."""
    within = [False] * len(page.elements)
    for i, x in enumerate(page.elements):
        within[i] = not x.dropped and (path is None or x.path == path or x.parent >= 0 and within[x.parent])
    return "\n\n".join(t for at, t in page.blocks if (within[at] if at >= 0 else path is None))


def extracted(source: str, paths: list[str], shared: list[bytes] = ()) -> str:
    """The text, without what the host shares, at the host's first path that holds all of it, or else at the page's own."""
    page = without(parsed(source), set(shared))
    has: Counter = Counter()
    for x in page.elements:
        if x.text and not x.dropped:
            has[x.path] += x.text
    known = (page.known(p) for p in paths)
    return text_at(page, next((p for p in known if p is not None and has[p] and has[p] == page.text), choice(page)))


def votes(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """host, path, key, n, alike: how many of a host's pages name the path as their container; or, by the path's digest, how many
    have text at it beside their spine, and how many of these say what others say too.

    A text counts as said by others if at least 3 pages have it and their rests differ: at least half as many rests as
    pages, or 16 of 64 numbers of rests. So copies of one article don't vote each other's parts out. Both are counted in
    the task before rows are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list[int]] = {}

        def vote(key: tuple, bits: int) -> None:
            held = found.setdefault(key, [0, 0])
            held[0] += 1
            held[1] |= bits

        for batch in parts(batches):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parsed(source or "")
                if (path := choice(page)) is not None:
                    vote((host, page.written(path), None, None), 0)
                for key, said, rest in said_beside(page) if host else ():
                    vote((host, None, key, said), 1 << rest)
            if len(found) > 50_000:
                yield rows(found)
                found.clear()
        yield rows(found)

    def rows(found: dict[tuple, list[int]]) -> pa.RecordBatch:
        keys = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.binary(), pa.binary()))]
        bits = [x - (1 << 64) if x >> 63 else x for _, x in found.values()]
        return pa.RecordBatch.from_arrays([*keys, pa.array([n for n, _ in found.values()], pa.int64()), pa.array(bits, pa.int64())], ["host", "path", "key", "said", "n", "rests"])

    counted = pages.select(host(url_col).alias("host"), html_col).mapInArrow(count, "host string, path string, key binary, said binary, n long, rests long")
    texts = counted.groupBy("host", "path", "key", "said").agg(F.sum("n").alias("n"), F.bit_count(F.bit_or("rests")).alias("rests"))
    alike = F.col("key").isNotNull() & (F.col("n") >= 3) & ((2 * F.col("rests") >= F.col("n")) | (F.col("rests") >= 16))
    return texts.groupBy("host", "path", "key").agg(F.sum("n").alias("n"), F.sum(F.when(alike, F.col("n")).otherwise(0)).alias("alike"))


def host(url_col: str):
    """The host of a URL, in lower case; the empty string for null or what isn't a URL."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def winning_paths(counted: DataFrame, share: float = 0.01) -> DataFrame:
    """host, paths, shared: containers with at least this share of the host's votes (so at most 1 / share), most votes first, ties
    by path; and digests of the paths beside the spine at which more than half of the host's pages say what others say.

    A page of a rarer layout isn't lost: no winner holds all of its text, and it is extracted at its own container.
    """
    total = counted.where("path IS NOT NULL").groupBy("host").agg(F.sum("n").alias("total"))
    kept = counted.join(total, "host").where(F.when(F.col("path").isNotNull(), F.col("n") >= F.col("total") * share).otherwise(2 * F.col("alike") > F.col("total")))
    paths = F.collect_list(F.when(F.col("path").isNotNull(), F.struct((-F.col("n")).alias("n"), "path")))
    return kept.groupBy("host").agg(F.transform(F.sort_array(paths), lambda x: x["path"]).alias("paths"), F.sort_array(F.collect_list("key")).alias("shared"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_paths: int = 100_000) -> DataFrame:
    """id_col, url_col, text and n_chars (code points) of every row of pages.

    A null or empty page, or one without text of its own, has the empty text. Pages without a host vote together on
    containers and share nothing. Ids may be null or repeat; an empty table gives none; other columns are ignored. The winners,
    a row per host, are broadcast only if they have at most broadcast_paths paths; beyond that the pages are joined to them by
    host, hot hosts split by adaptive execution.
    """
    winners = written(winning_paths(written(votes(pages, url_col, html_col), "votes")), "paths")
    few = (winners.agg(F.sum(F.size("paths") + F.size("shared"))).first()[0] or 0) <= broadcast_paths
    joined = pages.select(id_col, url_col, html_col, host(url_col).alias("host")).join(F.broadcast(winners) if few else winners, "host", "left").select(id_col, url_col, html_col, "paths", "shared")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, 2):
            out = [extracted(x or "", paths or [], shared or []) for x, paths, shared in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(extract, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
