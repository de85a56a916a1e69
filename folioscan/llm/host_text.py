"""Main text of web pages by paths that a host's pages agree on.

1. Each page's containers are scored by the text of the blocks right inside them; text of
   links counts against them, and boilerplate parts are left out. A word inside a longer class
   or id (``has-sidebar``) does not make a box boilerplate that holds most of the page's text.
2. The best container of a page votes for its generalised path (tags and classes with digits
   taken out); Spark sums the votes per host.
3. The paths that a page has are joined with the votes of its host. Each page is read again
   with the one with most votes, whatever its place among all paths of the host.

A ``header`` is left out wherever it stands, in an article too. Tags are read as attributes one after
the other: only names of attributes and whole values decide, not words inside other values.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from ..sizing import join_sized
from .common import attach, column, free_name, slices, small_batches

BOXES = frozenset("html body main article section div td table tbody tr aside nav header footer form ul ol dl figure details dialog center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption caption th address summary hr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset(("td", "th"))
# start tags that end open elements: which ones, and the boxes beyond which they don't
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol"))), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (CELLS, frozenset(("tr", "table"))), "th": (CELLS, frozenset(("tr", "table"))), "tr": (CELLS | {"tr"}, frozenset(("tbody", "table"))),
    "tbody": (CELLS | {"tr", "tbody", "caption"}, frozenset(("table",))),
}
INSIDE = frozenset("button select noscript iframe template svg".split())  # what may stand in a paragraph
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
OUT_TAGS = frozenset("nav header footer aside form button select menu noscript iframe template svg dialog".split())
RAW = frozenset("script style textarea title noscript iframe template svg select".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs header"
    " footer sidebar side aside widget related share sharing social comment comments respond reply replies disqus cookie cookies"
    " consent notice notices alert popup modal overlay newsletter subscribe subscription signup login pagination pager toolbar masthead".split()
)
WHOLE = frozenset("html body main article".split())  # never boilerplate by a word
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

START = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|(=?[^\s/>=]*)\s*(=?)\s*)")  # the tag's end, or a name and whether a value follows
BARE = re.compile(r"[^\s>]*")
READ = frozenset("class id role hidden aria-hidden".split())
WORD = re.compile(r"[A-Za-z]+")
RAW_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
DIGITS = re.compile(r"\d+")


class Box:
    """A container: its path, whether it lies in a boilerplate part for sure, and the innermost box around it marked by a word."""

    __slots__ = ("tag", "path", "out", "parent", "mark", "mild", "size")

    def __init__(self, tag: str, path: str, out: bool, parent: Box | None, word: str = ""):
        self.tag, self.path, self.out, self.parent = tag, path, out, parent
        self.mark = self if word else parent.mark if parent else None
        self.mild, self.size = word == "part", 0


class Scanner:
    """Tags of a page, each read once from left to right: names and values of attributes one after the other.

    A quoted value that never ends stops at the next ``>``; a tag without an end takes the rest of the page.
    """

    def __init__(self, page: str):
        self.page = page
        self.gone: dict[str, int] = {}  # from where on there is no more of a string

    def find(self, what: str, at: int) -> int:
        if at >= self.gone.get(what, len(self.page)):
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.gone[what] = at
        return found

    def after(self, what: str, at: int) -> int:
        found = self.find(what, at)
        return len(self.page) if found < 0 else found + len(what)

    def attributes(self, at: int) -> tuple[int, dict[str, str], bool]:
        """(end of the tag, those of its attributes that are ``READ``, whether it closes itself)."""
        page, held = self.page, {}
        while m := ATTRIBUTE.match(page, at):
            if m[1]:
                return m.end(), held, page[m.end() - 2] == "/" and m.end() - 2 >= at
            if m.end() == at or m.end() == len(page):
                break
            name, at, value = m[2].lower(), m.end(), ""
            if m[3]:
                quote = page[at]
                if quote in "\"'":
                    end = self.find(quote, at + 1)
                    if end < 0:
                        return self.after(">", at), held, False
                    value, at = page[at + 1 : end], end + 1
                else:
                    bare = BARE.match(page, at)
                    value, at = bare[0], bare.end()
            if name in READ:
                held.setdefault(name, value)
        return len(page), held, False


def _opened(tag: str, attributes: dict[str, str]) -> tuple[str, bool, str]:
    """Generalised step of a path; whether the element is boilerplate by tag or role; whether a class or id says so, as a "whole" or a "part"."""
    out, names, word = tag in OUT_TAGS, [], ""
    for name, value in attributes.items():
        value = html.unescape(value).lower()
        if name == "class":
            names = sorted({DIGITS.sub("#", c) for c in value.split()})
        if name in ("class", "id") and tag not in WHOLE:
            for c in value.split():
                if c in OUT_WORDS:
                    word = "whole"
                elif not word and any(w in OUT_WORDS for w in WORD.findall(c)):
                    word = "part"
        out |= name == "role" and value in OUT_ROLES or name == "hidden" or name == "aria-hidden" and value == "true"
    return ".".join([tag, *names]), out, word


def _ended(stack: list[Box], tag: str) -> None:
    """Take the element that an end tag closes, and what is still open inside it, off the stack."""
    same = HEADINGS if tag in HEADINGS else (tag,)
    beyond = IMPLIED[tag][1] if tag in IMPLIED else ()
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in same:
            del stack[i:]
            return
        if stack[i].tag in beyond:
            return


def _implied(stack: list[Box], tag: str) -> None:
    """Take the elements that a start tag closes off the stack."""
    if stack[-1].tag == "p" and tag not in INSIDE or tag in HEADINGS and stack[-1].tag in HEADINGS:
        stack.pop()
    if tag in IMPLIED:
        ends, beyond = IMPLIED[tag]
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in beyond:
                return
            if stack[i].tag in ends:
                del stack[i:]
                if tag not in ("tr", "tbody"):
                    return
                _implied(stack, tag)
                return


def blocks_of(page: str) -> list[tuple[Box, str, int]]:
    """(container, text, characters in links) of each block outside boilerplate, in page order.

    Boxes marked by a word inside a longer class or id count as boilerplate unless they hold
    more than half of the text. If nothing else is left, that holds for boxes marked by a whole
    class or id too, and after that words do not count at all.
    """
    marks: list[Box] = []
    blocks = list(_blocks(page, marks))
    if not marks:
        return blocks
    total = 0
    for box, text, _ in blocks:
        total += len(text)
        if box.mark:
            box.mark.size += len(text)
    for m in reversed(marks):  # inner ones were opened later
        if m.parent.mark:
            m.parent.mark.size += m.size
    for mild in (True, False):
        clear: set[Box | None] = {None}
        for m in marks:
            if (m.mild or not mild) and 2 * m.size > total and m.parent.mark in clear:
                clear.add(m)
        left = [b for b in blocks if b[0].mark in clear]
        if left:
            return left
    return blocks


def _blocks(page: str, marks: list[Box]) -> Iterator[tuple[Box, str, int]]:
    """The blocks outside what is boilerplate for sure; boxes marked by a word are added to ``marks``."""
    top = Box("", "", False, None)
    stack = [top]
    parts: list[str] = []
    linked, depth, link_from = 0, 0, 0
    at = 0

    def flush():
        nonlocal linked, link_from
        whole = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        found, linked, link_from = linked, 0, 0
        if whole and not stack[-1].out:
            return (stack[-1], whole, found)
        return None

    scan = Scanner(page)
    while m := START.search(page, at):
        piece = page[at : m.start()]
        if m[2]:
            at, attributes, closed = scan.attributes(m.end())
        else:
            at = scan.after("-->" if m[0] == "<!--" else ">", m.end())
        if piece:
            parts.append(piece)
            if depth:
                linked += len(piece)
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                depth = max(0, depth - 1)
            elif tag in BLOCKS or tag in BOXES or tag in OUT_TAGS:
                block = flush()
                if block:
                    yield block
                _ended(stack, tag)
                if tag in BLOCKS or tag in BOXES:
                    depth = 0
            continue
        if tag in RAW:
            end = RAW_ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            depth += 1
        elif tag in BLOCKS or tag in BOXES or tag in OUT_TAGS:
            block = flush()
            if block:
                yield block
            _implied(stack, tag)
            if tag in VOID or closed:
                continue
            step, out, word = _opened(tag, attributes)
            if tag in BOXES or out or word or stack[-1].out or stack[-1].mark:  # all that opens inside boilerplate, so that its ends are not taken for others
                stack.append(Box(tag, f"{stack[-1].path}/{step}", stack[-1].out or out, stack[-1], word))
                if word:
                    marks.append(stack[-1])
    if at < len(page):
        parts.append(page[at:])
    block = flush()
    if block:
        yield block


def _best(blocks: list[tuple[Box, str, int]]) -> tuple[str, int] | None:
    scores: dict[str, float] = {}
    for box, text, linked in blocks:
        worth = len(text) - 2 * linked
        while box is not None and box.tag in ("ul", "ol", "dl", "tbody", "tr", "table", "figure"):
            box = box.parent
        if box is None or box.parent is None:
            continue
        scores[box.path] = scores.get(box.path, 0) + worth
        if box.parent.parent is not None:
            scores[box.parent.path] = scores.get(box.parent.path, 0) + worth / 2
    if not scores:
        return None
    path = min(scores, key=lambda p: (-scores[p], p))
    return path, int(scores[path])


def best_path(page: str | None) -> tuple[str, int] | None:
    """(path, score) of the container with most text; a block counts half for the container around."""
    return _best(blocks_of(page or ""))


def path_key(path: str) -> int:
    return int.from_bytes(hashlib.blake2b(path.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def paths_of(page: str | None) -> tuple[str, int, int, list[int]] | None:
    """(path, score, key) of the best container, and the keys of all containers with text."""
    blocks = blocks_of(page or "")
    best = _best(blocks)
    if best is None:
        return None
    seen: set[Box] = set()
    for box, _, _ in blocks:
        while box.parent is not None and box not in seen:
            seen.add(box)
            box = box.parent
    return *best, path_key(best[0]), sorted({path_key(path) for path in {box.path for box in seen}})


def text_at(page: str | None, paths: list[str]) -> str:
    """Blocks inside the first of ``paths`` that has any, else inside the page's own best container."""
    blocks = list(blocks_of(page or ""))
    for path in paths:
        inside = [t for box, t, _ in blocks if box.path == path or box.path.startswith(path + "/")]
        if inside:
            return "\n".join(inside)
    own = _best(blocks)
    inside = [t for box, t, _ in blocks if own and (box.path == own[0] or box.path.startswith(own[0] + "/"))]
    return "\n".join(inside or [t for _, t, _ in blocks])


def host(url):
    """Lower-case host of a URL; empty without one."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def page_key(page):
    """What stands for a page's html in narrow tables."""
    return F.unhex(F.md5(page))


def mended(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, page, path): the pages that have a path with more votes of their host than their own best one.

    Most votes come first, then most text, then the name. Pages are named by ``page_key``.
    """
    name = free_name(pages, "_best")

    def make():
        def work(data):
            found = (paths_of(d.decode() if d else None) for d in data)
            return [f or (None, None, None, None) for f in found]

        return work

    read = attach(pages.select(column(url).alias("url"), column(page).alias("html")), make, "path string, score long, own long, keys array<long>", name, "html")
    cast = read.select(host(F.col("url")).alias("host"), page_key(F.col("html")).alias("page"), column(name).alias("b")).where("b.path is not null")
    cast = write_table(cast.select("host", "page", "b.*"), "page-paths")
    counted = cast.groupBy("host", F.col("own").alias("key")).agg(F.count("*").alias("n"), F.sum("score").alias("score"), F.min("path").alias("path"))
    counted = write_table(counted, "host-paths")
    has = cast.select("host", "page", "own", F.explode("keys").alias("key"))
    met = join_sized(has, counted, ["host", "key"], "inner", F.xxhash64("page"))
    first = F.min(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path", "key"))
    chosen = met.groupBy("host", "page").agg(first.alias("b"), F.max("own").alias("own"))
    return chosen.where("b.key <> own").select("host", "page", "b.path")


def main_texts(pages: DataFrame, url: str = "url", page: str = "html", name: str = "main_text") -> DataFrame:
    """``pages`` with their main text as ``name``; null and empty pages have an empty one.

    Pages without a readable host vote together. Every page is judged on its whole html;
    repeated pages vote as often as they are there.
    """
    held, key, path = (free_name(pages, x) for x in ("_host", "_page", "_path"))
    small_batches(pages)
    other = write_table(mended(pages, url, page), "pages-mended")
    keyed = pages.withColumn(held, host(column(url))).withColumn(key, page_key(column(page)))
    spread = F.xxhash64(column(page))
    met = join_sized(keyed, other.select(F.col("host").alias(held), F.col("page").alias(key), F.col("path").alias(path)), [held, key], "left", spread)
    at_page, at_path = met.columns.index(page), met.columns.index(path)

    def run(batches):
        for batch in batches:
            data, chosen = batch.column(at_page).to_pylist(), batch.column(at_path).to_pylist()
            for a, b in slices(len(x or "") for x in data):
                made = [text_at(d, [p] if p else []) for d, p in zip(data[a:b], chosen[a:b])]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, name])

    return met.mapInArrow(run, T.StructType([*met.schema.fields, T.StructField(name, T.StringType())])).drop(held, key, path)


def digest(pages: DataFrame) -> DataFrame:
    return main_texts(pages.select("page_id", "url", "html")).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"),
    )
