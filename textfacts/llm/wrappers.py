"""Main text of web pages by wrapper induction.

Pages of one host are made from templates.  Simple tree matching maps a block onto
another only where all their ancestors are mapped, that is along the same path of
tags from the root.  So the blocks that keep their text in the merged tree of all
pages of a host are those of equal path and text, and they are counted by that key
over every page of the host: no page stands in for the others, and a page of any
length costs linear time.  Blocks met on more than half of the host's pages are
template, the others are slots.  Copies of a page or of an article count as one
page, so that a repeated article is no template.  ``align`` is the matching of two single trees.

What is left of a page are its varying slots, and which of them are the article is
induced as well.  A slot is a path of elements with their classes; its text, the part
of it inside links, and its headings are summed over all distinct pages of the host.
From the root down, the article's region is the element that holds most of the text of
the one above, as long as that one is a container.  Beside the way down, slots that are
mostly links, or that hold little text beside the region and no heading, are furniture
(see :func:`furniture_slots`): no word list is asked for that.

Roles are known besides: elements and ARIA roles that HTML defines as menus, footers,
forms and the like, and whole class or id names such as "comments" or "site-footer" for
slots that read like an article (reader comments, long adverts) or hosts with too few
pages to induce anything.  A class name never removes the induced region itself.
"""

from __future__ import annotations

import html as html_lib
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: Elements whose content is no text of the page.
SKIP = {"noscript", "template", "svg", "canvas", "object", "select", "datalist", "option", "button", "math", "audio", "video", "map"}
#: Of these, elements that cannot stand in one another: a second start tag leaves the first without an end tag.
FLAT = {"noscript", "select", "datalist", "button"}
#: Of these, elements that the end tag of an element around them does not end if they have an end tag of their own.
CLOSED = {"noscript", "template", "object", "select"}
#: Tags that end an option besides those of blocks; its own end tag may be omitted.
ENDS_OPTION = {"option", "optgroup", "select", "datalist"}
#: Start tags that end svg and math, unless in one of their elements that hold HTML.
ENDS_FOREIGN = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li menu ol p pre s small span strong strike sub sup table tt u ul var".split())
HOLDS_HTML = {"foreignobject", "desc", "annotation-xml", "mi", "mo", "mn", "ms", "mtext"}
#: Elements that hold raw text up to their end tag; it is no text of the page either.
RAW = {"script", "style", "iframe", "title", "textarea", "xmp", "noembed", "noframes"}
#: Elements that are furniture.
FURNITURE = {"nav", "footer", "aside", "form", "menu", "dialog", "header"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Opening one of these ends an open paragraph.
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: Words of a class or id that mark furniture.
MARKS = set(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets footer header masthead "
    "comment comments commentlist disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar topbar skip copyright legal disclaimer".split()
)
#: Parts that may stand beside a mark in a compound name.
BESIDE = set("site page main top bottom left right primary secondary wrapper wrap container box list item items inner outer block section area global bar post js col row content".split())
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*(?:>|$)", re.S)
_ENDS = re.compile("[>\"']")
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_PART = re.compile(r"[-_\d]+|(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")
#: A host's block is template when met on more than half of the host's distinct pages, and on 3 or more (2 where a host has 2).
LEAST_PAGES = 3
#: A page counts as one of its own if its text not shared with most of the host is at least 1/OWN_PART of the shared text (as long as
#: it, where the host has fewer than LEAST_PAGES distinct pages); other pages with the same longest shared block count once.
OWN_PART = 8


#: A slot outside the region is thin with less than 1/THIN of the region's text.
THIN = 8


class Node:
    """An element, or a text block ('#'): ``out`` by its role, ``soft`` by a class name; ``slot`` its path with classes."""

    __slots__ = ("tag", "out", "soft", "children", "text", "linked", "key", "slot")

    def __init__(self, tag: str, out: bool, soft: frozenset[int] = frozenset(), slot: int = 0):
        self.tag, self.out, self.soft, self.slot = tag, out, soft, slot
        self.children, self.text, self.linked, self.key = [], "", 0, 0


def _marked(name: str) -> bool:
    """Whether a class or id name says furniture: a mark, alone or beside words that say nothing else."""
    parts = [x.lower() for x in _PART.split(name) if x]
    return any(x in MARKS for x in parts) and all(x in MARKS or x in BESIDE for x in parts)


@lru_cache(50_000)
def _roles(tag: str, attributes: str) -> tuple[bool, bool, str]:
    """Furniture by element or role, furniture by a class or id name, and the classes, sorted."""
    out = tag in FURNITURE
    if "=" not in attributes:
        return out, False, ""
    marked, classes = False, ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "role" and value.lower() in ROLES or name == "aria-hidden" and value.lower() == "true":
            out = True
        if name in ("class", "id"):
            marked = marked or any(map(_marked, value.split()))
        if name == "class":
            classes = " ".join(sorted(value.split()))
    return out, marked, classes


@lru_cache(100_000)
def _slot(parent: int, tag: str, classes: str) -> int:
    """Hash of the path of elements and classes down to an element."""
    return int.from_bytes(blake2b(f"{parent} {tag} {classes}".encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


#: Start, end, 1 for an end tag, name ('' for what is no tag, '[' for CDATA) and attributes.
Token = tuple[int, int, bool, str, str]


def _tokens(page: str) -> list[Token]:
    """The tags of a page in order; a raw element is one token of no name."""
    out: list[Token] = []
    at, failed = 0, []
    while m := _TAG.search(page, at):
        at = m.end()
        tag = m[2]
        if tag is None:
            out.append((m.start(), at, False, "[" if m[0].startswith("<![CDATA[") else "", m[0]))
            continue
        end = _tag_end(page, at, failed)
        if end < 0:  # no tag: it never ends
            continue
        tag, attributes, at = tag.lower(), page[at:end], end + 1
        if tag in RAW and not m[1]:
            # No markup inside; without an end tag the rest of the page belongs to it.
            close = _RAW_END[tag].search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(page)
            out.append((m.start(), at, False, "", ""))
            continue
        out.append((m.start(), at, m[1] == "/", tag, attributes))
    return out


def _tag_end(page: str, at: int, failed: list[list[int]]) -> int:
    """Place of the first '>' from ``at`` that is in no quotes, or -1.

    A quote that is never closed is an ordinary character.  ``failed`` keeps the
    bounds of the quoted parts of searches in vain: another one that starts outside
    of them would end alike, so that no page takes quadratic time.
    """
    for bounds in failed:
        if at >= bounds[0] and bisect_right(bounds, at) % 2:
            return -1
    bounds = [at]
    while m := _ENDS.search(page, at):
        at = m.end()
        if m[0] == ">":
            return at - 1
        close = page.find(m[0], at)
        if close >= 0:
            bounds += [at, close + 1]
            at = close + 1
    failed.append(bounds)
    return -1


def _closed(tokens: list[Token]) -> dict[int, int]:
    """Start tags of skipped elements that have an end tag, and where."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for k, (_, _, end, tag, attributes) in enumerate(tokens):
        if tag in SKIP:
            starts = opened.setdefault(tag, [])
            if end:
                if starts:
                    ends[starts.pop()] = k
            elif not attributes.rstrip().endswith("/"):
                if tag in FLAT:
                    starts.clear()
                starts.append(k)
    return ends


def _behind(tokens: list[Token], k: int, ends: dict[int, int], around: set[str]) -> int:
    """The first token that is not in the skipped element which token k starts.

    It ends at its own end tag or before the end tag of a block around it; without
    an end tag of its own it also ends before the next block.
    """
    name, end = tokens[k][3], ends.get(k)
    if end is not None and name in CLOSED:
        return end
    inner: dict[str, int] = {}
    held = 0
    k += 1
    while k < len(tokens) and k != end:
        _, _, closes, tag, _ = tokens[k]
        if name == "option":
            if tag in BLOCK or tag in ENDS_OPTION:
                break
        elif closes:
            if tag in HOLDS_HTML:
                held -= held > 0
            elif inner.get(tag):
                inner[tag] -= 1
            elif tag in around:
                break
        elif tag in SKIP and k in ends and (end is None or ends[k] < end):
            k = ends[k]
        elif tag in HOLDS_HTML:
            held += 1
        elif not held and (tag in ENDS_FOREIGN if name in ("svg", "math") else end is None and tag in BLOCK):
            break
        elif end is None and tag in BLOCK:
            break
        elif tag in BLOCK:
            inner[tag] = inner.get(tag, 0) + 1
        k += 1
    return k


def parse(page: str) -> Node:
    """The block tree of a page: block elements, and '#' leaves with the text of a block."""
    root = Node("html", False)
    stack: list[tuple[str, Node]] = [("html", root)]
    pieces: list[str] = []
    depth_article = depth_link = linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = _BLANK.sub(" ", html_lib.unescape("".join(pieces))).strip(" ")
            pieces.clear()
            if text:
                up = stack[-1][1]
                leaf = Node("#", up.out, up.soft, up.slot)
                leaf.text, leaf.linked = text, min(linked, len(text))
                up.children.append(leaf)
            linked = 0

    def pop_to(k: int) -> None:
        nonlocal depth_article
        flush()
        depth_article -= sum(t == "article" for t, _ in stack[k:])
        del stack[k:]

    tokens = _tokens(page)
    ends = _closed(tokens)
    at = k = 0
    while k < len(tokens):
        start, end, closes, tag, attributes = tokens[k]
        if start > at:
            pieces.append(page[at:start])
            linked += depth_link and start - at
        at = end
        k += 1
        if not tag:
            continue
        if tag == "[":
            pieces.append(html_lib.escape(attributes[9:].removesuffix("]]>")))
            continue
        if tag == "a":  # a second link ends the first
            depth_link = int(not closes)
            continue
        if closes:
            if tag in BLOCK:
                for n in range(len(stack) - 1, 0, -1):
                    if stack[n][0] == tag:
                        pop_to(n)
                        break
            continue
        if tag in SKIP:
            if not attributes.rstrip().endswith("/"):
                k = _behind(tokens, k - 1, ends, {t for t, _ in stack[1:]})
                at = tokens[k][0] if k < len(tokens) else len(page)
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in BLOCK:
            continue
        if tag in ("html", "body"):
            continue
        flush()
        if tag in ENDS_P and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        if closed := CLOSES.get(tag):
            for n in range(len(stack) - 1, 0, -1):
                if stack[n][0] in closed:
                    pop_to(n)
                    break
                if stack[n][0] in ("ul", "ol", "dl", "table"):
                    break
        if tag in VOID:
            continue
        up = stack[-1][1]
        out, marked, classes = _roles(tag, attributes)
        slot = _slot(up.slot, tag, classes)
        node = Node(tag, up.out or out and not (tag == "header" and depth_article), up.soft | {slot} if marked and tag not in ("main", "article") else up.soft, slot)
        up.children.append(node)
        stack.append((tag, node))
        depth_article += tag == "article"
    if at < len(page):
        pieces.append(page[at:])
    pop_to(1)
    return root


_paths: dict[tuple[bytes, str, bool], bytes] = {}


def _path(parent: bytes, tag: str, out: bool) -> bytes:
    """Hash of the path of tags down to an element."""
    if (known := _paths.get((parent, tag, out))) is None:
        if len(_paths) > 100_000:
            _paths.clear()
        known = _paths[parent, tag, out] = blake2b(f"{tag} {out}".encode(), digest_size=8, salt=parent).digest()
    return known


def blocks(root: Node) -> list[Node]:
    """The text blocks in page order; each that is no furniture gets the key of its path and text."""
    out, todo = [], [(root, b"")]
    while todo:
        node, path = todo.pop()
        if node.tag == "#":
            out.append(node)
            if not node.out:
                node.key = int.from_bytes(blake2b(node.text.encode("utf-8", "replace"), digest_size=8, salt=path).digest(), "little", signed=True)
        elif node.children:
            path = _path(path, node.tag, node.out)
            todo.extend((child, path) for child in reversed(node.children))
    return out


#: Weight of a mapped pair of nodes; of mappings of equal size the one with more equal texts wins.
_PAIR = 1 << 32


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of text blocks that simple tree matching maps onto each other: the full table at any size of page."""
    if a.tag != b.tag or a.out != b.out:
        return []
    weights: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[Node, Node]]] = {}
    todo = [(a, b, False)]
    while todo:
        x, y, ready = todo.pop()
        if not ready:  # first all pairs of children, then this pair
            todo.append((x, y, True))
            todo.extend((u, v, False) for u in x.children for v in y.children if u.tag == v.tag and u.out == v.out)
            continue
        p, q = x.children, y.children
        w = [[weights.get((id(u), id(v)), 0) for v in q] for u in p]
        best = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i, row in enumerate(w):
            for j, s in enumerate(row):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + s)
        mapped = []
        i, j = len(p), len(q)
        while i and j:
            if w[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + w[i - 1][j - 1]:
                mapped.append((p[i - 1], q[j - 1]))
                i, j = i - 1, j - 1
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        weights[id(x), id(y)] = _PAIR + (x.tag == "#" and x.text == y.text) + best[-1][-1]
        pairs[id(x), id(y)] = mapped
    out, down = [], [(a, b)]
    while down:
        x, y = down.pop()
        if x.tag == "#":
            out.append((x, y))
        down.extend(pairs[id(x), id(y)])
    return out


def slots(root: Node) -> list[tuple[int, int, bool, int, int, bool]]:
    """slot, parent, whether it holds elements with text, text, linked text and whether there is a heading, of every slot of a page.

    Sums of the whole subtree; equal paths are one slot.  Furniture by role counts nowhere.
    """
    found: dict[int, list] = {}
    todo: list[tuple[Node, Node | None, bool]] = [(root, None, False)]
    sums: dict[int, list] = {}
    while todo:
        node, up, ready = todo.pop()
        if not ready:
            sums[id(node)] = [0, 0, False, False]
            todo.append((node, up, True))
            todo.extend((c, node, False) for c in node.children if c.tag != "#" and not c.out)
            continue
        s = sums.pop(id(node))
        for c in node.children:
            if c.tag == "#" and not c.out:
                s[0] += len(c.text)
                s[1] += c.linked
        s[2] = s[2] or node.tag in HEADINGS and s[0] > 0
        kept = found.setdefault(node.slot, [up.slot if up else 0, False, 0, 0, False])
        kept[1] = kept[1] or s[3]
        kept[2] += s[0]
        kept[3] += s[1]
        kept[4] = kept[4] or s[2]
        if up and s[0]:
            o = sums[id(up)]
            o[0] += s[0]
            o[1] += s[1]
            o[2] = o[2] or s[2]
            o[3] = True
    return [(slot, *v) for slot, v in found.items()]


def furniture_slots(stats: list[tuple[int, int, bool, int, int, bool]]) -> tuple[list[int], list[int]]:
    """Slots that are furniture, and the slots on the way to the article's region, from slots summed over a host's pages.

    The way leads from the root to the element that holds at least half of the text of
    the one before, while that one holds elements of its own.  Beside it a slot is
    furniture if half of its text or more is in links, or if it has no heading and less
    than 1/THIN of the region's text.
    """
    of = {x[0]: x for x in stats}
    below: dict[int, list[int]] = {}
    for slot, parent, *_ in stats:
        if slot:
            below.setdefault(parent, []).append(slot)
    if 0 not in of or not of[0][3]:
        return [], []
    way = [0]
    while True:
        best = max(below.get(way[-1], ()), key=lambda k: (of[k][3] - of[k][4], k), default=None)
        if best is None or not of[best][2] or 2 * of[best][3] < of[way[-1]][3] or 2 * of[best][4] >= of[best][3]:
            break
        way.append(best)
    region = of[way[-1]][3]
    beside = [k for a in way[:-1] for k in below.get(a, ()) if k not in way]
    return [k for k in beside if 2 * of[k][4] >= of[k][3] > 0 or not of[k][5] and THIN * of[k][3] < region], way


def main_text(page: str, template: Iterable[int] = (), furniture: Iterable[int] = (), way: Iterable[int] = ()) -> str:
    """The page's content blocks joined by two line ends.

    Left out are blocks whose key is in ``template``, those under a slot of
    ``furniture``, and those under a marked slot that is not on the ``way`` to the
    article's region.
    """
    template, furniture, way = frozenset(template), frozenset(furniture), frozenset(way)
    root = parse(page)
    blocks(root)
    out: list[str] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "#":
            if not node.out and node.key not in template and node.soft <= way:
                out.append(node.text)
        elif node.slot not in furniture:
            todo.extend(reversed(node.children))
    return "\n\n".join(out)


def host_of(url: Column) -> Column:
    """Host of an address, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


_SLOTS = "slots array<struct<slot:long,parent:long,holds:boolean,text:long,linked:long,heading:boolean>>"


def _furniture(distinct: DataFrame) -> DataFrame:
    """host, furniture and way, from the slots of its distinct pages."""
    total = materialize(distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages")))
    each = distinct.select("host", F.explode("slots").alias("s")).select("host", "s.*")
    sums = each.groupBy("host", "slot", "parent").agg(F.count(F.lit(1)).alias("n"), F.max("holds").alias("holds"), F.sum("text").alias("text"), F.sum("linked").alias("linked"), F.max("heading").alias("heading"))
    # Slots of the site's structure are met on more than half of its pages: at most twice the slots of a page per host.
    often = _by_host(sums, total, F.lit(0)).filter((F.col("pages") >= LEAST_PAGES) & (2 * F.col("n") > F.col("pages")))
    lists = often.groupBy("host").agg(F.collect_list(F.struct("slot", "parent", "holds", "text", "linked", "heading")).alias("slots"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [furniture_slots(sorted(tuple(x.values()) for x in row)) for row in batch.column(1).to_pylist()]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in found], longs), pa.array([w for _, w in found], longs)], ["host", "furniture", "way"])

    return materialize(lists.mapInArrow(decide, "host string, furniture array<long>, way array<long>"))


def induce(pages: DataFrame) -> DataFrame:
    """host, the keys of its template blocks, its furniture and its way to the article, from host and html of all pages."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = []
                for host, page in zip(*(c.to_pylist() for c in part.columns)):
                    root = parse(page)
                    found = [b for b in blocks(root) if not b.out]
                    if found:
                        body = blake2b(b"".join(b.key.to_bytes(8, "little", signed=True) for b in found), digest_size=8).digest()
                        rows.append((host, int.from_bytes(body, "little", signed=True), {b.key: len(b.text) for b in found}, slots(root)))
                arrays = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())]
                arrays += [pa.array([list(r[2]) for r in rows], pa.list_(pa.int64())), pa.array([list(r[2].values()) for r in rows], pa.list_(pa.int32()))]
                names = ("slot", "parent", "holds", "text", "linked", "heading")
                kind = pa.list_(pa.struct(dict(zip(names, (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_())))))
                arrays.append(pa.array([[dict(zip(names, x)) for x in r[3]] for r in rows], kind))
                yield pa.RecordBatch.from_arrays(arrays, ["host", "body", "keys", "lengths", "slots"])

    read_pages = pages.select("host", "html").mapInArrow(read, f"host string, body long, keys array<long>, lengths array<int>, {_SLOTS}")
    # Pages of the same blocks count once.
    distinct = materialize(read_pages.dropDuplicates(["host", "body"]))
    furniture = _furniture(distinct.select("host", "slots"))
    distinct = distinct.drop("slots")
    common = _constant(distinct.select("host", F.col("body").alias("who"), "keys"))
    # Pages that hold little besides what most of the host's pages share may be copies of one article: they count once for each such article.
    held = _by_host(distinct, common, 8 * F.size("template")).withColumn("shared", F.filter(F.arrays_zip("keys", "lengths"), lambda b: F.array_contains("template", b["keys"])))
    n_shared = F.aggregate("shared", F.lit(0).cast("long"), lambda n, b: n + b["lengths"])
    n_own = F.aggregate("lengths", F.lit(0).cast("long"), lambda n, length: n + length) - n_shared
    longest = F.array_max(F.transform("shared", lambda b: F.struct(b["lengths"], b["keys"])))["keys"]
    own = n_own * F.when(F.col("pages") < LEAST_PAGES, 1).otherwise(OWN_PART) >= n_shared
    constant = _constant(held.select("host", F.when(own, F.col("body")).otherwise(longest).alias("who"), F.col("shared")["keys"].alias("keys")))
    return materialize(constant.select("host", "template").join(furniture, "host", "full"))


def _constant(pages: DataFrame) -> DataFrame:
    """host, template (keys met on enough of the host's pages) and pages (their number), from host, who and keys."""
    total = pages.groupBy("host").agg(F.count_distinct("who").alias("pages"))
    met = pages.select("host", "who", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count_distinct("who").alias("n"))
    often = _by_host(met.filter(F.col("n") > 1), materialize(total), F.lit(0)).filter((F.col("n") >= F.least(F.lit(LEAST_PAGES), F.col("pages"))) & (2 * F.col("n") > F.col("pages")))
    # At most twice the blocks of a page per host.
    return materialize(often.groupBy("host").agg(F.collect_list("key").alias("template"), F.max("pages").alias("pages")))


#: Tables of hosts of more bytes than this are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def _by_host(rows: DataFrame, hosts: DataFrame, size: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with a table of hosts, whose rows hold about ``size`` bytes besides the host."""
    total = hosts.agg(F.sum(size + F.octet_length("host") + 64)).first()[0] or 0
    return rows.join(F.broadcast(hosts) if total <= BROADCAST_BYTES else hosts, "host", how)


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A null html counts as empty and gives the empty text; pages without a host
    form one host of their own; repeated rows give repeated results; other
    columns are not read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))
    wrappers = induce(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = [main_text(page, *(x or () for x in known)) for page, *known in zip(*(c.to_pylist() for c in part.columns[2:]))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    size = 8 * sum((F.coalesce(F.size(c), F.lit(0)) for c in ("template", "furniture", "way")), F.lit(0))
    joined = _by_host(rows, wrappers, size, "left").select("page_id", "url", "html", "template", "furniture", "way")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))
