"""Main text of web pages: site template removal by counted subtree hashes.

Each page is parsed into a light tree in one pass. Its block elements are hashed (tag, class, id and all that is in
them) and counted in Spark by host: in how many different pages each stands (copies of one page count once). What
recurs across many pages of its host is template and goes: outside of the article at a small share of the host's pages,
inside of it only at half of them, so that passages that some articles share stay. Elements outside of the article that
are mostly links are counted by their shape too (tags and classes without the text), since menus change from page to
page while their shape recurs. Then what HTML itself marks as no content goes (nav, aside, form, script, style ..., the
page's header and footer), and elements whose class, id or role names an advert, comments or another such part. An
element that holds the article is never removed, and one that holds most of the page's text only if it recurs. The blocks of the main element or articles
that are left, or of the page, are the text.

The template's hashes, keyed by host, are sorted arrays in the shared folder, which workers map, so that no page is
shuffled and a host may have any share of the pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from texlith.llm._common import cleaned, free, mixed, slices, written
from texlith.llm.stores import ROWS, Store, by_part, cuts, part_of

_TOKEN = re.compile(r"[^<]+|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^<>\"']*(?:\"[^\"<>]*\"[^<>\"']*|'[^'<>]*'[^<>\"']*)*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s=>/]+)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
#: Element names by their meaning in HTML (fixed values).
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img picture".split())
_DROPPED = frozenset("nav aside form script style noscript template iframe object embed svg canvas math audio video map button select option textarea input dialog menu head title".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = frozenset("ul ol dl table tbody thead tfoot tr div article section main body aside nav header footer form blockquote".split())
_TOPS = frozenset("article main body".split())
#: Words that name no content as the first or last of a class, id or role.
_BOILER = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs"
    " header masthead footer sidebar sidebars comment comments commentlist respond disqus replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter"
    " subscribe subscription signup login search share sharing social related recommended widget widgets pagination pager toolbar copyright complementary contentinfo skip".split()
)
#: Those that may be part of an article.
_WITHIN = frozenset("header masthead notice notices alert banner navigation search login widget copyright menu overlay".split())
#: First words that say something about an element's surroundings or state.
_STATE = frozenset("no not has is with without js show hide".split())
#: Elements whose text doesn't count as a page's own.
_ASIDE = frozenset("nav aside footer dialog menu".split())
_HAS = re.compile(r"class|id|role", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Least share of link text, and least number of links, of what is counted by its shape.
LINK_SHARE, LINKS = 0.6, 3
_OUTSIDE, _INSIDE, _SHAPE, _PAGE = range(4)


class _Node:
    __slots__ = ("children", "digest", "kind", "linked", "links", "marks", "parent", "protected", "shape", "size", "tag", "whole")

    def __init__(self, tag: str, marks: tuple, parent: _Node | None):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.protected = self.whole = False
        self.kind, self.digest, self.shape, self.size, self.linked, self.links = _OUTSIDE, 0, 0, 0, 0, 0


class _Open:
    """The elements that are open, with the depths of those that end tags ask for: each step takes the same time at any depth."""

    def __init__(self, root: _Node):
        self.stack, self.named = [root], {}
        self.bounds, self.tops, self.blocks = [0], [0], [0]

    def push(self, node: _Node) -> None:
        at, tag = len(self.stack), node.tag
        self.stack.append(node)
        self.named.setdefault(tag, []).append(at)
        if tag in _BOUNDS:
            self.bounds.append(at)
        if tag in _TOPS:
            self.tops.append(at)
        if tag not in _INLINE:
            self.blocks.append(at)

    def close(self, at: int) -> None:
        """Closes the element at a depth and all in it."""
        while len(self.stack) > at:
            self.named[self.stack.pop().tag].pop()
        for held in (self.bounds, self.tops, self.blocks):
            while held[-1] >= at:
                held.pop()

    def last(self, names) -> int:
        return max((self.named[n][-1] for n in names if self.named.get(n)), default=-1)


def _tag(page: str, place: int, last_quote: dict[str, int]) -> tuple[int, list[tuple[str, str]]]:
    """Where the tag that begins at `place` ends (-1: nowhere), and its attributes; quotes count after `=` only."""
    at, found = _NAME.match(page, place).end(), []
    while m := _ATTRIBUTE.match(page, at):
        name, at, value = m[1], m.end(), ""
        if m[2]:
            quote = page[at : at + 1]
            if quote in ("'", '"') and quote:
                if at >= last_quote[quote]:
                    break  # never closed: the tag ends at the next >
                close = page.index(quote, at + 1)
                value, at = page[at + 1 : close], close + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.append((name.lower(), value))
    return page.find(">", at) + 1 or -1, found


def _marks(attributes: list[tuple[str, str]]) -> tuple:
    return tuple((k, v) for k, v in attributes if k in ("class", "id", "role", "hidden", "aria-hidden"))


def parse(page: str) -> _Node:
    """A tree of elements and text, in time linear in the page. Tags that HTML closes by itself are closed; end tags without a start are ignored."""
    root = _Node("", (), None)
    opened, place, end = _Open(root), 0, len(page)
    last_end, last_quote = page.rfind(">"), {q: page.rfind(q) for q in "'\""}
    while place < end:
        at = opened.stack[-1]
        m = _TOKEN.match(page, place)
        if m is None:  # a < that begins no well-formed tag
            stop = -1
            if _NAME.match(page, place) and place < last_end:
                stop, attributes = _tag(page, place, last_quote)
            if stop < 0:
                at.children.append("<")
                place += 1
                continue
            token = page[place:stop]
        else:
            token, stop, attributes = m[0], m.end(), None
        start, place = place, stop
        if token[0] != "<":
            at.children.append(html.unescape(token) if "&" in token else token)
            continue
        if token[1] in "!?":
            continue
        name = _NAME.match(token)[1].lower()
        if token[1] == "/":
            bound = opened.bounds[-1] if name in ("p", "li") else opened.tops[-1] if name in _INLINE else 0
            found = opened.last((name,))
            if found > 0 and (found > bound or found == bound and opened.stack[found].tag == name):
                opened.close(found)
            continue
        if name in _CLOSES:
            found = opened.last(_CLOSES[name])
            held = next((b for b in reversed(opened.bounds) if opened.stack[b].tag != "tr"), 0)
            if found > held:
                opened.close(max(held + 1, min(opened.named[n][-1] for n in _CLOSES[name] if opened.named.get(n) and opened.named[n][-1] > held)))
        elif name not in _INLINE and name not in _VOID and name not in _RAW and opened.stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])  # a block ends an open paragraph, and the inline elements left open in it
        if attributes is None:
            attributes = _tag(page, start, last_quote)[1] if _HAS.search(token) else []
        node = _Node(name, _marks(attributes), opened.stack[-1])
        opened.stack[-1].children.append(node)
        if name in _VOID or token.endswith("/>"):
            continue
        if name in _RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, place)
            node.children.append(page[place : close.start() if close else end])
            place = close.end() if close else end
            continue
        opened.push(node)
    return root


def _named(node: _Node, within: bool) -> bool:
    """Whether class, id or role name a part that is no content."""
    for k, v in node.marks:
        if k == "hidden" or k == "aria-hidden":
            if k == "hidden" or v.lower() == "true":
                return True
            continue
        for token in v.split():
            words = [w.lower() for w in _WORD.findall(token)]
            if words and words[0] not in _STATE:
                for w in (words[0], words[-1]):
                    if w in _BOILER and not (within and w in _WITHIN):
                        return True
    return False


def _boiler(node: _Node, within: bool) -> bool:
    """Whether an element is no content by HTML's meaning or its name. What holds most of the text is content."""
    if node.tag in _RAW or node.tag in ("head", "noscript", "template"):
        return True
    if node.protected:
        return False
    if node.tag in _DROPPED or node.tag in ("header", "footer") and not within:
        return True
    return bool(node.marks) and node.tag not in ("body", "html", "article", "main") and _named(node, within)


def _ordered(root: _Node) -> list[_Node]:
    """All elements, each before those in it."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if c.__class__ is _Node]
    return out


def measure(page: str) -> list[_Node]:
    """A page's elements, the root first, with sizes, digests, and whether they are outside of the article or inside."""
    root = parse(page)
    nodes = _ordered(root)
    for node in reversed(nodes):
        size = linked = links = 0
        parts = [node.tag, *(v for _, v in node.marks)] if node.marks else [node.tag]
        shape = parts.copy()
        if node.tag not in _RAW:
            for c in node.children:
                if c.__class__ is _Node:
                    size, linked, links = size + c.size, linked + c.linked, links + c.links
                    if c.size:
                        parts.append(str(c.digest))
                        if c.tag not in _INLINE:
                            shape.append(str(c.shape))
                else:
                    words = c.split()
                    if words:
                        text = " ".join(words)
                        size += len(text)
                        parts.append(text)
        if node.tag == "a":
            linked, links = size, links + 1
        node.size, node.linked, node.links = size, linked, links
        if size:
            node.digest = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "replace"))
            if links >= LINKS or node.tag not in _INLINE:
                node.shape = xxhash.xxh3_64_intdigest("\x00".join(dict.fromkeys(shape)).encode("utf-8", "replace"))
    hidden = sum(n.size for n in nodes if n.tag in _ASIDE and n.parent.tag not in _ASIDE)
    least = max(1, (root.size - hidden) / 2)
    for node in reversed(nodes):
        if node.tag in ("article", "main") and node.size >= least / 2:
            while node is not None and not node.whole and node.tag not in _ASIDE:
                node.protected = node.whole = True
                node = node.parent
        elif node.size > least and node.tag not in _INLINE and node.tag not in _ASIDE:
            node.protected = True
    for node in nodes:
        if node.tag in ("article", "main") or node.parent is not None and node.parent.kind == _INSIDE:
            node.kind = _INSIDE
    return nodes


def counted(nodes: list[_Node]) -> Iterator[tuple[int, int, _Node]]:
    """(kind, digest, element) of what may be template: block elements with text that don't hold the article, outside of the article those that are mostly links by shape too."""
    for node in nodes:
        if node.size and node.tag and not node.whole and node.tag not in _INLINE and node.tag not in _RAW and node.tag not in ("html", "body", "head"):
            yield node.kind, node.digest, node
            if node.kind == _OUTSIDE and node.links >= LINKS and node.linked >= LINK_SHARE * node.size:
                yield _SHAPE, node.shape, node


def _keys(host: int, kinds: list[int], digests: list[int]) -> np.ndarray:
    """One number for each of a host's subtrees of a kind."""
    return mixed(np.uint64(host) ^ (np.array(digests, np.uint64) * np.uint64(4) + np.array(kinds, np.uint64)) * np.uint64(0x9E3779B97F4A7C15))


def _content(root: _Node) -> list[_Node]:
    """The main elements, else the outermost articles, else the page."""
    for tag in ("main", "article"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == tag:
                found.append(node)
            elif not _boiler(node, False):
                stack += [c for c in reversed(node.children) if c.__class__ is _Node]
        if any(n.size for n in found):
            return found
    return [root]


def extract(page: str, template: frozenset[tuple[int, int]] = frozenset()) -> str:
    """The text of a page without the (kind, digest) of template: blocks joined by a line end."""
    nodes = measure(page)
    return text_of(nodes[0], {id(n) for kind, digest, n in counted(nodes) if (kind, digest) in template})


def text_of(root: _Node, gone: set[int]) -> str:
    """The text of a measured page without the elements whose id() is in `gone`."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            blocks.append(text)
        held.clear()

    for top in _content(root):
        stack: list = [(top, False)]
        while stack:
            node, over = stack.pop()
            if isinstance(node, str):
                held.append(node)
            elif over:
                flush()
            elif node is top or id(node) not in gone and not _boiler(node, top.tag != ""):
                if node.tag in ("br", "wbr", "img"):
                    held.append(" " if node.tag == "br" else "")
                    continue
                if node.tag not in _INLINE:
                    flush()
                    stack.append((node, True))
                stack += [(c, False) for c in reversed(node.children)]
        flush()
    return "\n".join(blocks)


def host_of(url: Column) -> Column:
    """A url's host in lower case without a port, a user or www.; '' for a null or odd url."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


@cleaned
def extract_pages(pages: DataFrame, min_pages: int = 5, min_share: float = 0.1, inside_share: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html, ...).

    A subtree is template if at least `min_pages` different pages, and `min_share` of the different pages of its host
    (`inside_share` for one inside of an article), have it. Null html is empty and gives an empty text; a null or odd
    url is the host ''. Repeated rows stay repeated and count once; other columns aren't read; an empty table gives no
    rows. Pages are parsed whole, in time linear in their length.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html", F.xxhash64(host_of(F.col("url"))).alias("host"))
    parts = spark.sparkContext.defaultParallelism

    def hashed(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            out = []
            for host, page in zip(batch["host"], batch["html"], strict=True):
                nodes = measure(page or "")
                whole = xxhash.xxh3_64_intdigest(text_of(nodes[0], set()).encode("utf-8", "replace"))
                found = list({(kind, digest) for kind, digest, _ in counted(nodes)})
                keys = _keys(host & 2**64 - 1, [k for k, _ in found], [d for _, d in found]) if found else np.zeros(0, np.uint64)
                kinds = np.array([k for k, _ in found], np.int8)
                out.append((host, np.uint64(whole).view(np.int64), np.append(keys.view(np.int64), host), np.append(kinds, np.int8(_PAGE))))
            yield pd.DataFrame(out, columns=["host", "page", "keys", "kinds"])

    seen = pages.select("host", "html").mapInPandas(hashed, "host long, page long, keys array<long>, kinds array<tinyint>")
    each = seen.select("host", "page", F.explode(F.arrays_zip("keys", "kinds")).alias("e")).select("host", "page", F.col("e.keys").alias("key"), F.col("e.kinds").alias("kind")).distinct()
    counts = each.groupBy("host", "key", "kind").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    counts = written(counts)
    # Under the kind of a page, a host's own key counts its pages.
    sizes_of = counts.where(F.col("kind") == _PAGE).select("host", F.col("n").alias("size"))
    share = F.when(F.col("kind") == _INSIDE, inside_share).otherwise(min_share)
    often = counts.where(F.col("kind") != _PAGE).join(sizes_of, "host").where(F.col("n") >= F.col("size") * share)

    def dealt(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            keys = batch["key"].to_numpy(np.int64).view(np.uint64)
            yield pd.DataFrame([("key", k, keys[at].tobytes()) for k, at in cuts(part_of(keys, parts), parts)], columns=["kind", "part", "data"])

    store = Store(spark)

    def kept(part: int, blobs: dict[str, list[bytes]]) -> list[tuple[str, int, bytes]]:
        data = np.unique(np.frombuffer(b"".join(blobs["key"]), np.uint64)).tobytes()
        return [*store.write(0, part, data), ("stat", part, np.int64(len(data)).tobytes())]

    sizes = np.zeros(parts, np.int64)
    for r in store.ran(by_part(often.select("key").mapInPandas(dealt, ROWS), parts, kept)).where("kind = 'stat'").toLocalIterator():
        sizes[r["part"]] = np.frombuffer(r["data"], np.int64)[0]
    free(counts)

    def texts(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (batch.iloc[a:b] for batch in rows for a, b in slices([len(p or "") for p in batch["html"]])):
            pages_of = [measure(p or "") for p in batch["html"]]
            found = [list(counted(nodes)) for nodes in pages_of]
            keys = [_keys(h & 2**64 - 1, [k for k, _, _ in f], [d for _, d, _ in f]) if f else np.zeros(0, np.uint64) for h, f in zip(batch["host"], found, strict=True)]
            every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            is_template = np.zeros(len(every), bool)
            for part, at in cuts(part_of(every, parts), parts):
                if sizes[part]:
                    known = store.read(f"n0-{part}", int(sizes[part])).view(np.uint64)
                    is_template[at] = known[np.minimum(np.searchsorted(known, every[at]), len(known) - 1)] == every[at]
            out, first = [], 0
            for nodes, f in zip(pages_of, found, strict=True):
                gone = {id(n) for (_, _, n), t in zip(f, is_template[first : first + len(f)].tolist(), strict=True) if t}
                first += len(f)
                out.append(text_of(nodes[0], gone))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})

    return pages.mapInPandas(texts, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
