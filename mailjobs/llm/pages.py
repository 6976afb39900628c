"""Main text of web pages by removal of site templates.

Every element's subtree is hashed bottom up in two ways: with its words (tag, class and id, text, hashes
of its children) and by its shape (the same without words and inline elements, like siblings counted
once). Spark counts for each host on how many of its different pages a hash occurs; subtrees that recur
on many of them are templates and are deleted.

Words: whatever recurs, but not the page's frame, nor paragraphs, headings and the like inside an
article or main element. Shape: elements that divide a page (menus, headers, footers, boxes), whose words
may change from page to page. Outside an article or main element every such shape may be a template; on
a page that has neither, only one that holds at most ``max_share`` of its pages' text, so that the box
around the story stays.

Markup decides only what recurrence can't: what is no text at all (scripts, styles, controls), forms,
dialogs, reader comments and consent notices, which need not recur; menus, sidebars, footers and adverts
inside an article, where shapes don't tell them from its parts; and frames (by tag, class, id or role) on
pages whose host has fewer than ``min_pages`` different pages.

What is left is read block by block: character references decoded, white space in a block turned into
one blank, blocks joined by one blank in page order.

Defined results: a null or empty html gives an empty text and 0; a page without a host belongs to no
site, so nothing of it counts as a template; unclosed and stray tags are closed or ignored as browsers
mostly do; rows of a host with the same html count as one page, however many they are; other columns
take no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, short, url_host

# HTML element names by the part they play, and words of class, id and role attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe object svg canvas button select textarea".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title html head".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
INLINE = frozenset("b i em strong span a code br u s small sub sup mark font img wbr abbr cite time".split())
TEXT = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption".split())
CLOSES_P = BLOCK - frozenset("br body html title caption td th tr tbody thead tfoot".split())
PAGE = frozenset("html-root html body article main".split())
#: (tags, first words of classes and ids, roles) that go on any page; inside an article; and outside it where recurrence can't decide.
ANYWHERE = (frozenset("form dialog".split()), frozenset("comment comments disqus respond cookie cookies consent gdpr".split()), frozenset("search form dialog alertdialog".split()))
IN_ARTICLE = (frozenset("nav aside footer menu".split()), frozenset("ad ads advert advertisement advertising adsbygoogle sponsored sidebar newsletter".split()), frozenset("navigation complementary".split()))
FRAMES = (
    frozenset("nav header footer aside menu".split()),
    frozenset("ad ads advert advertisement advertising adsbygoogle banner breadcrumb breadcrumbs footer header masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promoted promotion related share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget".split()),
    frozenset("navigation banner contentinfo complementary alert menu menubar toolbar".split()),
)

#: Words of an element, without those of links, that make it prose.
PROSE = 8

_words = re.compile(r"[a-z0-9]+").findall


class Node:
    __slots__ = ("tag", "names", "first", "role", "hidden", "parts", "exact", "shape", "chars", "words", "prose")

    def __init__(self, tag: str, attrs: list[tuple[str, str | None]] = ()):
        known = dict(attrs)
        self.tag = tag
        tokens = [w for k in ("class", "id") for t in (known.get(k) or "").lower().split() if (w := _words(t))]
        self.names = " ".join(sorted({x for w in tokens for x in w}))
        self.first = {w[0] for w in tokens}
        self.role = (known.get("role") or "").lower()
        self.hidden = "hidden" in known
        self.parts: list[Node | str] = []
        self.exact = self.shape = self.chars = self.words = 0
        self.prose = False


class Tree(HTMLParser):
    """Builds the element tree of a page; open elements are closed where a browser would."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html-root")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        self._leave_head(tag)
        if tag in CLOSES_P:
            self._close("p", {"article", "section", "div", "td", "th", "li", "body", "blockquote", "main", "aside", "nav", "footer", "header"})
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close(tag, {"ul", "ol", "dl", "table", "select", "menu"})
        node = Node(tag, attrs)
        self.open[-1].parts.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self._leave_head(tag)
            self.open[-1].parts.append(Node(tag, attrs))
        else:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        self._close(tag, set())

    def handle_data(self, data):
        if data.strip():
            self._leave_head("")
        self.open[-1].parts.append(data)

    def _leave_head(self, tag: str) -> None:
        """Closes an open head at the body, and at what may not stand in a head (text is tag "")."""
        if tag == "body" or self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close("head", set())

    def _close(self, tag: str, until: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag in until:
                return


def parse(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def named(node: Node, words: tuple[frozenset[str], frozenset[str], frozenset[str]]) -> bool:
    """Whether its tag, role, class or id is among ``words``."""
    tags, names, roles = words
    return node.tag in tags or node.role in roles or not names.isdisjoint(node.first)


def announced(node: Node, inside: bool, decided: bool) -> bool:
    """Says by its tag, class, id or role that it isn't the article's text. ``decided``: recurrence has
    spoken on the frames of the page's host."""
    if node.tag in SILENT or node.hidden:
        return True
    if node.tag in PAGE:
        return False
    lists = (ANYWHERE, IN_ARTICLE) if inside else (ANYWHERE,) if decided else (ANYWHERE, FRAMES)
    for tags, names, roles in lists:
        if node.tag in tags or node.role in roles or not (inside and node.tag in TEXT) and not names.isdisjoint(node.first):
            return True
    return False


def walk(root: Node) -> Iterator[tuple[Node, bool]]:
    """Every element with whether it lies in an article or main element; parents first."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        yield node, inside
        inside = inside or node.tag in ("article", "main")
        stack += [(x, inside) for x in reversed(node.parts) if isinstance(x, Node)]


def digest(root: Node) -> list[tuple[Node, bool]]:
    """Fills the hashes of all subtrees, children before parents, and whether they hold prose: an element with
    ``PROSE`` words or more of its own, those of links left out."""
    from xxhash import xxh64_intdigest

    order = list(walk(root))
    for node, _ in reversed(order):
        exact, shape, own = [node.tag, node.names], set(), 0
        for x in node.parts:
            if isinstance(x, Node):
                if x.tag in SILENT:
                    continue
                exact.append(f"<{x.exact}>")
                if x.tag not in INLINE:
                    shape.add(x.shape)
                    node.prose |= x.prose
                elif x.tag != "a":
                    own += x.words
                node.chars += x.chars
            elif text := " ".join(x.split()):
                exact.append(text)
                node.chars += len(text)
                own += text.count(" ") + 1
        node.words = own
        node.prose |= own >= PROSE and node.tag not in INLINE
        node.exact = xxh64_intdigest("\n".join(exact).encode("utf-8", "replace"))
        node.shape = xxh64_intdigest("\n".join(["shape", node.tag, node.names, *map(str, sorted(shape))]).encode("utf-8", "replace"))
    return order


def keys(node: Node, inside: bool) -> list[int]:
    """The hashes by which a subtree may be a template: none for the page's frame and for text elements
    of an article; its words; its shape if it divides a page outside of articles and holds no prose, or says
    that it is a frame."""
    if node.tag in PAGE or node.tag in SILENT or not node.chars or inside and node.tag in TEXT:
        return []
    return [node.exact] if inside or node.tag in TEXT or node.prose and not named(node, FRAMES) else [node.exact, node.shape]


def page_hashes(html: str | None) -> dict[int, float]:
    """Each hash of a page with the share of the page's text that only a shape without a landmark to tell
    it from the story is held to; 0 for others."""
    order = digest(parse(html))
    landmark = any(n.tag in ("article", "main") and n.chars for n, _ in order)
    out: dict[int, float] = {}
    for node, inside in order:
        for k in keys(node, inside):
            share = 0.0 if landmark or k == node.exact else node.chars / order[0][0].chars
            out[k] = out.get(k, 0.0) + share
    return out


def doubtful(root: Node, weak: frozenset[int], gone: frozenset[int], decided: bool) -> set[int]:
    """Elements (by identity) that match a template of few pages, yet may be the story that copies of a page
    share: where such elements hold half or more of what is left of an article, or of the page outside of
    articles, none of them is taken for a template."""
    totals: dict[int, list[int]] = {}
    found: list[tuple[int, int]] = []
    stack = [(root, False, id(root), False)]
    while stack:
        node, inside, scope, within = stack.pop()
        if announced(node, inside, decided) or not gone.isdisjoint(own := keys(node, inside)):
            continue
        if not inside and node.tag in ("article", "main"):
            scope = id(node)
        total = totals.setdefault(scope, [0, 0])
        if not within and not weak.isdisjoint(own):
            within = True
        if not weak.isdisjoint(own):
            found.append((id(node), scope))
        n = sum(len(" ".join(x.split())) for x in node.parts if isinstance(x, str))
        total[0] += n
        total[1] += n * within
        inside = inside or node.tag in ("article", "main")
        stack += [(x, inside, scope, within) for x in node.parts if isinstance(x, Node)]
    return {node for node, scope in found if 2 * totals[scope][1] >= totals[scope][0]}


def extract(html: str | None, templates: frozenset[int] = frozenset(), decided: bool = False, weak: frozenset[int] = frozenset()) -> str:
    """The page's text without templates and announced frames. ``weak``: those of the templates that few
    pages have."""
    root = parse(html)
    if templates:
        digest(root)
    kept = doubtful(root, weak, templates - weak, decided) if weak else ()
    out: list[str] = []
    stack: list[tuple[Node | str, bool]] = [(root, False)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        matched = templates and keys(x, inside)
        if announced(x, inside, decided) or matched and not templates.isdisjoint(matched) and not (id(x) in kept and (templates - weak).isdisjoint(matched)):
            if x.tag in BLOCK:
                out.append(" ")
            continue
        edge = [(" ", inside)] if x.tag in BLOCK else []
        within = inside or x.tag in ("article", "main")
        stack += [*edge, *((p, within) for p in reversed(x.parts)), *edge]
    return " ".join("".join(out).split())


def templates(pages: DataFrame, min_share: float = 0.2, max_share: float = 0.3, sure_share: float = 0.5) -> DataFrame:
    """host, n_pages, hashes, weak: for hosts of several different pages, the subtrees found on at least
    ``min_share`` of these and on two. They are at most 1 / min_share times as many as a page has. ``weak``:
    those on fewer than three or than ``sure_share``."""
    rows = pages.select(url_host(F.col("url")).alias("host"), "html", F.xxhash64("html").alias("page")).where("host <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            found = [{0: 0.0, **page_hashes(h.as_py())} for h in batch.column(1)]  # 0 counts the page itself
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = np.array([k for x in found for k in x], dtype=np.uint64).view(np.int64)
            share = pa.array([v for x in found for v in x.values()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(flat), batch.column(2).take(row), share], names=["host", "hash", "page", "share"])

    once = rows.mapInArrow(run, "host string, hash long, page long, share double").groupBy("host", "hash", "page").agg(F.max("share").alias("share"))
    counted = checkpointed(once.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"), F.avg("share").alias("share")).where("n > 1"))
    of_host = counted.where("hash = 0").select("host", F.col("n").alias("n_pages"))
    is_template = (F.col("hash") != 0) & (F.col("n") >= min_share * F.col("n_pages")) & (F.col("share") <= max_share)
    weak = (F.col("hash") != 0) & ((F.col("n") < 3) | (F.col("n") < sure_share * F.col("n_pages")))
    return counted.join(of_host, "host").where(is_template | (F.col("hash") == 0)).groupBy("host", "n_pages").agg(F.collect_set(F.when(F.col("hash") != 0, F.col("hash"))).alias("hashes"), F.collect_set(F.when(weak, F.col("hash"))).alias("weak"))


def main_text(pages: DataFrame, min_share: float = 0.2, max_share: float = 0.3, min_pages: int = 3, broadcast_rows: int = 100_000) -> DataFrame:
    """page_id, url, text and n_chars for every row of ``pages``."""
    known = checkpointed(templates(pages, min_share, max_share))
    side = known.select(F.col("host").alias("of_host"), "hashes", "weak", (F.col("n_pages") >= min_pages).alias("decided"))
    if known.count() <= broadcast_rows:  # else Spark joins by host and deals skewed hosts out
        side = F.broadcast(side)
    rows = pages.select("page_id", "url", "html", url_host(F.col("url")).alias("host"))
    rows = rows.join(side, F.col("host") == F.col("of_host"), "left").select("page_id", "url", "html", "host", "hashes", F.coalesce("decided", F.lit(False)).alias("decided"), "weak")
    schema = T.StructType([*(T.StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: dict[str, tuple[frozenset[int], frozenset[int]]] = {}
        for batch in short(batches):
            texts = []
            for k, (html, host, decided) in enumerate(zip(batch.column(2), batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                if host not in of:
                    if len(of) >= 1000:
                        of.clear()
                    of[host] = tuple(frozenset(h & 0xFFFFFFFFFFFFFFFF for h in batch.column(c)[k].as_py() or ()) for c in (4, 6))
                texts.append(extract(html.as_py(), of[host][0], decided, of[host][1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)
