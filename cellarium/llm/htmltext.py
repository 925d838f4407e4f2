"""Main text of web pages with a site style tree.

The DOMs of a host's pages are merged: elements of the same tag and classes at the same place below the same element, in
the same order of siblings, are one node of the tree. A node whose content recurs from page to page and whose presentation
hardly varies has little importance, and its branch is cut from every page. The pages of all hosts are merged into one
more tree in the same way, which tells what recurs from host to host, and judges hosts of few pages.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.llm.common import and_columns, cut, drop, fresh_name, small_batches, spread_join
from cellarium.llm.urls import url_host

#: Damping of a node's own presentation against its content.
GAMMA = 0.9
#: Nodes below this importance and this content are cut; see unimportant() for nodes of few pages.
LEAST_IMPORTANCE = 0.7
#: Nodes that may be broadcast; beyond it each page is joined with its own.
BROADCAST_NODES = 500_000
#: Text counts for its own element at any depth, and for those around it down to this level, below which browsers do not nest
#: elements either, so that work is linear in a page.
BRANCH_LEVELS = 512

# Element kinds of HTML.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
_DROPPED = frozenset("head nav footer aside form script style textarea title noscript template iframe xmp button select dialog menu svg canvas object audio video map math datalist search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
_CLASSES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar comment comments disqus respond replies reply share sharing social breadcrumb breadcrumbs menu nav navbar navigation footer related widget pagination pager toolbar".split()
)
_COMMENTS = frozenset("comment comments disqus".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_HOLDS = frozenset("ul ol dl table td th div article section main body".split())

# The tokenizer states of HTML: a name ends at white space, a slash, = or >, a value at its quote or else at white space or >. A quote
# that is never closed is part of a name, so that its tag ends at the next >.
_ATTRIBUTE = r"""[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*|(?=>)))?+"""
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>" + "|".join(_RAW) + r")(?=[\s/>])(?:[\s/]+|" + _ATTRIBUTE + r")*+(?:>.*?(?:</(?P=raw)(?=[\s/>])[^>]*(?:>|\Z)|\Z)|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[\s/]+|" + _ATTRIBUTE + r")*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)|(?=>|$)))?+""")
_OF_USE = frozenset(("class", "id", "role", "hidden", "aria-hidden"))


def host_key(host: str) -> int:
    return xxhash.xxh3_64_intdigest(host) >> 1


class Element:
    """An open or closed element: its kinds, its block children's labels in order, and the blocks of text right in it."""

    __slots__ = ("tag", "label", "up", "place", "labels", "depth", "dropped", "main", "judged", "nodes", "cut", "block")

    def __init__(self, tag: str, label: str, up: Element | None, dropped: bool, main: bool, suspect: bool = False):
        self.tag, self.label, self.up, self.dropped, self.main = tag, label, up, dropped, main
        self.judged = tag not in ("html", "body") and (not main or suspect)  # whether a tree may cut it
        self.labels: list[str] = []
        self.nodes: tuple[int, int] | None = None
        self.cut: bool | None = None
        self.block = up is None or tag in _BLOCK
        self.depth = 0 if up is None else up.depth + 1
        self.place = 0


class Page:
    """One pass over a page: its blocks of text with their elements, from which the nodes of the style trees follow.

    by_kind says whether elements are also dropped by tag, role and class.
    """

    def __init__(self, host: str, cut: frozenset[int] | set[int] = frozenset(), by_kind: bool = True):
        self.host, self.cut, self.by_kind = host, cut, by_kind
        root = Element("", "", None, False, False)
        root.nodes, root.cut = (host_key(host), 0), False
        self.stack, self.open = [root], Counter()
        self.blocks: list[tuple[str, Element]] = []
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts.clear()
            if text:
                self.blocks.append((text, self.stack[-1]))

    def push(self, tag: str, attrs: str) -> None:
        up = self.stack[-1]
        classes = role = ""
        hidden = False
        for name, a, b, c in _ATTR.findall(attrs) if attrs else ():
            name = name.lower()
            if name not in _OF_USE:
                continue
            if name in ("class", "id"):
                classes += f" {a or b or c}"
            elif name == "role":
                role = (a or b or c).lower()
            else:
                hidden |= name == "hidden" and not (a or b or c) or name == "aria-hidden" and (a or b or c).lower() == "true"
        label = f"{tag}.{re.sub('[0-9]+', '0', '.'.join(sorted(classes.lower().split())))}" if classes else tag
        words = set(re.split(r"[\s_-]+", classes.lower())) if classes else set()
        hit = not words.isdisjoint(_CLASSES)
        # In an article a class says so by itself only as a whole or if it is of comments, which never recur; else the tree has to agree.
        sure = hit and not (up.main and words.isdisjoint(_COMMENTS) and _CLASSES.isdisjoint(classes.lower().split()))
        unwanted = tag in _DROPPED or role in _ROLES or hidden or sure
        if not up.main and (tag == "header" or "header" in words):
            unwanted = unwanted or tag != "article"
        main = up.main or self.by_kind and (tag in ("article", "main") or role == "main")
        dropped = up.dropped or self.by_kind and unwanted and tag not in ("html", "body")
        element = Element(tag, label, up, dropped, main, self.by_kind and hit and not sure)
        if element.block:
            home = self.home(up)
            element.place = len(home.labels)
            home.labels.append(label)
        self.stack.append(element)
        self.open[tag] += 1

    def pop(self) -> None:
        self.open[self.stack.pop().tag] -= 1

    @staticmethod
    def home(element: Element) -> Element:
        """The block element that an element is in, or is."""
        while not element.block:
            element = element.up
        return element

    def nodes(self, element: Element) -> tuple[int, int]:
        """The nodes of a block element in its host's tree and in that of all hosts."""
        chain = []
        while element.nodes is None:
            chain.append(element)
            element = self.home(element.up)
        for e in reversed(chain):
            seeds = element.nodes
            key = f"{e.place}|{e.label}|{self.order(element)}"
            e.nodes = (xxhash.xxh3_64_intdigest(key, seed=seeds[0]) >> 1, xxhash.xxh3_64_intdigest(key, seed=seeds[1]) >> 1)
            element = e
        return element.nodes

    @staticmethod
    def order(element: Element) -> int:
        """A hash of the order of an element's block children, which is how it is presented."""
        if isinstance(element.labels, list):
            element.labels = xxhash.xxh3_64_intdigest("/".join(element.labels)) >> 1
        return element.labels

    def is_cut(self, element: Element) -> bool:
        """Whether a tree cuts an element or one around it. Of an article, only what has a suspicious class is ever cut."""
        chain = []
        while element.cut is None:
            chain.append(element)
            element = element.up
        for e in reversed(chain):
            around = element.cut and (element.main or not e.main)  # an article in a branch that is cut stays
            e.cut = around or e.judged and e.block and not self.cut.isdisjoint(self.nodes(e))
            element = e
        return element.cut

    def shares(self) -> set[tuple[int, int, int, int]]:
        """host's node, node over all hosts, kind (0 block of text, 1 order of children) and value: what the page adds to the trees.

        The host's own name in a text is left out, since templates put it in.
        """
        out = set()
        for text, element in self.blocks:
            own = e = self.home(element)
            value = xxhash.xxh3_64_intdigest(text.replace(self.host, "")) >> 1
            while e.depth > BRANCH_LEVELS and e.up is not None:
                e = e.up
            e = self.home(e)
            for branch in [own] if own is not e else []:
                out.add((*self.nodes(branch), 0, value))
                out.add((*self.nodes(branch), 1, self.order(branch)))
            while e.up is not None:
                if e.judged:
                    out.add((*self.nodes(e), 0, value))
                    out.add((*self.nodes(e), 1, self.order(e)))
                e = self.home(e.up)
        return out

    def close(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        """Close the innermost element of these tags, unless one of stop stands before it."""
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                while len(self.stack) > i:
                    self.pop()
                return
            if self.stack[i].tag in stop:
                return

    def read(self, source: str) -> Page:
        at = 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self.parts.append(html.unescape(source[at : m.start()]))
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue  # comments, declarations, scripts and other raw elements
            tag = tag.lower()
            if m["end"]:
                if self.open[tag]:
                    if tag in _BLOCK:
                        self.flush()
                    self.close({tag}, frozenset())
                continue
            if tag == "br":
                self.parts.append(" ")
                continue
            if tag in _BLOCK:
                self.flush()
                if self.open["p"]:
                    self.close({"p"}, _HOLDS - {"p"})
                if tag in _CLOSES and any(self.open[x] for x in _CLOSES[tag]):
                    self.close(_CLOSES[tag], _HOLDS - _CLOSES[tag])
            if tag not in _VOID:  # a slash at the end closes no other element
                self.push(tag, m["attrs"])
        if at < len(source):
            self.parts.append(html.unescape(source[at:]))
        self.flush()
        return self

    def text(self) -> str:
        """The blocks that kinds and trees leave, inside articles and outside them; if the trees leave none, all that kinds leave."""
        left = [(t, e) for t, e in self.blocks if not e.dropped]
        return "\n\n".join([t for t, e in left if not self.is_cut(e)] or [t for t, _ in left])


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged style trees of pages (url, html), one for each host and one of all: node, pages, presentation, content, importance.

    A node is a hash of the host and the place below it. A page's share in it is its order of child elements (presentation)
    and its blocks of text (content), each counted once per page. With m pages, presentation is the entropy of the orders to
    the base m, content is one less the mean entropy of the blocks, where a block on n pages has log n / log m. A node
    on one page has both one.
    """
    small_batches(pages.sparkSession)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[int, int, int, int]] = []
            for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                rows += Page(host).read(source or "").shares()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["own", "common", "kind", "value"])

    rows = pages.select(url_host(F.col("url")).alias("host"), "html").mapInArrow(shares, "own long, common long, kind int, value long")
    counted = rows.groupBy("own", "common", "kind", "value").agg(F.count("*").alias("n"))
    both = counted.select(F.explode(F.array("own", "common")).alias("node"), "kind", "value", "n")
    return weigh(both.groupBy("node", "kind", "value").agg(F.sum("n").alias("n")))


def weigh(counted: DataFrame) -> DataFrame:
    """The measures of style_tree() from node, kind (0 block, 1 order of children), value and n, the pages that have it."""
    blocks, styles = F.col("kind") == 0, F.col("kind") == 1
    sums = counted.groupBy("node").agg(
        F.sum(F.when(styles, F.col("n"))).alias("pages"), F.count(F.when(styles, 1)).alias("orders"), F.sum(F.when(styles, F.col("n") * F.ln("n"))).alias("nlogn"), F.sum(F.when(blocks, F.ln("n"))).alias("logs"), F.count(F.when(blocks, 1)).alias("blocks")
    )
    log_m = F.ln("pages")
    several = F.col("pages") > 1
    tree = sums.withColumn("presentation", F.when(several, 1 - F.col("nlogn") / F.col("pages") / log_m).otherwise(1.0)).withColumn("content", F.when(several, 1 - F.col("logs") / F.col("blocks") / log_m).otherwise(1.0))
    damp = F.pow(F.lit(GAMMA), F.col("orders"))
    return tree.select("node", "pages", "presentation", "content", ((1 - damp) * F.col("presentation") + damp * F.col("content")).alias("importance"))


def unimportant(tree: DataFrame) -> DataFrame:
    """node of what is cut. Presentation shrinks with the logarithm of pages, content that does not recur stays near one; so
    low importance is not enough, content must be low too. m pages count by 1 - 1 / m, so that little evidence needs
    a clearer case: with 3 pages less than 0.55 is cut, with 2 less than 0.4."""
    return tree.filter(1 - (1 - F.greatest("importance", "content")) * (1 - 1 / F.col("pages")) < LEAST_IMPORTANCE).select("node")


def extract(pages: DataFrame, by_kind: bool = True) -> DataFrame:
    """Add text to pages (url, html): the main text without menus, headers, footers, sidebars, notices, adverts, forms,
    scripts, styles, markup and comments of readers.

    The branches go that the style tree of the page's host or that of all hosts finds unimportant, and, with by_kind,
    elements that are no main text by tag, role or class. An article element and what is in it is left to the kinds, but for
    elements with a word of such a class, as in related-work, which go if the tree agrees; and a page that the trees would empty keeps its text. Character references are decoded, white space inside a block becomes
    one space, blocks are joined by an empty line. A null or empty html gives an empty text; a null url counts as a host of
    its own; equal rows each get the same text; an empty table gives an empty table. Whole pages count, however long or
    deep. A column text is replaced; every other column and every row is kept, whatever the names.
    """
    small_batches(pages.sparkSession)
    low = cut(unimportant(style_tree(pages)))
    host = fresh_name([*pages.columns, "text"], "_host")
    nodes = fresh_name([*pages.columns, "text"], "_cut")
    hosted = pages.withColumn(host, url_host(F.col("url")))
    found = low.limit(BROADCAST_NODES + 1).toPandas()["node"].tolist()
    if len(found) <= BROADCAST_NODES:
        shared = pages.sparkSession.sparkContext.broadcast(frozenset(found))
        drop(low)
    else:  # too many to send everywhere: each page gets those of its own
        shared = None
        page = [F.xxhash64("url").alias("url_hash"), F.xxhash64("html").alias("html_hash")]

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(u, h, x) for u, h, name, source in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True) for x in {n for share in Page(name).read(source or "").shares() for n in share[:2]}]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 3)], names=["url_hash", "html_hash", "node"])

        has = cut(pages.select(*page, url_host(F.col("url")), "html").distinct().mapInArrow(own, "url_hash long, html_hash long, node long"))
        lists = spread_join(has, low, ["node"]).groupBy("url_hash", "html_hash").agg(F.collect_list("node").alias(nodes))  # at most a page's elements
        marked = hosted.join(lists, (F.xxhash64(hosted["url"]) == lists["url_hash"]) & (F.xxhash64(hosted["html"]) == lists["html_hash"]), "left")
        hosted = marked.select(*[hosted[c] for c in hosted.columns], nodes)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if c not in ("text", host, nodes)]
            cuts = [shared.value] * batch.num_rows if shared else [frozenset(x or ()) for x in batch.column(nodes).to_pylist()]
            sources = zip(batch.column(host).to_pylist(), batch.column("html").to_pylist(), cuts, strict=True)
            texts = [Page(name, gone, by_kind).read(source).text() if source else "" for name, source, gone in sources]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return hosted.mapInArrow(read, and_columns(pages, "text string"))
