"""Main text of web pages by wrapper induction.

One page of each host, that with the smallest hash, is the host's reference; only its tag
tree is kept. Every page's DOM tree is aligned with it by simple tree matching (the
largest order-preserving match of nodes with equal tags). For each slot (a place for text
in a node of the reference) Spark counts over the pages of the host how many different
pages have it and whether their texts there are all the same: constant slots are
template, varying slots are content.

Each block of text is decided by the first rule that applies:

1. ``template``: its slot is constant on enough different pages of the host: it goes,
   inside an article as well as outside.
2. ``element``: it lies in an element that is never main text (nav, footer, form, ...): it goes.
3. ``name``: a class, id or role names it as something else (advert, comments, ...): it goes.
4. ``outside``: the page marks its article (article, main, articleBody) and the block is not in it: it goes.
5. ``content``: everything else stays.

Pages that are copies of each other are not different: pages count by their longest block
that rules 2 and 3 leave.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import hot_join, materialise, ship

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
#: Elements that are never main text.
DROPPED = frozenset("head script style noscript template nav footer aside form button select textarea iframe object svg canvas menu dialog audio video".split())
#: Words in a class, id or role that name something other than main text.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr footer"
    " masthead menu menubar nav navbar navigation newsletter notice notification alert paywall popup modal overlay promo promoted promotion related"
    " recommended recommendations respond reply replies search share sharing sharebar sidebar social sponsor sponsored subscribe subscription toolbar widget"
    " complementary contentinfo discussion feedback login signup pager pagination skip".split()
)
MAIN = frozenset({"main", "articlebody"})

ship(__name__)


class Node:
    __slots__ = ("tag", "kids", "blocks", "element", "named", "main", "head", "size", "shape")

    def __init__(self, tag: str, element: bool = False, named: bool = False, main: bool = False, head: bool = False):
        self.tag, self.element, self.named, self.main, self.head = tag, element, named, main, head
        self.kids: list[Node] = []
        self.blocks: list[tuple[int, str]] = []  # (number of kids before it, text) of own text
        self.size, self.shape = 1, 0


class Tree(HTMLParser):
    """A forgiving DOM: unclosed paragraphs, list items and cells are closed, stray ends ignored.

    Inline elements don't make nodes; their text belongs to the block around them.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open, self.text, self.inline = [self.root], [], []
        self.skipped = 0
        self.feed(html)
        self.close()
        self.flush()

    def flush(self) -> None:
        said = " ".join("".join(self.text).split())
        self.text.clear()
        if said:
            top = self.open[-1]
            top.blocks.append((len(top.kids), said))

    def end_to(self, n: int) -> None:
        self.flush()
        del self.open[n:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.text.append(" ")
            return
        names = {w for k, v in attrs if v and k in ("class", "id", "role", "itemprop") for w in re.split(r"[^a-z0-9]+", v.lower())}
        # The whole page may be of class "with-sidebar"; an article that is a comment is none.
        plain = tag in ("html", "body", "main") or names & {"has", "with", "no", "without"}
        bad, main = tag in DROPPED or bool(names & NAMED and not plain), tag in ("article", "main") or bool(names & MAIN)
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs)
        if tag not in BLOCK and tag not in DROPPED and not hidden and not (bad and tag != "a"):
            return  # inline
        if tag == "hr":
            self.flush()
        if tag in VOID:
            return
        if tag in BLOCK:
            for n in range(len(self.open) - 1, 0, -1):
                if self.open[n].tag == "p":
                    self.end_to(n)
                    break
                if self.open[n].tag in ("td", "th", "li", "div", "article", "section", "button", "object"):
                    break
        if tag in CLOSES:
            for n in range(len(self.open) - 1, 0, -1):
                if self.open[n].tag in SCOPE[tag]:
                    break
                if self.open[n].tag in CLOSES[tag]:
                    self.end_to(n)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        self.flush()
        node = Node(tag, tag in DROPPED or hidden, bad, main, tag == "header" or "header" in names)
        self.open[-1].kids.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for n in range(len(self.open) - 1, 0, -1):
            if self.open[n].tag == tag:
                self.end_to(n)
                return
        if tag in BLOCK:
            self.flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)


def parse(html: str) -> Node:
    """The tree, each node with its size and a number for its shape (equal shapes, equal tags all through)."""
    root = Tree(html).root
    shapes: dict[tuple, int] = {}
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.kids
    for node in reversed(order):
        node.size = 1 + sum(k.size for k in node.kids)
        key = (node.tag, *[k.shape for k in node.kids])
        node.shape = shapes.setdefault(key, len(shapes) + 1)
    return root


def reshape(root: Node, shapes: dict[tuple, int]) -> None:
    """Number shapes by a shared table, so that those of two trees compare."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += node.kids
    for node in reversed(order):
        node.shape = shapes.setdefault((node.tag, *[k.shape for k in node.kids]), len(shapes) + 1)


class Matcher:
    """Simple tree matching; equal subtrees and equal ends of child lists are matched outright.

    Pairs of shapes are worked off from an explicit stack, so trees may be of any depth.
    """

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def pairs(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        """The size of the largest match of two trees with equal root tags, and its pairs of kids."""
        stack = [(a, b, False)]
        while stack:
            x, y, ready = stack.pop()
            if self._outright(x, y) or (x.shape, y.shape) in self.known:
                continue
            if ready:
                self.known[x.shape, y.shape] = self._children(x.kids, y.kids)
                continue
            stack.append((x, y, True))
            p, q = self._middle(x.kids, y.kids)[2:]
            stack += [(m, n, False) for m in {m.shape: m for m in p}.values() for n in {n.shape: n for n in q}.values() if m.tag == n.tag]
        return self._found(a, b)

    @staticmethod
    def _outright(a: Node, b: Node) -> bool:
        return a.tag != b.tag or a.shape == b.shape

    def _found(self, a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
        if a.tag != b.tag:
            return 0, []
        if a.shape == b.shape:
            return a.size, [(i, i) for i in range(len(a.kids))]
        return self.known[a.shape, b.shape]

    def _weight(self, a: Node, b: Node) -> int:
        return 0 if a.tag != b.tag else a.size if a.shape == b.shape else self.known[a.shape, b.shape][0]

    @staticmethod
    def _middle(x: list[Node], y: list[Node]) -> tuple[int, int, list[Node], list[Node]]:
        """How many kids agree at the start and at the end, and those between."""
        head = 0
        while head < min(len(x), len(y)) and x[head].shape == y[head].shape:
            head += 1
        tail = 0
        while tail < min(len(x), len(y)) - head and x[-1 - tail].shape == y[-1 - tail].shape:
            tail += 1
        return head, tail, x[head : len(x) - tail], y[head : len(y) - tail]

    def _children(self, x: list[Node], y: list[Node]) -> tuple[int, list[tuple[int, int]]]:
        head, tail, p, q = self._middle(x, y)
        out = [(i, i) for i in range(head)]
        total = 1 + sum(n.size for n in x[:head]) + sum(n.size for n in x[len(x) - tail :])
        if p and q:
            # A row of weights for each shape of p; a step of the table is three array operations.
            weights: dict[int, np.ndarray] = {}
            best = np.zeros((len(p) + 1, len(q) + 1), np.int32)
            for i, m in enumerate(p):
                if m.shape not in weights:
                    of = {n.shape: self._weight(m, n) for n in q}
                    weights[m.shape] = np.array([of[n.shape] for n in q], np.int32)
                np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + weights[m.shape]), out=best[i + 1, 1:])
            i, j, middle = len(p), len(q), []
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    middle.append((head + i, head + j))
            out += reversed(middle)
            total += int(best[-1, -1])
        return total, out + [(len(x) - k, len(y) - k) for k in range(tail, 0, -1)]


def tree_text(root: Node) -> str:
    """A tree's tags in page order, ")" behind the kids of each."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
            continue
        out.append(node.tag)
        stack.append(")")
        stack += reversed(node.kids)
    return " ".join(out)


def tree_of(text: str) -> Node:
    """The tree that ``tree_text`` wrote; an empty text is a page without nodes."""
    top = Node("")
    path = [top]
    for word in text.split():
        if word == ")":
            path.pop()
        else:
            node = Node(word)
            path[-1].kids.append(node)
            path.append(node)
    return top.kids[0] if top.kids else Node("#root")


def aligned(page: Node, reference: Node) -> dict[int, int]:
    """For the nodes of ``page`` by id(): the number of the matching node of ``reference``."""
    shapes: dict[tuple, int] = {}
    reshape(page, shapes)
    reshape(reference, shapes)
    number, stack, n = {}, [reference], 0
    while stack:
        node = stack.pop()
        number[id(node)] = n
        n += 1
        stack += reversed(node.kids)
    matcher, out, stack = Matcher(), {}, [(page, reference)]
    while stack:
        a, b = stack.pop()
        out[id(a)] = number[id(b)]
        stack += [(a.kids[i], b.kids[j]) for i, j in matcher.pairs(a, b)[1]]
    return out


def blocks(page: Node, slots: dict[int, int]) -> list[tuple[int, bool, bool, bool, str]]:
    """In page order, (slot or -1, in a marked article, in a dropped element, named as something else, text).

    A slot is a node of the reference and the number of the text within it.
    """
    out: list[tuple[int, bool, bool, bool, str]] = []
    stack: list = [(page, False, False, False)]
    while stack:
        item = stack.pop()
        if len(item) == 5:
            out.append(item)
            continue
        node, main, element, named = item
        main = main or node.main
        element, named = element or node.element or (node.head and not main), named or node.named
        slot, own = slots.get(id(node), -1), []
        at = 0
        for n, kid in enumerate([*node.kids, None]):
            while at < len(node.blocks) and node.blocks[at][0] <= n:
                own.append(((slot << 32) + at if slot >= 0 else -1, main, element, named, node.blocks[at][1]))
                at += 1
            if kid is not None:
                own.append((kid, main, element, named))
        stack += reversed(own)
    return out


_BLOCKS = "array<struct<slot: bigint, main: boolean, element: boolean, named: boolean, text: string>>"
_KIND = pa.list_(pa.struct([("slot", pa.int64()), ("main", pa.bool_()), ("element", pa.bool_()), ("named", pa.bool_()), ("text", pa.string())]))
#: Tag trees, or constant slots, up to so many bytes or rows in all are broadcast; more are joined.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 1 << 20
#: A longer page becomes a host's reference only if all its pages are.
LONG_PAGE = 1 << 20


def references(rows: DataFrame) -> DataFrame:
    """(_host, _tree): the tag tree of the page with the smallest hash of each host, long pages last."""
    filled = rows.filter(F.length("html") > 0)
    order = F.struct(F.length("html") > LONG_PAGE, "_order")
    chosen = materialise(filled.groupBy("_host").agg(F.min(order).alias("_first")), "first-pages")
    if chosen.count() <= BROADCAST_ROWS:
        found = filled.join(F.broadcast(chosen), (filled["_host"] == chosen["_host"]) & (order == chosen["_first"])).select(filled["_host"], "html")
        found = found.groupBy("_host").agg(F.min("html").alias("html"))
    else:
        found = filled.groupBy("_host").agg(F.min_by("html", order).alias("html"))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tree_text(parse(h.as_py())) for h in batch.column(1)], pa.string())], ["_host", "_tree"])

    return materialise(found.mapInArrow(trees, "_host string, _tree string"), "trees")


def aligned_blocks(pages: DataFrame) -> DataFrame:
    """page_id, url, _host, ``blocks`` of every page, aligned with its host's reference, and
    whether the page marks an article. (A column of its own: worked out within the rule of
    each block it would make long pages quadratic.)"""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("_host"))
    rows = rows.withColumn("_order", F.xxhash64("page_id", "html"))
    trees = references(rows)
    small = (trees.agg(F.sum(F.octet_length("_host") + F.octet_length("_tree"))).first()[0] or 0) <= BROADCAST_BYTES
    if small:
        shared = pages.sparkSession.sparkContext.broadcast({r["_host"]: r["_tree"] for r in trees.collect()})
        both = rows.select("page_id", "url", "_host", "html", F.lit(None).cast("string").alias("_tree"))
    else:
        shared = None
        both = hot_join(rows, trees, "_host").select("page_id", "url", "_host", "html", "_tree")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        given = shared.value if shared else {}
        for batch in batches:
            out, marked = [], []
            for own, html, tree in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                if own not in known:
                    if len(known) > 64:
                        known.clear()
                    known[own] = tree_of((given.get(own) if shared else tree) or "")
                page = parse(html)
                found = blocks(page, aligned(page, known[own]))
                out.append([dict(zip(("slot", "main", "element", "named", "text"), b)) for b in found])
                marked.append(any(main and not element and not named for _, main, element, named, _ in found))
            arrays = [*[batch.column(i) for i in range(3)], pa.array(out, _KIND), pa.array(marked, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "_host", "blocks", "marked"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(each, f"page_id {kind}, url string, _host string, blocks {_BLOCKS}, marked boolean")


def templates(found: DataFrame, support: int = 3, share: float = 0.5) -> DataFrame:
    """(_host, _constant): the slots whose text is the same on all pages that have them.

    A slot needs ``support`` different pages, and ``share`` of the host's different pages.
    Pages count by their longest block outside dropped and named parts, so that copies, and
    copies with changes elsewhere, count once. Only hashes are shuffled.
    """
    own = F.filter("blocks", lambda b: ~b["element"] & ~b["named"])
    longest = F.array_max(F.transform(own, lambda b: F.struct(F.length(b["text"]), F.xxhash64(b["text"]))))
    slots = F.transform(F.filter("blocks", lambda b: b["slot"] >= 0), lambda b: F.struct(b["slot"].alias("slot"), F.xxhash64(b["text"]).alias("h")))
    # The page's own hash is taken below the explode: above it, every slot would take it again.
    hashed = found.select("_host", F.xxhash64(longest).alias("_page"), slots.alias("_slots"))
    one = hashed.select("_host", "_page", F.explode("_slots").alias("b")).select("_host", "_page", "b.slot", "b.h")
    # First the pages of one content, then the slots: a hot host is dealt by page and by slot.
    distinct = one.groupBy("_host", "slot", "_page").agg(F.min("h").alias("_lo"), F.max("h").alias("_hi"))
    of = hashed.select("_host", "_page").distinct().groupBy("_host").agg(F.count("*").alias("_of"))
    constant = distinct.groupBy("_host", "slot").agg(F.count("*").alias("_n"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    constant = constant.filter((F.col("_lo") == F.col("_hi")) & (F.col("_n") >= support)).join(of, "_host").filter(F.col("_n") >= F.col("_of") * share)
    # At most as many slots a host as its one reference page has.
    return constant.groupBy("_host").agg(F.collect_set("slot").alias("_constant"))


def judged_blocks(pages: DataFrame, support: int = 3, share: float = 0.5) -> DataFrame:
    """page_id, url and ``blocks`` with the ``rule`` that decided each; see the module's text."""
    found = materialise(aligned_blocks(pages), "blocks", compression="zstd")
    constant = materialise(templates(found, support, share), "templates")
    small = (constant.agg(F.sum(F.size("_constant"))).first()[0] or 0) <= BROADCAST_ROWS
    found = found.join(F.broadcast(constant), "_host", "left") if small else hot_join(found, constant, "_host")
    rule = lambda b: (
        F.when(F.coalesce(F.array_contains("_constant", b["slot"]), F.lit(False)), "template")
        .when(b["element"], "element").when(b["named"], "name").when(F.col("marked") & ~b["main"], "outside").otherwise("content")
    )
    return found.select("page_id", "url", F.transform("blocks", lambda b: F.struct(rule(b).alias("rule"), b["text"].alias("text"))).alias("blocks"))


def main_texts(pages: DataFrame, support: int = 3, share: float = 0.5) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars, n_template.

    White space inside a block is one space; blocks are joined by an empty line;
    ``n_template`` counts the blocks that alignment took out. A null or empty page has an
    empty text. A null url, or one without a host, belongs to the host "". Pages may be of
    any length and depth. Rows that repeat are rows of their own; an empty table gives no
    rows; other columns are not read.
    """
    found = judged_blocks(pages, support, share)
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["rule"] == "content"), lambda b: b["text"]), "\n\n")
    n = F.size(F.filter("blocks", lambda b: b["rule"] == "template")).cast("bigint")
    return found.select("page_id", "url", text.alias("text"), n.alias("n_template")).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_template")
