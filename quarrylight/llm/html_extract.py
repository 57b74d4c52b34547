"""Main text of web pages by wrapper induction.

For every host the page with the smallest id is its reference.  Each page's
DOM skeleton is aligned with the reference's by simple tree matching, and over
all different pages of the host it is counted how often an aligned slot has the
reference's text: that text of slots that are nearly constant belongs to the
template, others vary and hold content, inside an article element as outside of
it.  Copies of a page count once, and a heading in an article stays with the text it heads.  An
article with most of a page's text is a hint that decides only on hosts with
too few pages to tell; menus, headers, footers and the like are template
whatever they say.

Slots are nodes: every text of a page is one leaf of its skeleton, in page order,
and carries what the alignment says of this leaf.  Elements deeper than DEPTH
become children of the one at that depth, as browsers do.  Trees of any size are
matched in the same way; subtrees that look the same to an alignment are compared once.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import drop, text_of, written

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style noscript template iframe svg canvas object button select textarea option".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside menu dialog".split())
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words that mark an element as no content if a class, id or role says nothing else than one of them and PLACES.
MARKS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice pagination popup promo related search share sidebar social sponsor sponsored subscribe toolbar widget".split())
PLACES = frozenset("a area b bar block bottom box col column container content first global id inner item items js last left links list main menu middle mobile nav outer page panel right row section site slot top unit web widget wrap wrapper www".split())
#: Words that say what a mark belongs to; a header of one of these is content.
OWNERS = frozenset("article body entry form post reader readers story text thread user".split())
#: Elements nest so deep.
DEPTH = 256
#: A slot with the reference's text on this share of at least so many pages is template.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.8, 3
LINK_SHARE = 0.6
#: References of more bytes than this in all are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Ids of so many first pages are broadcast.
BROADCAST_ROWS = 500_000


class Node:
    __slots__ = ("children", "inside", "label", "no_content", "size", "tag")

    def __init__(self, tag: str, label: str = "", no_content: bool = False, inside: bool = False):
        self.tag, self.label, self.no_content, self.inside = tag, label or tag, no_content, inside
        self.children: list = []
        self.size = 1


class Leaf:
    """A text of a page: how much of it is links, whether an article has it, whether its element is no content or a heading, and its slot."""

    __slots__ = ("heading", "hidden", "inside", "links", "same", "slot", "text")

    def __init__(self, text: str, links: float, inside: bool, hidden: bool, heading: bool = False):
        self.text, self.links, self.inside, self.hidden, self.heading = text, links, inside, hidden, heading
        self.slot: int | None = None
        self.same = False


def marked(names: str, inside: bool) -> bool:
    """Whether class, id or role say that an element is no content; a header in an article is the article's."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w and not w.isdigit()]
        own = inside or any(w in OWNERS or w in ("section", "content") for w in words)
        if all(w in MARKS or w in PLACES or w in OWNERS for w in words) and any(w in MARKS and not (own and w == "header") for w in words):
            return True
    return False


class _Parser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.count: Counter = Counter()

    def parent(self) -> Node:
        return self.open[min(len(self.open) - 1, DEPTH)]

    def cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.count[node.tag] -= 1
        del self.open[i:]

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.count["p"]:
            self._close_within("p", stop=())
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and self.count[tag]:
            self._close_within(tag, stop=("ul", "ol", "dl", "table", "select"))
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        above = self.open[-1]
        inside = above.inside or tag in ARTICLE
        deep = len(self.open) > DEPTH and above.no_content
        hidden = tag in SILENT or tag in BOILERPLATE or (tag == "header" and not inside) or (tag not in ARTICLE and tag not in ("html", "body") and marked(names, inside))
        node = Node(tag, f"{tag}.{names}" if names else tag, hidden or deep, inside)
        self.parent().children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close_within(self, tag, stop):
        for i in range(len(self.open) - 1, 0, -1):
            name = self.open[i].tag
            if name == tag:
                self.cut(i)
                return
            if name in stop or (name in BLOCKS and name != tag and not stop):
                return

    def handle_endtag(self, tag):
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.cut(i)
                return

    def handle_data(self, data):
        if len(self.open) <= DEPTH or not self.open[-1].no_content:
            self.parent().children.append(data)


def parse(html: str) -> Node:
    parser = _Parser()
    parser.feed(html)
    parser.close()
    return parser.root


def skeleton(tree: Node) -> tuple[Node, list[Leaf]]:
    """The page's layout, of block elements alone, whose leaves are the page's texts; and these in page order."""
    leaves: list[Leaf] = []
    run: list[str] = []
    linked = 0

    def end(out: Node, inside: bool, hidden: bool) -> None:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            leaves.append(Leaf(text, min(1.0, linked / len(text)), inside, hidden, out.tag in HEADINGS))
            out.children.append(leaves[-1])
            out.size += 1
        run.clear()
        linked = 0

    def walk(node: Node, out: Node, link: bool, inside: bool, hidden: bool) -> None:
        nonlocal linked
        for c in node.children:
            if isinstance(c, str):
                run.append(c)
                linked += len(c.strip()) if link else 0
            elif c.tag in SILENT:
                continue
            elif c.tag == "br":
                run.append(" ")
            elif c.tag in BLOCKS:
                end(out, inside, hidden)
                child = Node(c.tag, c.label)
                out.children.append(child)
                within = inside or c.tag in ARTICLE
                walk(c, child, link, within, hidden or c.no_content)
                end(child, within, hidden or c.no_content)
                out.size += child.size
            elif not c.no_content:
                walk(c, out, link or c.tag == "a", inside, hidden)

    top = Node(tree.tag, tree.label)
    walk(tree, top, False, False, False)
    end(top, False, False)
    return top, leaves


Pairs = list[tuple[Leaf, Leaf]]


class Forms:
    """Subtrees of two trees by what an alignment sees of them: labels, and those texts that both trees have. Equal subtrees have one number, by which sizes are kept."""

    def __init__(self, a: Node | Leaf, b: Node | Leaf):
        self.numbers: dict = {}
        self.labels: list[str | None] = [None]  # 0: a leaf whose text is in one tree alone
        self.children: list[tuple[int, ...]] = [()]
        self.whole = [1]  # what a subtree has with its equal
        self.of: dict[int, int] = {}
        self.sizes: dict[tuple[int, int], int] = {}
        self.shared = self.texts(a, set()) & self.texts(b, set())
        self.number(a)
        self.number(b)

    def texts(self, tree: Node | Leaf, into: set[str]) -> set[str]:
        if isinstance(tree, Leaf):
            into.add(tree.text)
        else:
            for c in tree.children:
                self.texts(c, into)
        return into

    def number(self, tree: Node | Leaf) -> int:
        leaf = isinstance(tree, Leaf)
        if leaf and tree.text not in self.shared:
            n = 0
        else:
            below = () if leaf else tuple([self.number(c) for c in tree.children])
            key = tree.text if leaf else (tree.label, below)
            n = self.numbers.get(key)
            if n is None:
                n = self.numbers[key] = len(self.labels)
                self.labels.append(None if leaf else tree.label)
                self.children.append(below)
                self.whole.append(2 if leaf else 1 + sum([self.whole[c] for c in below]))
        self.of[id(tree)] = n
        return n

    def size(self, x: int, y: int) -> int:
        """The largest matching of two subtrees whose roots match."""
        if x == y:
            return self.whole[x]
        if self.labels[x] != self.labels[y]:
            return 0
        if self.labels[x] is None:
            return 1
        found = self.sizes.get((x, y))
        if found is None:
            xs, ys = self.children[x], self.children[y]
            same = equal_end(xs, ys)
            end = sum([self.whole[c] for c in xs[len(xs) - same :]])
            last = None
            for last in self.rows(xs[: len(xs) - same], ys[: len(ys) - same]):
                pass
            found = self.sizes[x, y] = 1 + end + int(last[0][-1])
        return found

    def rows(self, xs: tuple[int, ...], ys: tuple[int, ...]) -> Iterator[tuple]:
        """For 0, 1, ... of xs: the best with the first 0, 1, ... of ys, and the sizes of the last one of xs with each."""
        n, wide = len(ys), len(ys) > 64
        row = np.zeros(n + 1, np.int32) if wide else [0] * (n + 1)
        yield row, None
        for x in xs:
            w = [self.size(x, y) for y in ys]
            if wide:
                w = np.array(w, np.int32)
                row = np.concatenate([row[:1], np.maximum.accumulate(np.maximum(row[1:], row[:-1] + w))])
            else:
                above, row, most = row, [0], 0
                for j in range(n):
                    most = max(most, above[j + 1], above[j] + w[j])
                    row.append(most)
            yield row, w

    def pairs(self, a: Node | Leaf, b: Node | Leaf, into: Pairs) -> None:
        """The leaves that the largest matching of two trees with matching roots puts together, in order."""
        if isinstance(a, Leaf):
            into.append((a, b))
            return
        if self.of[id(a)] == self.of[id(b)]:
            for x, y in zip(a.children, b.children, strict=True):
                self.pairs(x, y, into)
            return
        xs, ys = self.children[self.of[id(a)]], self.children[self.of[id(b)]]
        same = equal_end(xs, ys)
        i, j = len(xs) - same, len(ys) - same
        chosen = [(len(xs) - k, len(ys) - k) for k in range(1, same + 1)]
        best, sizes = zip(*self.rows(xs[:i], ys[:j]), strict=True)
        while i and j:
            w = sizes[i][j - 1]
            if w and best[i][j] == best[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                chosen.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        for i, j in reversed(chosen):
            self.pairs(a.children[i], b.children[j], into)


def equal_end(xs: tuple[int, ...], ys: tuple[int, ...]) -> int:
    """How many at the end are equal: a largest matching has them together."""
    n = 0
    while n < len(xs) and n < len(ys) and xs[-1 - n] == ys[-1 - n]:
        n += 1
    return n


def align(a: Node | Leaf, b: Node | Leaf) -> tuple[int, Pairs]:
    """Simple tree matching: the largest order-keeping matching of two trees whose roots match, as (size, pairs); equal texts count double."""
    forms, pairs = Forms(a, b), []
    size = forms.size(forms.of[id(a)], forms.of[id(b)])
    if size:
        forms.pairs(a, b, pairs)
    return size, pairs


def in_order(a: Node, b: Node) -> tuple[int, Pairs]:
    """Not the largest matching but one in linear time at each level of the trees, which `align` doesn't use: equal children at both ends are paired from there, what lies between by runs of equal labels."""
    kind = lambda c: c.label if isinstance(c, Node) else ""
    xs, ys = a.children, b.children
    lo, most = 0, min(len(xs), len(ys))
    while lo < most and kind(xs[lo]) == kind(ys[lo]):
        lo += 1
    hi = 0
    while hi < most - lo and kind(xs[-1 - hi]) == kind(ys[-1 - hi]):
        hi += 1
    chosen = [*zip(xs[:lo], ys[:lo], strict=True)]
    runs = [[list(g) for _, g in itertools.groupby(c[lo : len(c) - hi], key=kind)] for c in (xs, ys)]
    at = 0
    for run in runs[0]:
        place = next((k for k in range(at, min(at + 8, len(runs[1]))) if kind(runs[1][k][0]) == kind(run[0])), None)
        if place is not None:
            chosen += zip(run, runs[1][place])  # noqa: B905 the shorter run decides
            at = place + 1
    chosen += zip(xs[len(xs) - hi :], ys[len(ys) - hi :], strict=True)
    size, pairs = 1, []
    for x, y in chosen:
        more, part = align(x, y)
        size += more
        pairs += part
    return size, pairs


@lru_cache(512)
def reference(html: str) -> Node:
    """The skeleton of a host's reference page, its leaves numbered."""
    tree, leaves = skeleton(parse(html))
    for number, leaf in enumerate(leaves):
        leaf.slot = number
    return tree


BLOCK = "array<struct<slot:int,same:boolean,text:string,article:boolean,outside:boolean,links:double,heading:boolean>>"
_BLOCK = pa.list_(pa.struct([("slot", pa.int32()), ("same", pa.bool_()), ("text", pa.string()), ("article", pa.bool_()), ("outside", pa.bool_()), ("links", pa.float64()), ("heading", pa.bool_())]))


def page_blocks(html: str, reference_html: str) -> list[dict]:
    """The page's content candidates in page order, with their slots; `outside` are those beside articles with most of the text."""
    tree, leaves = skeleton(parse(html))
    for slot, leaf in align(reference(reference_html), tree)[1]:
        leaf.slot, leaf.same = slot.slot, slot.text == leaf.text
    found = [x for x in leaves if not x.hidden]
    most = sum(len(x.text) for x in found if x.inside) > sum(len(x.text) for x in found if not x.inside and x.links < LINK_SHARE)
    return [{"slot": x.slot, "same": x.same, "text": x.text, "article": x.inside, "outside": most and not x.inside, "links": x.links, "heading": x.heading} for x in found]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [page_blocks(h.as_py(), r.as_py()) for h, r in zip(batch.column(3), batch.column(4), strict=True)]
        yield pa.record_batch([*batch.columns[:3], pa.array(found, _BLOCK)], ["page_id", "url", "host", "blocks"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`.

    Null html counts as empty and gives an empty text; pages without a host
    form one host.  Repeated rows give repeated results; null ids are kept; an
    empty table gives no rows; other columns are ignored, whatever their names.
    Pages of any length and depth are read whole.  `pages` must read
    the same three times.
    """
    host = F.lower(F.coalesce(F.regexp_extract(pages[url_col], r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), text_of(pages, html_col).alias("html"), host.alias("host"), F.monotonically_increasing_id().alias("rid"))
    first = written(rows.groupBy("host").agg(F.min(F.struct(F.col("page_id").isNull(), F.col("page_id"), F.col("rid"))).alias("first")).select("host", F.col("first.rid").alias("rid")), "first")
    # a row of some tens of bytes a host: pages need no shuffle to find those that are first, unless hosts are very many
    chosen = F.broadcast(first.select("rid")) if first.count() <= BROADCAST_ROWS else first.select("rid")
    heads = written(rows.join(chosen, "rid", "left_semi").select("host", F.col("html").alias("reference")), "references")
    drop(first)
    # a page a host: small for any but the widest crawls, beyond which the pages are shuffled by host
    size = heads.agg(F.coalesce(F.sum(F.octet_length("reference")), F.lit(0))).first()[0]
    paired = rows.join(F.broadcast(heads) if size <= BROADCAST_BYTES else heads, "host").select("page_id", "url", "host", "html", "reference")
    kinds = dict(rows.dtypes)
    found = written(paired.mapInArrow(_blocks, f"page_id {kinds['page_id']}, url string, host string, blocks {BLOCK}"), "blocks")
    # pages of the same texts are one page's evidence: a number for each slot, odd where the text is the reference's
    numbers = F.transform(F.filter("blocks", lambda b: b["slot"].isNotNull()), lambda b: 2 * b["slot"] + b["same"].cast("int"))
    versions = found.select("host", F.xxhash64(F.transform("blocks", lambda b: b["text"])).alias("version"), numbers.alias("numbers")).groupBy("host", "version").agg(F.first("numbers").alias("numbers"))
    slots = versions.select("host", F.explode("numbers").alias("x")).groupBy("host", F.expr("x div 2").cast("int").alias("slot")).agg(F.count("*").alias("n"), F.sum(F.col("x") % 2).alias("same"))
    constant = (F.col("n") >= TEMPLATE_PAGES) & (F.col("same") >= TEMPLATE_SHARE * F.col("n"))
    template = slots.groupBy("host").agg(F.collect_set(F.when(constant, F.col("slot"))).alias("template"), (F.max("n") >= TEMPLATE_PAGES).alias("judged"))
    told = F.coalesce(F.col("judged"), F.lit(False))
    # a page's own text that is not the constant one is content, whatever stands there elsewhere
    flagged = F.transform("blocks", lambda b: b["same"] & F.coalesce(F.array_contains("template", b["slot"]), F.lit(False)))

    def own(b, i):
        after = F.try_element_at("blocks", i + 2)
        # a heading that many articles have ("References") belongs to what follows it, if that is the page's own
        heads = b["heading"] & b["article"] & F.coalesce(after["article"] & ~after["heading"] & ~F.try_element_at("flagged", i + 2), F.lit(False))
        return (b["article"] | (b["links"] < LINK_SHARE)) & (told | ~b["outside"]) & (~F.get("flagged", i) | heads)

    # a host's template lists slots of its reference: where those were small, so is this
    texts = found.join(F.broadcast(template) if size <= BROADCAST_BYTES else template, "host", "left").withColumn("flagged", flagged)
    texts = texts.select("page_id", "url", F.array_join(F.transform(F.filter("blocks", own), lambda b: b["text"]), "\n\n").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))
