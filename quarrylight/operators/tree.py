"""A page's tree as rows, and what is found in it by joins: cards of services with a price."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import text
from quarrylight.operators import rows
from quarrylight.operators.pages import VOID

#: Elements of more text than this are given without it, so that rows grow with the page and not with its depth.
LONGEST = 2_500
#: Elements whose text nobody sees.
UNSEEN = {"script", "style", "template", "noscript"}
#: A row looks so many elements up, itself among them.
UP = 10
DOM = "pre int, last int, parent int, tag string, label string, text string, up array<int>, block int"


class _Reader(HTMLParser):
    """Nodes in page order: elements, and texts as children with the tag #text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[int] = []
        self.unseen = 0

    def _add(self, tag: str, label: str | None, said: str | None) -> int:
        at = len(self.nodes)
        above = self.open[-1] if self.open else None
        up = [at, *(self.nodes[above]["up"][: UP - 1] if above is not None else [])]
        block = None if above is None else above if self.nodes[above]["tag"] == "div" else self.nodes[above]["block"]
        self.nodes.append({"pre": at, "last": at, "parent": above, "tag": tag, "label": label, "parts": [said] if said else [], "size": len(said or ""), "up": up, "block": block})
        return at

    def handle_starttag(self, tag, attrs):
        if tag == "p" and any(self.nodes[i]["tag"] == "p" for i in self.open):
            self.handle_endtag("p")
        at = self._add(tag, dict(attrs).get("aria-label") or None, None)
        if tag not in VOID:
            self.open.append(at)
            self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if not any(self.nodes[i]["tag"] == tag for i in self.open):
            return
        while self.open:
            at = self.open.pop()
            self._end(at)
            if self.nodes[at]["tag"] == tag:
                return

    def _end(self, at: int) -> None:
        node = self.nodes[at]
        node["last"] = len(self.nodes) - 1
        self.unseen -= node["tag"] in UNSEEN
        if self.open and node["parts"]:
            above = self.nodes[self.open[-1]]
            above["size"] += node["size"] + bool(above["parts"])
            # a text that has grown too long is not carried further, only its length
            above["parts"] = above["parts"] + node["parts"] if above["size"] <= LONGEST else above["parts"][:1] or node["parts"][:1]

    def handle_data(self, data):
        said = data.strip()
        if said and not self.unseen:
            self._add("#text", None, said)
            self.open.append(len(self.nodes) - 1)
            self._end(self.open.pop())

    def rows(self):
        while self.open:
            self._end(self.open.pop())
        for n in self.nodes:
            yield n["pre"], n["last"], n["parent"], n["tag"], n["label"], " ".join(n["parts"]) if n["size"] <= LONGEST else None, n["up"], n["block"]


@F.udtf(returnType=DOM)
class PageTree:
    """Nodes of a page in order: `last` is the last node within one, `up` itself and what holds it, nearest first, `block` the nearest div around it; null and empty pages have none."""

    def eval(self, html: str):
        reader = _Reader()
        reader.feed(html or "")
        reader.close()
        yield from reader.rows()


def nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """(key, pre, last, parent, tag, label, text, up, block) of pages (key, html)."""
    return pages.lateralJoin(PageTree(F.col(html).outer())).select(key, *(c.split()[0] for c in DOM.replace("array<int>", "a").split(", ")))


def service_cards(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """(key, ordinal, title, text) of cards with a price: by headings, then by texts that tell what a price starts from; each title once a page.

    A heading's card is the nearest element around it, within UP of them, that
    tells a starting price in 41 to 2,499 characters, else the nearest div.  A
    text's card is the nearest element above it, within 8, that has a price in 21
    to 2,499 characters; its title is the first heading in it, else its first paragraph of 13 to
    119 characters that tells no starting price.
    """
    tree = rows.stored(nodes(pages, key, html))
    price, starting = (lambda c: c.rlike(config.CARD_PRICE)), (lambda c: c.rlike("(?i)starting from"))
    name = F.coalesce("label", "text")
    heads = tree.filter(F.col("tag").isin("h2", "h3")).select(key, "pre", name.alias("title"), "up", "block")
    held = tree.filter("tag <> '#text'").select(key, F.col("pre").alias("at"), F.col("text").alias("body"))
    fits = F.col("body").isNotNull() & starting(F.col("body")) & price(F.col("body")) & (F.length("body") > 40) & (F.length("body") < LONGEST)
    near = heads.select(key, "pre", "title", F.posexplode("up").alias("far", "at")).join(held.filter(fits), [key, "at"])
    best = rows.keep_first(near, [key, "pre"], "far").select(key, "pre", "title", "body")
    others = heads.join(best.select(key, "pre"), [key, "pre"], "left_anti").join(held.withColumnRenamed("at", "block"), [key, "block"]).select(key, "pre", "title", "body")
    first = best.unionByName(others).withColumn("src", F.lit(0))

    told = tree.filter("tag = '#text'").filter(starting(F.col("text"))).select(key, "pre", F.posexplode(F.slice("up", 2, 8)).alias("far", "at"))
    priced = held.filter(F.col("body").isNotNull() & price(F.col("body")) & (F.length("body") > 20) & (F.length("body") < LONGEST))
    blocks = rows.keep_first(told.join(priced, [key, "at"]), [key, "pre"], "far").join(tree.select(key, F.col("pre").alias("at"), F.col("last").alias("end")), [key, "at"]).select(key, "pre", "at", "end", "body")
    within = lambda df: (df["k"] == blocks[key]) & (df["n"] > blocks["at"]) & (df["n"] <= blocks["end"])  # noqa: E731 an interval of the page's order
    titles = tree.filter(F.col("tag").isin("h2", "h3", "h4") & name.isNotNull()).select(F.col(key).alias("k"), F.col("pre").alias("n"), name.alias("t"))
    paras = tree.filter("tag = 'p'").select(F.col(key).alias("k"), F.col("pre").alias("n"), text.cleaned(F.col("text")).alias("t")).filter("length(t) BETWEEN 13 AND 119 AND NOT contains(lower(t), 'starting')")
    headed = rows.keep_first(blocks.join(titles, within(titles)), [key, "pre"], "n").select(key, "pre", F.col("t").alias("heading"))
    opened = rows.keep_first(blocks.join(paras, within(paras)), [key, "pre"], "n").select(key, "pre", F.col("t").alias("opening"))
    second = blocks.join(headed, [key, "pre"], "left").join(opened, [key, "pre"], "left").select(key, "pre", F.coalesce("heading", "opening").alias("title"), "body").withColumn("src", F.lit(1))

    every = first.unionByName(second).withColumn("title", text.cleaned(F.col("title"))).withColumn("text", text.cleaned(F.col("body")))
    kept = rows.keep_first(every.filter((F.length("title") >= 8) & price(F.col("text"))), [key, "title"], "src", "pre")
    return rows.numbered(kept, "ordinal", [key], "src", "pre").select(key, "ordinal", "title", "text")
