"""What no built-in function says: blocks of HTML, rich text of any depth, greedy pairing of text blocks."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADINGS, LISTS = {"h2", "h3", "h4"}, {"ul", "ol"}
SILENT = {"script", "style", "noscript", "nav", "footer", "aside", "form", "iframe", "svg", "button", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("text", T.StringType())]))


class BlockReader(HTMLParser):
    """Headings, paragraphs, lists and tables in page order; the innermost open block takes the text, outer lists and tables theirs."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.blocks: list[tuple[str, str, bool]] = []
        self.kind, self.parts = "", []
        self.silent = self.depth = self.articles = 0

    def _close(self) -> None:
        clean = lambda x: " ".join(x.split())
        lines = "".join(self.parts).split("\x1e")
        lines = [" | ".join(map(clean, x.split("\x1f")[1:])) if self.kind == "table" else clean(x) for x in lines]
        text = "\n".join(f"- {x}" if self.kind == "list" else x for x in lines if x)
        if text:
            self.blocks.append((self.kind, text, self.articles > 0))
        self.kind, self.parts = "", []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.parts.append(" ")
            return
        if tag == "p" and self.kind == "p" or tag in HEADINGS and self.kind in HEADINGS | {"p"}:
            self._close()
        self.open.append(tag)
        self.silent += tag in SILENT
        self.articles += tag in ("article", "main")
        if self.silent:
            return
        wanted = tag if tag in HEADINGS | {"p", "table"} else "list" if tag in LISTS else ""
        outer = self.kind in ("list", "table")
        if wanted and not outer:
            if self.kind:
                self._close()
            self.kind, self.depth = wanted, len(self.open)
        elif tag == "li" and self.kind == "list" and sum(x in LISTS for x in self.open[self.depth - 1 :]) == 1 or tag == "tr":
            self.parts.append("\x1e")
        elif tag in ("td", "th"):
            self.parts.append("\x1f")
        else:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            if self.kind and len(self.open) < self.depth:
                self._close()
            self.silent -= last in SILENT
            self.articles -= last in ("article", "main")
            if last == tag:
                break
        self.parts.append(" ")

    def handle_data(self, data):
        if self.kind and not self.silent:
            self.parts.append(data.replace("\x1e", " ").replace("\x1f", " "))


def blocks_of(html: str | None) -> list[tuple[int, str, str]]:
    """Blocks of the article where it says over 200 characters, else of the page; null and empty pages have none."""
    reader = BlockReader()
    reader.feed(html or "")
    reader.close()
    if reader.kind:
        reader._close()
    inside = [x for x in reader.blocks if x[2]]
    chosen = inside if sum(len(x[1]) for x in inside) > 200 else reader.blocks
    return [(i, kind, text) for i, (kind, text, _) in enumerate(chosen)]


@F.pandas_udf(BLOCKS)
def html_blocks(html: pd.Series) -> pd.Series:
    return html.map(lambda x: [dict(zip(("pos", "kind", "text"), b, strict=True)) for b in blocks_of(x)])


def plain_of(said: str | None) -> str:
    """The texts of a rich-text node and its children, in order; a walk with a list, so that no depth is too much."""
    try:
        left = [json.loads(said or "null")]
    except (ValueError, RecursionError):
        return ""
    out = []
    while left:
        node = left.pop()
        if isinstance(node, str):
            out.append(node)
        elif isinstance(node, dict):
            if isinstance(node.get("text"), str):
                out.append(node["text"])
            left += reversed(node.get("children") or [])
    return "".join(out)


@F.pandas_udf(T.StringType())
def rich_text(node: pd.Series) -> pd.Series:
    return node.map(plain_of)


def pair_blocks(blocks: DataFrame, most: int, headers: frozenset[str] = frozenset()) -> DataFrame:
    """page, left_text, right_text: each left block, from the top, takes the nearest right one still free, within `most`.

    `blocks` has page, side (left or right), top, bottom, text.  Order decides, so a
    page's rows come together, sorted, and stream through a task; a page's blocks are few.  Headings and bare numbers on
    the left are left out, headings on the right never taken; ties go to the upper.
    """

    def paired(page, rows: list[tuple]) -> list[tuple]:
        left, right = [], []
        for side, top, bottom, text in rows:
            low = text.lower().strip()
            if low in headers:
                continue
            if side == "right":
                if low != "frequency":
                    right.append((top, bottom, text))
            elif side == "left" and not (low.replace(".", "") in headers or low.isdigit() or ("particular" in low and len(low) < 20)):
                left.append((top, bottom, text))
        free, out = list(range(len(right))), []
        for top, bottom, text in left:
            best = min(free, key=lambda i: max(0, right[i][0] - bottom, top - right[i][1]), default=None)
            if best is not None and max(0, right[best][0] - bottom, top - right[best][1]) <= most:
                free.remove(best)
                out.append((page, text, right[best][2]))
            else:
                out.append((page, text, ""))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        out: list[tuple] = []
        for page, group in itertools.groupby(rows, key=lambda r: r[0]):
            out += paired(page, [r[1:] for r in group])
            if len(out) >= 20_000:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 3, kinds, strict=True)], names)

    names, kinds = ["page", "left_text", "right_text"], [pa.int64(), pa.string(), pa.string()]
    kept = blocks.select(F.col("page").cast("long"), "side", F.col("top").cast("long"), F.col("bottom").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.repartition("page").sortWithinPartitions("page", "top", "bottom", "text").mapInArrow(run, "page long, left_text string, right_text string")
