"""From blocks of pages to sections and chunks, and from texts and JSON payloads to sections."""

from __future__ import annotations

import json
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from quarrylight import config
from quarrylight.functions import predicates as p
from quarrylight.functions import text, urls
from quarrylight.operators import rows

HEADINGS = ("h2", "h3", "h4")


def clean_blocks(blocks: DataFrame, key: str, least: int = config.MIN_BLOCK_CHARS) -> DataFrame:
    """(key, pos, kind, text) without noise: short and boilerplate blocks, by-lines and contents with what follows them, lists of contents, repeats.

    A block is skipped while the last heading before it is one of contents; any other
    heading, kept or not, ends that.
    """
    at = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    heading = F.col("kind").isin(*HEADINGS)
    body = text.cleaned(F.col("text"))
    df = blocks.select(key, "pos", "kind", body.alias("text"))
    df = df.withColumn("toc", F.coalesce(F.last(F.when(heading, F.col("text").rlike(config.TOC_HEADING)), True).over(at), F.lit(False)))
    kept = F.when(heading, ~p.noise_heading(F.col("text"))).otherwise(~F.col("toc")) & ~p.noise_text(F.col("text"), least) & ~((F.col("kind") == "list") & p.toc_list(F.col("text")))
    return rows.keep_first(df.filter(kept).drop("toc"), [key, "kind", "text"], "pos")


def sections(blocks: DataFrame, key: str, url: Column | None = None) -> DataFrame:
    """(key, ordinal, section_id, heading_path, heading_text, text, spans) from clean blocks.

    Headings are filled forward, one of a level resets those below; blocks
    before any are the introduction.  Parts with the same path are one section where its
    first stands; empty sections and ones under noise go.
    """
    at = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    level = lambda k: F.col("kind") == k
    df = blocks.withColumn("g2", F.sum(level("h2").cast("int")).over(at)).withColumn("g3", F.sum(F.col("kind").isin("h2", "h3").cast("int")).over(at))
    within = lambda *more: W.partitionBy(key, *more).orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    filled = lambda k, w: F.last(F.when(level(k), F.col("text")), True).over(w)
    df = df.withColumn("a", filled("h2", within())).withColumn("b", filled("h3", within("g2"))).withColumn("c", filled("h4", within("g3")))
    path = F.array_compact(F.array("a", "b", "c"))
    df = df.filter(~F.col("kind").isin(*HEADINGS)).withColumn("path", F.when(F.size(path) > 0, path).otherwise(F.array(F.lit("Introduction"))))
    made = df.groupBy(key, "path").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("parts"))
    body = text.strip(F.array_join(F.transform("parts", lambda x: x["text"]), "\n\n"))
    joined = F.array_join("path", " > ")
    made = made.select(key, F.col("parts")[0]["pos"].alias("first_pos"), joined.alias("heading_path"), F.element_at("path", -1).alias("heading_text"), body.alias("text"), F.transform("parts", lambda x: x["pos"]).alias("spans"))
    made = made.filter((F.col("text") != "") & ~p.noise_heading(F.col("heading_text")))
    where = F.col(key).cast("string") if url is None else url
    made = made.withColumn("section_id", F.concat(F.substring(F.sha1(where), 1, 12), F.lit("_"), F.substring(F.sha1("heading_path"), 1, 16)))
    return rows.numbered(made, "ordinal", [key], "first_pos").drop("first_pos")


def token_windows(c: Column, most: int = 400, overlap: int = 80, tokens: Column | None = None, glue: str = " ") -> Column:
    """array<string>: the text as it is if it has at most `most` tokens, else windows that overlap, stripped, blank ones left out.

    `tokens` is an array of the text's tokens (words where none is given), which `glue` joins.
    """
    t = text.words(c) if tokens is None else tokens
    stride = max(most - overlap, 1)
    starts = F.sequence(F.lit(0), F.ceil((F.size(t) - most) / F.lit(stride)).cast("int"))
    cut = F.transform(starts, lambda i: text.strip(F.array_join(F.slice(t, i * stride + 1, F.lit(most)), glue)))
    return F.when(F.size(t) <= most, F.array(c)).otherwise(F.filter(cut, lambda x: x != ""))


WINDOW = "array<struct<start:int,end:int,tokens:int,text:string>>"
_tokenizers: dict = {}


def bpe_windows(spark: SparkSession, file: str, most: int = 400, overlap: int = 80):
    """A function of a text column: windows of `most` tokens that overlap, with the characters that they begin and end at.

    `file` is a tokenizer's JSON, read by the driver and sent to the executors.
    Windows are cut in the stream of ids and mapped back to characters, so that
    one cut within a character has the whole of it.  A text of at most
    `most` tokens is one window as it is; others are stripped, and blank ones left out. Null is an empty text.
    """
    with open(file, encoding="utf-8") as f:
        shipped = spark.sparkContext.broadcast(f.read())
    stride = max(most - overlap, 1)

    def cut(said: str | None) -> list[tuple[int, int, int, str]]:
        said = said or ""
        spots = _tokenizer(shipped).encode(said, add_special_tokens=False).offsets
        if len(spots) <= most:
            return [(0, len(said), len(spots), said)]
        out = []
        for at in range(0, len(spots) - most + stride, stride):
            mine = spots[at : at + most]
            piece = said[mine[0][0] : mine[-1][1]]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip():
                out.append((mine[0][0] + lead, mine[0][0] + lead + len(piece.strip()), len(mine), piece.strip()))
        return out

    @F.arrow_udf(WINDOW)
    def windows(texts: pa.Array) -> pa.Array:
        # one text at a time is a Python object; windows are kept as numbers and bytes
        starts, numbers, ends, held = array("i", [0]), array("i"), array("i", [0]), bytearray()
        for t in texts:
            for start, end, tokens, piece in cut(t.as_py()):
                numbers.extend((start, end, tokens))
                held += piece.encode("utf-8")
                ends.append(len(held))
            starts.append(len(ends) - 1)
        said = pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(held))
        columns = [pa.array(np.array(numbers, np.int32)[i::3]) for i in range(3)]
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([*columns, said], ["start", "end", "tokens", "text"]))

    return windows


def _tokenizer(shipped):
    """The tokenizer of a broadcast file; one per worker process."""
    from tokenizers import Tokenizer

    key = hash(shipped.value)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer.from_str(shipped.value)
        _tokenizers[key].encode_special_tokens = True
    return _tokenizers[key]


def chunks(found: DataFrame, url: Column, title: Column, page_kind: Column, service: Column, model: str = "hashed-bag", most: int = 400, overlap: int = 80, cap: int = 0, tokenizer: str | None = None) -> DataFrame:
    """Chunks of sections with ids, texts to embed and metadata; `cap` above 0 is the most a page gives, `tokenizer` the file whose tokens count in place of words."""
    made = ("source_url", "doc_title", "page_kind", "service", "chunk_index", "chunk_text")
    windows = F.transform(bpe_windows(found.sparkSession, tokenizer, most, overlap)(F.col("text")), lambda w: w["text"]) if tokenizer else token_windows(F.col("text"), most, overlap)
    df = found.select(*(c for c in found.columns if c not in made), url.alias("source_url"), title.alias("doc_title"), page_kind.alias("page_kind"), service.alias("service"), F.posexplode(windows).alias("chunk_index", "chunk_text"))
    if cap > 0:
        df = rows.numbered(df, "in_page", ["source_url"], "ordinal", "chunk_index").filter(F.col("in_page") <= cap).drop("in_page")
    key = F.concat_ws("|", "source_url", "section_id", F.col("chunk_index").cast("string"), F.lit(model))
    return df.withColumn("chunk_id", F.sha1(key)).withColumn("content_sha1", F.sha1("chunk_text")).withColumn("embed_text", embed_text()).withColumn("chunk_char_len", F.length("chunk_text"))


def embed_text() -> Column:
    """What a chunk is embedded as: title, kind, a note on prices, section and text; package pages with service and package."""
    line = lambda label, c: F.when(p.said(c) != "", F.concat(F.lit(f"{label}: "), c, F.lit("\n"))).otherwise("")
    note = F.when(F.col("page_kind").isin(*config.PRICE_KINDS), "PriceDisclaimer: public starting-from price, not a quote. Drive SKU rows win on exact fees.\n").otherwise("")
    package = (F.col("page_kind") == "product_detail") & (p.said(F.col("service")) != "")
    head = F.when(package, F.concat(line("Service", F.col("service")), line("Package", F.col("doc_title")))).otherwise(line("Title", F.col("doc_title")))
    return F.concat(head, line("PageKind", F.col("page_kind")), note, line("Section", F.col("heading_path")), F.col("chunk_text"))


# pages


def page_title(html: Column) -> Column:
    """The first heading that says something, the title shared, or the document's."""
    one = lambda pattern: F.nullif(text.cleaned(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]+>", " ")), F.lit(""))
    return F.coalesce(one(r"(?is)<h1[^>]*>(.*?)</h1>"), one(r"""(?is)<meta[^>]+property=["']og:title["'][^>]+content=["']([^"']*)"""), one(r"(?is)<title[^>]*>(.*?)</title>"), F.lit("Untitled"))


def page_author(html: Column) -> Column:
    one = lambda pattern: F.nullif(text.cleaned(F.regexp_replace(F.regexp_extract(html, pattern, 1), "<[^>]+>", " ")), F.lit(""))
    return F.coalesce(one(r"""(?is)<meta[^>]+name=["']author["'][^>]+content=["']([^"']*)"""), one(r"""(?is)<[a-z]+[^>]+(?:rel|class)=["'][^"']*\bauthor\b[^"']*["'][^>]*>(.*?)</"""))


def page_date(html: Column) -> Column:
    one = lambda pattern: F.nullif(F.trim(F.regexp_extract(html, pattern, 1)), F.lit(""))
    return F.coalesce(one(r"""(?is)<meta[^>]+property=["']article:published_time["'][^>]+content=["']([^"']*)"""), one(r"""(?is)<time[^>]+datetime=["']([^"']*)"""), one(r"\b(\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{4})\b"))


def page_category(html: Column, url: Column) -> Column:
    """struct<name, url> of the first link to a category, or null."""
    pattern = r"""(?is)<a\s[^>]*href=["']([^"']*/blog/category/[^"']*)["'][^>]*>(.*?)</a>"""
    href = F.regexp_extract(html, pattern, 1)
    name = text.cleaned(F.regexp_replace(F.regexp_extract(html, pattern, 2), "<[^>]+>", " "))
    return F.when(href != "", F.struct(name.alias("name"), urls.canonicalised(href, url).alias("url")))


def assembled(key: str, first: DataFrame, then: DataFrame, least: int = 40) -> DataFrame:
    """Sections (key, ordinal, heading_text, text) of a document: the first ones, then those under new headings that are long enough."""
    a = first.select(key, F.lit(0).alias("src"), "ordinal", "heading_text", "text")
    b = then.filter(F.length("text") >= least).select(key, F.lit(1).alias("src"), "ordinal", "heading_text", "text")
    kept = rows.keep_first(a.unionByName(b).withColumn("name", F.lower(F.trim("heading_text"))), [key, "name"], "src", "ordinal")
    return rows.numbered(kept, "place", [key], "src", "ordinal").select(key, F.col("place").alias("ordinal"), "heading_text", "text")


# texts


def marker_split(c: Column, markers: dict[str, str]) -> Column:
    """map<label, text>: what stands between one marker and the next that the text has; of a label's several markers the last counts."""
    places = F.array(*(F.struct(F.instr(c, marker).alias("at"), F.lit(len(marker)).alias("n"), F.lit(label).alias("label")) for marker, label in markers.items()))
    found = F.array_sort(F.filter(places, lambda x: x["at"] > 0))
    parts = F.transform(found, lambda x, i: F.struct(x["label"].alias("label"), text.strip(F.substring(c, x["at"] + x["n"], F.coalesce(F.get(found, i + 1)["at"], F.length(c) + 1) - x["at"] - x["n"])).alias("text")))
    names = F.array_distinct(F.transform(parts, lambda x: x["label"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(parts, lambda x: x["label"] == n), -1)["text"]))


def after_first(items: Column) -> Column:
    """All items but the first."""
    return F.filter(items, lambda _, i: i > 0)


def question_answers(c: Column) -> Column:
    """array<struct<question, answer>>: numbered questions and what follows them, else lines that end in a question mark and the lines after."""
    numbered = after_first(F.split(F.concat(F.lit("\n"), c), r"\s\d{1,2}[.)]\s+"))
    one = lambda x: F.struct(text.strip(F.regexp_extract(x, r"(?s)^([^?]*\?)(.*)$", 1)).alias("question"), text.strip(F.regexp_extract(x, r"(?s)^([^?]*\?)(.*)$", 2)).alias("answer"))
    full = lambda xs: F.filter(xs, lambda x: (x["question"] != "") & (x["answer"] != ""))
    first = full(F.transform(numbered, one))
    lines = F.transform(F.filter(F.split(c, "\n"), lambda x: F.trim(x) != ""), lambda x: F.when(F.trim(x).endswith("?"), F.concat(F.lit("\x01"), F.trim(x), F.lit("\x02"))).otherwise(F.trim(x)))
    pieces = after_first(F.split(F.array_join(lines, "\n"), "\x01"))
    second = full(F.transform(pieces, lambda x: F.struct(F.substring_index(x, "\x02", 1).alias("question"), text.strip(F.regexp_replace(x, "(?s)^.*?\x02", "")).alias("answer"))))
    return F.when(F.size(first) > 0, first).otherwise(second)


def points(c: Column) -> Column:
    """Points of a list in running text: bullets, lines, or numbers before capitals."""
    cut = F.split(c, r"\s*[•●▪]\s*|\n+|\s+(?=\d{1,2}[.)]\s+\p{Lu})")
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(F.trim(x), r"^(?:\d{1,2}[.)]|[-–])\s+", "")), lambda x: x != "")


def insights(c: Column) -> Column:
    """array<struct<title, text>>: sentences that begin with a name and a colon, each with what follows up to the next."""
    cut = F.split(c, r"(?<=[.!?])\s+(?=\p{Lu}[^.:!?]{2,60}:\s)")
    return F.filter(F.transform(cut, lambda x: F.struct(F.trim(F.regexp_extract(x, r"^([^:]{2,62}):\s", 1)).alias("title"), text.strip(F.regexp_replace(x, r"^[^:]{2,62}:\s", "")).alias("text"))), lambda x: x["title"] != "")


def paragraphs(c: Column, size: int = 2) -> Column:
    """Paragraphs in groups of `size`."""
    found = F.filter(F.transform(F.split(c, r"\n\s*\n"), text.strip), lambda x: x != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(size))
    return F.when(F.size(found) == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(found, i + 1, F.lit(size)), "\n\n")))


def objects_in(said: str) -> list[str]:
    """The JSON objects of a text that are in no other one, as they stand there."""
    reader, out, at = json.JSONDecoder(), [], said.find("{")
    while at >= 0:
        try:
            found, end = reader.raw_decode(said, at)
        except (ValueError, RecursionError):
            end = at + 1
        else:
            out.append(json.dumps(found))
        at = said.find("{", end)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def _objects(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: objects_in((t or "").replace('\\"', '"')))


def embedded_objects(c: Column, fields: tuple[str, ...] = ("slug", "type")) -> Column:
    """Objects that a page's script carries, escaped or not, and that have all `fields`; braces within strings and inner objects are told apart, which no pattern can."""
    return F.filter(_objects(c), lambda x: F.size(F.array_except(F.array(*map(F.lit, fields)), F.coalesce(F.json_object_keys(x), F.array().cast("array<string>")))) == 0)


def embedded_catalog(pages: DataFrame) -> DataFrame:
    """(url, slug, type, title, price) of objects that pages (url, html) carry, each slug once a page and where it stands first."""
    df = pages.select("url", F.posexplode(embedded_objects(F.col("html"))).alias("pos", "x"))
    field = lambda k: F.get_json_object("x", f"$.{k}").alias(k)
    return rows.keep_first(df.select("url", "pos", *map(field, ("slug", "type", "title", "price"))), ["url", "slug"], "pos").drop("pos")
