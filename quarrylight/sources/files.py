"""Readers of files: case lists, entities, CSV and XLSX rows, sitemaps, folder trees, logs."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylight.functions import predicates
from quarrylight.operators import rows

CASE_FIELDS = ("id", "query", "ground_truth", "tags")


def cases(spark: SparkSession, path: str, tags: list[str] | None = None, most: int = 0, schema: str = "id string, query string, ground_truth string, tags array<string>") -> DataFrame:
    """Objects of a JSONL file; blank lines and lines that begin with # are skipped, lines that lack a field raise an error; the first `most` cases where it is above 0."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("no")).filter("line <> '' AND NOT startswith(line, '#')")
    keys = F.json_object_keys("line")
    lacking = F.array_except(F.array(*map(F.lit, CASE_FIELDS)), F.coalesce(keys, F.array().cast("array<string>")))
    checked = F.when(F.size(lacking) == 0, F.col("line")).otherwise(F.raise_error(F.concat(F.lit("missing "), F.array_join(lacking, ", "), F.lit(" in "), "line")))
    found = lines.select("no", F.from_json(checked, schema).alias("x")).select("no", "x.*")
    if tags:
        found = found.filter(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))
    return (found.orderBy("no").limit(most) if most > 0 else found).drop("no")


def entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON file an entity, with its file name; files that are no JSON are skipped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 without its mark, or as Latin-1 where they are no UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.ltrim(content.cast("string"), F.lit("﻿"))).otherwise(F.decode(content, "ISO-8859-1"))


def joined_cells(line: Column) -> Column:
    """The cells of a line of CSV that hold something, joined by bars; quoted cells may hold commas."""
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    clean = F.transform(raw, lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c)))
    return F.array_join(F.filter(clean, lambda c: c != ""), " | ")


def csv_records(text: Column) -> Column:
    """The records of a CSV text: lines, but line ends within quotes are part of their cell."""
    parts = F.regexp_extract_all(text, F.lit(r'((?:[^"\r\n]|"(?:[^"]|"")*+")++)'), F.lit(1))
    return F.filter(parts, lambda x: F.trim(x) != "")


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """path and flat text of CSV files in any of the three encodings."""
    lines = F.transform(csv_records(decoded(F.col("content"))), joined_cells)
    text = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return spark.read.format("binaryFile").load(path).select("path", text.alias("text"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells of CSV files, as xlsx_rows gives them: what reports.header_rows makes lines under headers of."""
    raw = lambda line: F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    clean = lambda c: F.trim(F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    found = spark.read.format("binaryFile").load(path).select("path", F.posexplode(csv_records(decoded(F.col("content")))).alias("row", "line"))
    return found.select("path", F.lit("").alias("sheet"), F.col("row").cast("long").alias("row"), F.transform(raw(F.col("line")), clean).alias("cells"))


def pdf_texts(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """path, text and pages of PDF files by an extractor that gives a file's page texts; page texts are joined by a blank line, files it cannot read have no text."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts = [t.strip() for t in pages_of(bytes(content))]
                except Exception:  # an extractor's own errors are of any kind: the file is reported without text
                    texts = []
                yield pd.DataFrame([(name, "\n\n".join(t for t in texts if t), len(texts))], columns=["path", "text", "pages"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string, pages long")


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, list[str]]]:
    """Sheet, row number and cells of a workbook; whole numbers lose their fraction."""
    local = lambda node: node.tag.rpartition("}")[2]
    said = lambda node: "".join(x.text or "" for x in node.iter() if local(x) == "t")
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        shared = [said(x) for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (x for x in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(x) == "sheet"):
            target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))].lstrip("/")
            for no, row in enumerate(x for x in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter() if local(x) == "row"):
                cells: list[str] = []
                for c in row:
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    cells += [""] * (at - 1 - len(cells))
                    value = next((x.text or "" for x in c if local(x) == "v"), "")
                    if c.get("t") == "s":
                        value = shared[int(value)]
                    elif c.get("t") == "inlineStr":
                        value = said(c)
                    elif c.get("t") in (None, "n") and value and float(value).is_integer():
                        value = str(int(float(value)))
                    cells.append(value.strip())
                yield sheet.get("name"), no, cells


def xlsx_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, cells of every workbook; a task holds one file at a time."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows_ = list(xlsx_cells(bytes(content)))
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, ValueError, StopIteration):
                    rows_ = [(None, -1, [])]  # a file that is no workbook
                yield pd.DataFrame([(name, *x) for x in rows_], columns=["path", "sheet", "row", "cells"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, sheet string, row long, cells array<string>")


def file_kind(name: Column, mime: Column) -> Column:
    """pdf, csv, xlsx or null, by MIME type or else by suffix."""
    low, kind = F.lower(name), F.lower(F.coalesce(mime, F.lit("")))
    return F.when((kind == "application/pdf") | low.endswith(".pdf"), "pdf").when((kind == "text/csv") | low.endswith(".csv"), "csv").when(kind.endswith("spreadsheetml.sheet") | low.endswith(".xlsx"), "xlsx")


def sitemap_locs(xml: Column) -> Column:
    """The addresses of a sitemap, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(r"(?i)<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1)))


def folder_paths(nodes: DataFrame, roots: DataFrame, most: int = 32) -> DataFrame:
    """id and path of every node below `roots` (id), by levels, of `nodes` (id, parent_id, name); an error says when `most` levels do not do."""
    nodes = nodes.select("id", "parent_id", "name")
    level = rows.settled(nodes.join(roots.select("id"), "id", "left_semi").select("id", F.col("name").alias("path")))
    found = level
    for _ in range(most):
        below = nodes.join(level.select(F.col("id").alias("parent_id"), "path"), "parent_id").select("id", F.concat("path", F.lit("/"), "name").alias("path"))
        level = rows.settled(below)
        if not level.head(1):
            return found
        found = found.unionByName(level)
    raise ValueError(f"more than {most} levels, or a circle")


def readable(files: DataFrame, wanted: str | None = None, left_out: list[str] | None = None) -> DataFrame:
    """Files (id, name, mime, path) of a kind that can be read, whose path has `wanted` and whose id is not left out."""
    kept = files.withColumn("kind", file_kind(F.col("name"), F.col("mime"))).filter(F.col("kind").isNotNull() & predicates.path_has(F.col("path"), wanted))
    return kept.filter(~F.col("id").isin(*left_out)) if left_out else kept


def failed_ids(log: Column) -> Column:
    """Ids under `failed` of the JSON object that a log's line holds."""
    found = F.from_json(F.regexp_extract(log, r"(\{.*\})", 1), T.StructType([T.StructField("failed", T.ArrayType(T.StructType([T.StructField("id", T.StringType())])))]))
    return F.coalesce(found["failed"]["id"], F.array().cast("array<string>"))


def ocr_words(data: DataFrame, keys: list[str]) -> DataFrame:
    """Words of arrays text, conf, left, top, width, height; blank ones and ones with a negative or unreadable confidence go."""
    word = F.explode(F.arrays_zip("text", "conf", "left", "top", "width", "height")).alias("w")
    words = data.select(*keys, word).select(*keys, F.trim("w.text").alias("text"), F.expr("int(try_cast(w.conf AS double))").alias("conf"), "w.left", "w.top", "w.width", "w.height")
    return words.filter("text <> '' AND conf >= 0")


def any_file(spark: SparkSession, pattern: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))
