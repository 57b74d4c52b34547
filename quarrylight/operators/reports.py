"""Catalogs, comparisons, reconciliations and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import text
from quarrylight.operators import rows


def in_order(keys: list[str], df: DataFrame, order: str, field: Column, name: str) -> DataFrame:
    """(keys, name): the group's values in order, as a list."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), field.alias("v")))), lambda x: x["v"]).alias(name))


def nested_catalog(listing: DataFrame, service: str, order: str, fields: list[str]) -> DataFrame:
    """(service, n, packages): the named packages of a service in order, as a list of structs with their number."""
    named = listing.filter(F.trim(F.coalesce("name", F.lit(""))) != "")
    return in_order([service], named, order, F.struct(*fields), "packages").select(service, F.size("packages").alias("n"), "packages")


def service_answer(catalog: DataFrame, service: str, question: Column, most: int = 40, shown: int = 8, *more: str) -> DataFrame:
    """A count with names: all of them up to `most` or where a list is asked for, else `shown` and how many more; the columns `more` stay."""
    every = (F.col("n") <= most) | question.rlike(config.LIST_WORD)
    names = F.transform("packages", lambda x: x["name"])
    said = F.when(every, F.array_join(names, "; ")).otherwise(F.concat(F.array_join(F.slice(names, 1, shown), "; "), F.lit(" and "), (F.col("n") - shown).cast("string"), F.lit(" more")))
    return catalog.select(service, "n", *more, F.concat(F.col(service), F.lit(" has "), F.col("n").cast("string"), F.lit(" packages: "), said).alias("answer"))


def country_answer(catalog: DataFrame, question: Column, *more: str, most: int = 12, shown: int = 8) -> DataFrame:
    """(country, kind, n, answer) of a catalog (country, funds, packages: lists of structs name, price, currency): the kind asked for, funds where there are no packages; all where a list is asked for or up to `most`; the columns `more` stay, among them `items` if wanted."""
    kind = F.when(question.rlike(config.FUNDS_CUE) & ~question.rlike(config.PACKAGES_CUE), "funds").when(F.size("packages") > 0, "packages").otherwise("funds")
    items = F.when(kind == "funds", F.col("funds")).otherwise(F.col("packages"))
    price = lambda x: F.coalesce(F.concat(F.lit(" (from "), text.priced(x["price"].cast("string"), x["currency"]), F.lit(")")), F.lit(""))
    lines = lambda xs: F.array_join(F.transform(xs, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"], price(x))), "\n")
    n = F.size(items)
    every = question.rlike(config.LIST_WORD) | (n <= most)
    body = F.when(every, lines(items)).otherwise(F.concat(lines(F.slice(items, 1, shown)), F.lit("\nand "), (n - shown).cast("string"), F.lit(" more")))
    return catalog.withColumn("items", items).select("country", kind.alias("kind"), n.alias("n"), *more, F.concat(F.col("country"), F.lit(" has "), n.cast("string"), F.lit(" "), kind, F.when(n > 0, F.concat(F.lit(":\n"), body)).otherwise(".")).alias("answer"))


def longest_name(question: Column, names: list[str]) -> Column:
    """The longest of the names that a question has, of equal ones the greater; null if it has none."""
    hits = [F.when(F.contains(F.lower(question), F.lit(n.lower())), F.lit(n)) for n in sorted(names, key=lambda n: (len(n), n), reverse=True)]
    return F.coalesce(*hits, F.lit(None).cast("string"))


def first_name(question: Column, aliases: list[tuple[str, str]]) -> Column:
    """The name of the first alias pattern that a question has."""
    return F.coalesce(*(F.when(question.rlike(pattern), F.lit(name)) for pattern, name in aliases), F.lit(None).cast("string"))


def slugs_of(questions: DataFrame, dimension: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, slugs) of countries that a question names, longest names first and each slug once; of fewer than `least` names the shortcodes among its words count too.

    `dimension` has (name, shortcode, slug).
    """
    q = questions.select("query_id", F.concat(F.lit(" "), text.matchable(F.col("question")), F.lit(" ")).alias("q"), F.split(text.matchable(F.col("question")), " ").alias("words"))
    dim = rows.broadcast_if_small(dimension.select(text.matchable(F.col("name")).alias("name"), F.lower("shortcode").alias("shortcode"), "slug"))
    first = F.substring_index("name", " ", 1)
    named = q.select("query_id", "q", F.explode(F.array_distinct("words")).alias("w")).join(dim.select("*", first.alias("w")), "w").filter(F.contains("q", F.concat(F.lit(" "), "name", F.lit(" ")))).select("query_id", F.lit(0).alias("tier"), (-F.length("name")).alias("o"), "slug")
    coded = q.select("query_id", F.posexplode("words").alias("o", "w")).join(dim, F.col("w") == F.col("shortcode")).select("query_id", F.lit(1).alias("tier"), F.col("o").cast("int"), "slug")
    first = rows.keep_first(named, ["query_id", "slug"], "tier", "o")
    few = q.select("query_id").join(first.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < least).select("query_id")
    both = rows.keep_first(first.unionByName(coded.join(few, "query_id", "left_semi")), ["query_id", "slug"], "tier", "o")
    return both.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("tier", "o", "slug"))), lambda x: x["slug"]).alias("slugs"))


def peer_rows(wanted: DataFrame, compared: DataFrame) -> DataFrame:
    """For each wanted slug its own page's row about itself, else the first that any page has: `compared` is (page, pos, peer, fields)."""
    hits = compared.join(wanted.select(F.col("slug").alias("peer")), "peer").withColumn("prio", F.when(F.col("page") == F.col("peer"), 0).otherwise(1))
    return rows.keep_first(hits, ["peer"], "prio", "page", "pos").select(F.col("peer").alias("slug"), "page", "fields")


def comparison(fields: DataFrame, peers: list[str], preferred: tuple[str, ...] = config.PREFERRED_KEYS) -> DataFrame:
    """One row a key with a column a peer, of (peer, pos, key, value): preferred keys first, then by first appearance; of a peer's repeated key the last value counts."""
    last = fields.groupBy("peer", "key").agg(F.max_by("value", "pos").alias("value"), F.min("pos").alias("pos"))
    wide = last.groupBy("key").pivot("peer", peers).agg(F.first("value"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("key")).cast("int"), F.lit(0)), F.lit(len(preferred) + 1))
    order = last.groupBy("key").agg(F.min("pos").alias("pos")).withColumn("tier", place)
    return wide.join(order, "key").withColumn("ordinal", F.expr("row_number() OVER (ORDER BY tier, pos, key)")).drop("tier", "pos")


def comparison_markdown(df: DataFrame, peers: list[str]) -> str:
    """The comparison as a table in markdown; it has a row a key, and keys are few."""
    lines = ["| | " + " | ".join(peers) + " |", "|" + "---|" * (len(peers) + 1)]
    return "\n".join(lines + ["| " + " | ".join([r["key"], *((r[p] or "—") for p in peers)]) + " |" for r in df.orderBy("ordinal").collect()])


def header_rows(cells: DataFrame, keys: list[str], most: int = 5000) -> DataFrame:
    """(keys, row, text) of sheets' rows (keys, row, cells): `header: value` lines of cells that say something under the sheet's first row; at most `most` rows a sheet, as the format has it."""
    head = rows.keep_first(cells, keys, "row").select(*keys, F.col("cells").alias("header"), F.col("row").alias("head"))
    df = cells.join(head, keys).filter((F.col("row") > F.col("head")) & (F.col("row") <= F.col("head") + most))
    line = lambda h, v: F.when(F.trim(F.coalesce(v, F.lit(""))) != "", F.concat(F.when(F.trim(F.coalesce(h, F.lit(""))) != "", F.concat(F.trim(h), F.lit(": "))).otherwise(""), F.trim(v)))
    said = F.array_compact(F.zip_with("header", "cells", line))
    return df.withColumn("text", F.array_join(said, "\n")).filter("text <> ''").select(*keys, "row", "text")


def reconciled(listed: DataFrame, fetched: DataFrame, key: str, by: str) -> DataFrame:
    """By `by`: listed, fetched, missing and unlisted of two tables with `key`, each key once."""
    a, b = listed.select(by, key).distinct(), fetched.select(key).distinct().withColumn("hit", F.lit(True))
    both = a.withColumn("named", F.lit(True)).join(b, key, "full_outer")
    return both.groupBy(F.coalesce(by, F.lit("?")).alias(by)).agg(F.count("named").alias("listed"), F.count("hit").alias("fetched"), F.count_if(F.col("hit").isNull()).alias("missing"), F.count_if(F.col("named").isNull()).alias("unlisted"))


def ordered_union(*parts: DataFrame, key: str, order: str = "pos") -> DataFrame:
    """Rows of the parts one after another, each key where it comes first, numbered."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (d.withColumn("src", F.lit(i)) for i, d in enumerate(parts)))
    return rows.ordinals(rows.keep_first(every, [key], "src", order), "ordinal", "src", order, key).drop("src")


def overlap_account(main: DataFrame, industry: DataFrame, api: DataFrame, key: str) -> DataFrame:
    """One row: sizes of three discoveries, repeats between the first two, and what is in one side of listing and API only."""
    m, i, a = (d.select(key).distinct() for d in (main, industry, api))
    both = m.unionByName(i).distinct()
    n = lambda d, name: d.agg(F.count("*").alias(name))
    parts = [n(m, "main"), n(i, "industry"), n(both, "union"), n(both.subtract(a), "unfetched"), n(a.subtract(both), "unlisted")]
    one = reduce(lambda x, y: x.crossJoin(F.broadcast(y)), parts)  # one row each
    return one.withColumn("repeats", F.greatest(F.lit(0), F.col("main") + F.col("industry") - F.col("union"))).withColumn("same", (F.col("unfetched") + F.col("unlisted")) == 0)


def missing_sections(found: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """(key, missing): expected section roots that a document lacks; `found` has (key, heading_path)."""
    have = found.groupBy(key).agg(F.collect_set(text.heading_root(F.col("heading_path"))).alias("have"))
    return have.select(key, F.array_except(F.array(*map(F.lit, expected)), "have").alias("missing"))


def pdf_audit(pages: DataFrame, poor: int = 100, fair: int = 400) -> DataFrame:
    """(file, pages, chars, per_page, status) of page texts (file, page, text): by how much text a page has."""
    df = pages.groupBy("file").agg(F.count("*").alias("pages"), F.sum(F.length(F.trim(F.coalesce("text", F.lit(""))))).alias("chars")).withColumn("per_page", F.round(F.col("chars") / F.col("pages"), 1))
    return df.withColumn("status", F.when(F.col("chars") == 0, "empty").when(F.col("per_page") < poor, "poor").when(F.col("per_page") < fair, "fair").otherwise("good"))


def counters(results: DataFrame) -> DataFrame:
    """One row of an ingest's counts by status and its chunks."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.agg(F.count("*").alias("seen"), *map(n, ("new", "changed", "skipped", "failed")), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))


def budgets(cost: DataFrame, budget: float) -> DataFrame:
    """Costs (user_id, month, cost) with what is left of a monthly budget and whether it is spent."""
    return cost.withColumn("left_over", F.round(F.lit(budget) - F.col("cost"), 8)).withColumn("over", F.col("cost") > budget)


def folder_totals(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(folder, files, by_extension) for every folder (folder), empty ones too, of files (folder, name)."""
    ext = F.lower(F.regexp_extract("name", r"\.([A-Za-z0-9]+)$", 1))
    n = files.groupBy("folder", F.when(ext == "", "none").otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))
    per = n.groupBy("folder").agg(F.sum("n").alias("files"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("ext", "n")))).alias("by_extension"))
    return folders.select("folder").distinct().join(per, "folder", "left").select("folder", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("by_extension", F.create_map().cast("map<string,bigint>")).alias("by_extension"))


def first_match(left: DataFrame, right: DataFrame, key: str, *order: str) -> DataFrame:
    """`left` with the first row of `right` that has its key, if any; `order` should tell rows of a key apart."""
    return left.join(rows.keep_first(right, [key], *order).drop(*order), key, "left")


def detail_url(slug: Column, addresses: Column) -> Column:
    """The first address that has the slug in it."""
    return F.get(F.filter(addresses, lambda u: F.contains(u, slug)), F.lit(0))


def limited(df: DataFrame, n: int) -> DataFrame:
    """The first n rows; all where n is 0 or less."""
    return df.limit(n) if n > 0 else df


def reading_order(words: DataFrame, key: str, line: int = 20) -> DataFrame:
    """(key, text): words (key, top, left, text) by lines of a page and from the left."""
    spot = F.struct(F.floor(F.col("top") / line).alias("line"), "left", "text")
    return words.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(spot)), lambda w: w["text"]), " ").alias("text"))
