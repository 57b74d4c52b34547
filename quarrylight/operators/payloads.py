"""Sections of documents that come as JSON: country pages, services, setup products, case studies, announcements, curated records.

Every function takes rows (key, payload) with the payload as JSON text and gives
(key, ordinal, path, heading, text); ordinals keep the order of kinds and, within a
kind, of items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import rows
from quarrylight.operators.sections import paragraphs

COUNTRY = "title string, subHeader string, overviewDetail string, country struct<name:string,slug:string>, marketInsights array<struct<title:string,text:string>>, keySellingPoints array<struct<value:string>>, processStep array<struct<question:string,answer:string>>, FAQs array<struct<question:string,answer:string>>, funds array<struct<id:long,title:string,slug:string,startingPrice:double,currency:string,authorityName:string>>, productPages array<struct<id:long,productName:string,slug:string,startingPrice:double,authority_name:string>>, compare array<struct<countryName:string,slug:string,comparison:array<struct<key:string,value:string>>>>"
ITEM = "array<struct<heading:string,question:string,title:string,termAndCondition:string,name:string,description:string,answer:string,text:string,value:string>>"
SERVICE = f"title string, slug string, type string, description string, shortDescription string, documentsRequired {ITEM}, highlightsAndBenifits {ITEM}, processFlow {ITEM}, faqs {ITEM}, termsAndConditions {ITEM}, documentsFromAuthority {ITEM}, moreAboutRequiredDocuments {ITEM}, price string, currency string, estimatedDeliveryTime string"
PRODUCT = f"productName string, title string, description string, faqs {ITEM}, startingPrice string, currency string"
MIN_CHARS = 12


def said(c: Column) -> Column:
    return text.cleaned(F.coalesce(c, F.lit("")))


def first_said(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(said(c), F.lit("")) for c in columns), F.lit(""))


def named(items: Column) -> Column:
    """array<struct<name, body>> of items under any of the names that lists use; what says nothing goes."""
    both = lambda x: F.struct(first_said(x["heading"], x["question"], x["title"], x["termAndCondition"], x["name"]).alias("name"), first_said(x["description"], x["answer"], x["termAndCondition"], x["text"], x["value"]).alias("body"))
    full = F.filter(F.transform(F.coalesce(items, F.array().cast(ITEM)), both), lambda x: (x["name"] != "") | (x["body"] != ""))
    return F.transform(full, lambda x: F.struct(F.when(x["name"] == "", F.substring(x["body"], 1, 80)).otherwise(x["name"]).alias("name"), F.when(x["body"] == "", x["name"]).otherwise(x["body"]).alias("body")))


def listed(items: Column) -> Column:
    """Numbered lines of named items; a body that says the same as its name is left out."""
    more = lambda x: F.when((x["body"] != x["name"]) & ~F.contains(x["name"], x["body"]), F.concat(F.lit(": "), x["body"])).otherwise("")
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"], more(x))), "\n")


SECTION = "array<struct<kind:int,item:int,path:array<string>,heading:string,text:string>>"


def _section(kind: int, item: Column, path: list[Column], heading: Column, body: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), item.cast("int").alias("item"), F.array(*path).alias("path"), heading.alias("heading"), body.alias("text"))


def _one(kind: int, path: str, heading: Column, body: Column) -> Column:
    return F.array(_section(kind, F.lit(0), [F.lit(path)], heading, body)).cast(SECTION)


def _each(kind: int, path: str, items: Column, heading, body) -> Column:
    return F.coalesce(F.transform(items, lambda x, i: _section(kind, i, [F.lit(path), heading(x)], heading(x), body(x))).cast(SECTION), F.array().cast(SECTION))


def _numbered(found: DataFrame, least: int = MIN_CHARS) -> DataFrame:
    """Sections (key, kind, item, path, heading, text) that are long enough, numbered in order."""
    return rows.numbered(found.filter(F.length("text") >= least), "ordinal", ["key"], "kind", "item", "heading").select("key", "ordinal", F.array_join("path", " > ").alias("path"), "heading", "text")


def _together(df: DataFrame, parts: list[Column]) -> DataFrame:
    """Sections of all kinds: a payload is read once and gives one list of them."""
    return _numbered(df.select("key", F.inline(F.flatten(F.array(*parts)))))


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    """(key, p) with the payload's fields, those under `attributes` first; payloads that are no JSON have none."""
    inner = F.coalesce(F.get_json_object("payload", "$.attributes"), F.col("payload"))
    return payloads.select("key", F.from_json(inner, schema).alias("p")).filter("p IS NOT NULL")


def amount(price: Column) -> Column:
    return F.format_number(F.coalesce(price, F.lit(0.0)).cast("long"), 0)


def page_link(folder: str, country: Column, slug: Column, id_: Column) -> Column:
    where = F.coalesce(F.nullif(text.slug(country), F.lit("")), F.lit("unknown"))
    return F.when((said(slug) != "") & id_.isNotNull(), F.concat(F.lit(f"\nDetails: /product-details/{folder}/"), where, F.lit("/"), slug, F.lit("/"), id_.cast("string"))).otherwise("")


def country_sections(payloads: DataFrame) -> DataFrame:
    """Insights, selling points, overview, process, FAQ, funds, packages and comparison of country pages."""
    df = parsed(payloads, COUNTRY).select("key", "p.*")
    c = F.col
    both = lambda items: F.filter(F.transform(items, lambda x: F.struct(said(x["question"]).alias("name"), said(x["answer"]).alias("body"))), lambda x: (x["name"] != "") & (x["body"] != ""))
    step = F.coalesce(both("processStep"), F.array().cast("array<struct<name:string,body:string>>"))
    said_of = lambda items: F.filter(F.transform(items, lambda x: F.struct(said(x["key"]).alias("k"), said(x["value"]).alias("v"))), lambda x: (x["k"] != "") & (x["v"] != ""))
    peers = F.transform("compare", lambda x, n: F.struct(n.alias("n"), first_said(x["countryName"], x["slug"]).alias("name"), said_of(x["comparison"]).alias("rows")))
    df = df.withColumn("peers", F.coalesce(F.filter(peers, lambda x: (x["name"] != "") & (F.size(x["rows"]) > 0)), F.array().cast("array<struct<n:int,name:string,rows:array<struct<k:string,v:string>>>>")))
    line = lambda peer, x: F.concat(peer["name"], F.lit(" — "), x["k"], F.lit(": "), x["v"])
    tables = F.transform("peers", lambda peer: F.array_join(F.transform(peer["rows"], lambda x: line(peer, x)), "\n"))
    whole = F.concat(F.lit("Country comparison for "), said(c("title")), F.lit("."), F.lit("\n"), F.array_join(tables, "\n"))
    one_peer = lambda peer: F.concat(F.lit("Comparison peer: "), peer["name"], F.lit("\n"), F.array_join(F.transform(peer["rows"], lambda x: F.concat(x["k"], F.lit(": "), x["v"])), "\n"))
    fields = lambda peer: F.transform(peer["rows"], lambda x, m: _section(10, peer["n"] * 1000 + m, [F.lit("compare"), peer["name"], x["k"]], F.concat(peer["name"], F.lit(" "), x["k"]), line(peer, x)))
    where = lambda x, field: first_said(x[field], F.lit(""))
    none = F.array().cast(SECTION)
    return _together(df, [
        _each(0, "market_insights", c("marketInsights"), lambda x: first_said(x["title"], F.lit("Market insight")), lambda x: said(x["text"])),
        _each(1, "selling_points", c("keySellingPoints"), lambda x: F.substring(said(x["value"]), 1, 80), lambda x: said(x["value"])),
        _one(2, "overview", F.lit("Country Overview"), F.array_join(F.filter(F.array(said(c("subHeader")), said(c("overviewDetail"))), lambda x: x != ""), "\n\n")),
        _one(3, "process_flow", F.lit("Application process"), F.array_join(F.transform(step, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"], F.lit(": "), x["body"])), "\n")),
        _each(4, "process_flow", step, lambda x: x["name"], lambda x: F.concat(x["name"], F.lit("\n"), x["body"])),
        _each(5, "faq", both("FAQs"), lambda x: x["name"], lambda x: F.concat(F.lit("Q: "), x["name"], F.lit("\nA: "), x["body"])),
        _each(6, "top_funds", F.filter("funds", lambda x: said(x["title"]) != ""), lambda x: said(x["title"]), lambda x: F.concat(F.lit("Fund: "), said(x["title"]), F.lit("\nStarting from: "), said(x["currency"]), F.lit(" "), amount(x["startingPrice"]), F.lit("\nCountry: "), where(x, "authorityName"), F.lit("\nSlug: "), said(x["slug"]), page_link("funds", where(x, "authorityName"), x["slug"], x["id"]))),
        _each(7, "top_packages", F.filter("productPages", lambda x: said(x["productName"]) != ""), lambda x: said(x["productName"]), lambda x: F.concat(F.lit("Package: "), said(x["productName"]), F.lit("\nStarting from: "), amount(x["startingPrice"]), F.lit("\nCountry: "), where(x, "authority_name"), F.lit("\nSlug: "), said(x["slug"]), page_link("business-setup", where(x, "authority_name"), x["slug"], x["id"]))),
        F.when(F.size("peers") > 0, _one(8, "compare", F.lit("Comparison"), whole)).otherwise(none),
        F.transform("peers", lambda peer: _section(9, peer["n"], [F.lit("compare"), peer["name"]], peer["name"], one_peer(peer))).cast(SECTION),
        F.flatten(F.transform("peers", fields)).cast(SECTION),
    ])


def priced_lines(first: str, title: Column, price: Column, currency: Column, *more: Column) -> Column:
    shown = F.when(~F.coalesce(F.trim(price), F.lit("")).isin("", "0", "0.0"), F.concat(F.lit("Starting from: "), F.trim(F.concat(said(currency), F.lit(" "), F.trim(price)))))
    lines = F.array_compact(F.array(F.concat(F.lit(f"{first}: "), title), *more, shown))
    return F.when(F.size(lines) > 1, F.array_join(lines, "\n")).otherwise("")


def service_sections(payloads: DataFrame) -> DataFrame:
    """Introduction, documents, highlights, process, FAQ, terms and price of services."""
    df = parsed(payloads, SERVICE).select("key", "p.*")
    c = F.col
    title = first_said(c("title"), c("slug"), F.lit("Service"))
    faq = lambda x: F.concat(F.lit("Q: "), x["name"], F.lit("\nA: "), x["body"])
    parts = [
        _one(0, "introduction", F.lit("Introduction"), first_said(c("description"), c("shortDescription"))),
        _one(1, "documents_required", F.lit("Documents Required"), listed(named(c("documentsRequired")))),
        _one(2, "highlights_and_benefits", F.lit("Highlights & Benefits"), F.array_join(F.transform(named(c("highlightsAndBenifits")), lambda x: F.when(F.contains(x["body"], x["name"]), x["body"]).otherwise(F.concat(x["name"], F.lit("\n"), x["body"]))), "\n\n")),
        _one(3, "process_flow", F.lit("Process Flow"), F.array_join(F.transform(named(c("processFlow")), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["name"], F.lit(": "), x["body"])), "\n")),
        _each(4, "faqs", named(c("faqs")), lambda x: x["name"], faq),
        _one(5, "terms_and_conditions", F.lit("Terms & Conditions"), F.array_join(F.transform(named(c("termsAndConditions")), lambda x: x["body"]), "\n\n")),
        _each(6, "documents_from_authority", named(c("documentsFromAuthority")), lambda x: x["name"], lambda x: x["body"]),
        _one(7, "more_about_required_documents", F.lit("More about required documents"), listed(named(c("moreAboutRequiredDocuments")))),
        _one(8, "pricing", F.lit("Pricing"), priced_lines("Service", title, c("price"), c("currency"), F.when(said(c("type")) != "", F.concat(F.lit("Type: "), said(c("type")))), F.when(said(c("estimatedDeliveryTime")) != "", F.concat(F.lit("Estimated delivery: "), said(c("estimatedDeliveryTime")))))),
    ]
    return _together(df, parts)


def product_sections(payloads: DataFrame) -> DataFrame:
    """Introduction, FAQ and price of setup products."""
    df = parsed(payloads, PRODUCT).select("key", "p.*")
    c = F.col
    title = first_said(c("productName"), c("title"), F.lit("Package"))
    return _together(df, [
        _one(0, "introduction", F.lit("Introduction"), said(c("description"))),
        _each(1, "faq", named(c("faqs")), lambda x: x["name"], lambda x: F.concat(F.lit("Q: "), x["name"], F.lit("\nA: "), x["body"])),
        _one(2, "pricing", F.lit("Pricing"), priced_lines("Package", title, c("startingPrice"), c("currency"))),
    ])


def case_study_sections(blocks: DataFrame, least: int = 2) -> DataFrame:
    """Sections of case studies (key, pos, kind heading or text, text): by headings where there are `least` or more, else paragraphs two by two."""
    heads = blocks.groupBy("key").agg(F.count_if(F.col("kind") == "heading").alias("heads"))
    df = blocks.join(heads, "key")
    w = "PARTITION BY key ORDER BY pos ROWS UNBOUNDED PRECEDING"
    by_head = df.filter(F.col("heads") >= least).withColumn("g", F.expr(f"count_if(kind = 'heading') OVER ({w})"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "heading", F.struct("pos", "text")))), lambda x: x["text"]), "\n")
    first = by_head.groupBy("key", "g").agg(F.max(F.when(F.col("kind") == "heading", F.col("text"))).alias("heading"), parts.alias("text")).select("key", F.lit(0).alias("kind"), F.col("g").cast("int").alias("item"), F.array(F.coalesce("heading", F.lit("Introduction"))).alias("path"), F.coalesce("heading", F.lit("Introduction")).alias("heading"), "text")
    whole = df.filter((F.col("heads") < least) & (F.col("kind") != "heading")).groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n").alias("t"))
    second = whole.select("key", F.posexplode(paragraphs(F.col("t"))).alias("item", "text")).select("key", F.lit(1).alias("kind"), "item", F.array(F.concat(F.lit("Part "), (F.col("item") + 1).cast("string"))).alias("path"), F.concat(F.lit("Part "), (F.col("item") + 1).cast("string")).alias("heading"), "text")
    return _numbered(first.unionByName(second), 1)


def records(bios: DataFrame, answers: DataFrame, press: DataFrame, required: list[str], questions: int) -> DataFrame:
    """Chunks (kind, name, text) of curated records; an error where a required name is missing or the number of answers is another."""
    made = bios.select(F.lit("bio").alias("kind"), "name", F.concat("name", F.lit("\n"), "role", F.lit("\n"), "bio").alias("text"))
    made = made.unionByName(answers.select(F.lit("qa").alias("kind"), F.col("question").alias("name"), F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("text")))
    made = made.unionByName(press.select(F.lit("press").alias("kind"), F.col("title").alias("name"), F.concat("title", F.lit("\n"), "summary").alias("text")))
    missing = set(required) - {r.name for r in made.filter((F.col("kind") == "bio") & F.col("name").isin(*required)).select("name").distinct().collect()}  # of the names asked for
    n = answers.count()
    if missing or n != questions:
        raise ValueError(f"missing {sorted(missing)}, {n} answers of {questions}")
    return made


def listing_card(row: Column) -> Column:
    """struct<name, slug, price, tags> of a listing's row; the first of the names that lists use."""
    return F.struct(first_said(row["productName"], row["title"], row["name"], row["slug"]).alias("name"), said(row["slug"]).alias("slug"), text.priced(row["price"], row["currency"]).alias("price"), text.rank_tags(row["rank"]).alias("tags"))


def package_record(payloads: DataFrame, wanted: list[str]) -> DataFrame:
    """(key, sections_present, missing): which sections a service's payload has, and which of `wanted` it lacks."""
    roots = service_sections(payloads).groupBy("key").agg(F.array_sort(F.collect_set(F.substring_index("path", " > ", 1))).alias("present"))
    every = payloads.select("key").distinct().join(roots, "key", "left").withColumn("present", F.coalesce("present", F.array().cast("array<string>")))
    return every.select("key", F.col("present").alias("sections_present"), F.array_except(F.array(*map(F.lit, wanted)), F.col("present")).alias("missing"))
