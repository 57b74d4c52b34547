"""Answers that catalogs give without retrieval: comparisons of countries, and counts of a country's or a service's offers, for a table of questions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import predicates as p
from quarrylight.functions import text
from quarrylight.operators import reports, rows

#: Bytes of names that one automaton holds; more names are looked for in several scans.
NAMES_BYTES = 16 << 20
SOURCE = "array<struct<position:int,chunk_id:string,source_url:string,source_type:string,page_kind:string,doc_title:string,heading_path:string,chunk_text:string,score:double>>"


@dataclass
class Catalogs:
    """What the site offers.

    countries: name, shortcode, slug, source_url, funds and packages (lists of name, price, currency).
    services: name, source_url, packages (a list of name).
    compared: page (a slug), pos, slug, name, shortcode of a country that the page compares, fields (a list of key, value).
    """

    countries: DataFrame
    services: DataFrame
    compared: DataFrame


def names_in(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, name) for every name (name) that a text (query_id, question) contains, whatever the case: one pass of an automaton of all names over each text, however many names there are."""
    names = names.select("name").filter("trim(name) <> ''").distinct()
    kind = dict(texts.dtypes)["query_id"]
    size = names.agg(F.coalesce(F.sum(F.octet_length("name") + 64), F.lit(0))).first()[0]
    groups = max(1, -(-size // NAMES_BYTES))
    found = None
    for g in range(groups):
        held = names.filter(F.pmod(F.xxhash64("name"), F.lit(groups)) == g).toArrow()["name"].to_pylist()
        part = texts.select("query_id", "question").mapInArrow(_found(texts.sparkSession.sparkContext.broadcast(held)), f"query_id {kind}, name string")
        found = part if found is None else found.unionByName(part)
    return found


def _found(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name in shipped.value:
            automaton.add_word(name.lower(), [*automaton.get(name.lower(), []), name])
        if len(automaton):
            automaton.make_automaton()
        for batch in batches:
            at, names = [], []
            for i, said in enumerate(batch.column(1).to_pylist() if len(automaton) else []):
                hits = {name for _, same in automaton.iter((said or "").lower()) for name in same}
                at += [i] * len(hits)
                names += sorted(hits)
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string())], ["query_id", "name"])

    return run


def matched(questions: DataFrame, names: DataFrame, aliases: tuple[tuple[str, str], ...], longest_alias: bool = False) -> DataFrame:
    """(query_id, name): the known name that a question means.

    The first alias pattern that hits and stands for a known name, or the one of
    the longest name if `longest_alias`; else the longest name that the question
    contains, of equally long ones the first by name.
    """
    hits = F.array_compact(F.array(*(F.when(F.col("question").rlike(pattern), F.struct(F.lit(i).alias("tier"), F.lit(name).alias("name"))) for i, (pattern, name) in enumerate(aliases))))
    aliased = questions.select("query_id", F.inline(hits)).join(names.select("name").distinct(), "name")
    if longest_alias:
        aliased = aliased.withColumn("tier", -F.length("name"))
    whole = names_in(questions, names).select("query_id", "name", (F.lit(len(aliases) + 1_000) - F.least(F.length("name"), F.lit(1_000))).alias("tier"))
    return rows.keep_first(aliased.select("query_id", "name", "tier").unionByName(whole), ["query_id"], "tier", "name").select("query_id", "name")


def wanted_countries(questions: DataFrame, countries: DataFrame) -> DataFrame:
    """(query_id, ord, slug) of the countries that questions name: by whole names, longest first; where these are fewer than two also by cues."""
    some = countries.filter("slug IS NOT NULL AND slug <> ''")
    named = names_in(questions, some).join(some.select("name", "slug"), "name").select("query_id", "slug", F.lit(0).alias("tier"), (-F.length("name")).alias("o"), "name")
    first = rows.keep_first(named, ["query_id", "slug"], "o", "name")
    cues = sorted(config.COUNTRY_CUES, key=lambda c: -max(map(len, c[1])))
    hits = F.array_compact(F.array(*(F.when(F.col("question").rlike(pattern), F.struct(F.lit(i).alias("o"), F.lit(code).alias("code"))) for i, (pattern, (code, *_)) in enumerate(cues))))
    cued = questions.select("query_id", F.inline(hits)).join(some.select(F.lower("shortcode").alias("code"), "slug"), "code").select("query_id", "slug", F.lit(1).alias("tier"), "o", F.col("code").alias("name"))
    enough = first.groupBy("query_id").agg(F.count("*").alias("n")).filter("n >= 2")
    both = first.unionByName(cued.join(enough, "query_id", "left_anti"))
    return rows.numbered(rows.keep_first(both, ["query_id", "slug"], "tier", "o", "name"), "ord", ["query_id"], "tier", "o", "name").select("query_id", "ord", "slug")


def plain_name(c: Column) -> Column:
    """A country's name or slug to be told from others: lower case, one space, islands as island."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[\s-]+", " ")), " islands", " island")


def resolved(compared: DataFrame, countries: DataFrame) -> DataFrame:
    """`compared` with the known slug of each compared country (`peer`): by its slug, else its shortcode, else its name; rows of none go."""
    known = countries.filter("slug IS NOT NULL AND slug <> ''")
    keys = known.select("slug", F.explode(F.array(F.struct(F.lit(0).alias("tier"), F.lower("slug").alias("key")), F.struct(F.lit(1).alias("tier"), F.lower("shortcode").alias("key")), F.struct(F.lit(2).alias("tier"), plain_name(F.col("slug")).alias("key")), F.struct(F.lit(2).alias("tier"), plain_name(F.col("name")).alias("key")))).alias("k"))
    keys = rows.keep_first(keys.select(F.col("slug").alias("peer"), "k.*").filter("key <> ''"), ["tier", "key"], "peer")
    numbered = compared.withColumn("row", F.struct("page", "pos"))
    tried = F.array(F.struct(F.lit(0).alias("tier"), F.lower("slug").alias("key")), F.struct(F.lit(1).alias("tier"), F.lower("shortcode").alias("key")), F.struct(F.lit(2).alias("tier"), plain_name(F.col("name")).alias("key")))
    found = numbered.select("row", F.inline(tried)).join(keys, ["tier", "key"])
    return numbered.join(rows.keep_first(found, ["row"], "tier").select("row", "peer"), "row").drop("row")


def escaped(c: Column) -> Column:
    """Text for HTML."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def in_turn(order: str, value: Column) -> Column:
    """An aggregate: the values as a list, by `order`."""
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def comparisons(questions: DataFrame, catalogs: Catalogs) -> DataFrame:
    """(query_id, answer, sources) of questions that compare two countries or more of which there are rows.

    A country's row is that of its own page, else the first that the pages of
    the other countries of the question have.  Preferred keys come first, then
    by first appearance; of a repeated key the last value counts.
    """
    asked = questions.filter(p.compare_question(F.col("question")))
    wanted = wanted_countries(asked, catalogs.countries)
    several = wanted.groupBy("query_id").agg(F.count("*").alias("n")).filter("n >= 2").select("query_id")
    wanted = rows.stored(wanted.join(several, "query_id"))
    compared = resolved(catalogs.compared, catalogs.countries)
    pages = wanted.select("query_id", F.col("ord").alias("page_ord"), F.lower("slug").alias("page_key"), F.col("slug").alias("own"))
    offered = pages.join(compared.withColumn("page_key", F.lower("page")), "page_key").withColumn("away", F.when(F.col("own") == F.col("peer"), 0).otherwise(1))
    hits = offered.drop("own").join(wanted.select("query_id", "ord", F.col("slug").alias("peer")), ["query_id", "peer"])
    one = rows.keep_first(hits, ["query_id", "peer"], "away", "page_ord", "pos")
    titled = one.withColumn("title", F.coalesce(F.nullif(text.cleaned(F.col("name")), F.lit("")), F.col("peer")))
    first = rows.keep_first(titled, ["query_id", "title"], "away", "ord")
    placed = rows.stored(rows.numbered(first, "place", ["query_id"], "away", "ord").join(catalogs.countries.select(F.col("slug").alias("peer"), "source_url"), "peer", "left"))
    heads = placed.groupBy("query_id").agg(in_turn("place", F.col("title")).alias("titles"), in_turn("place", F.struct("title", F.coalesce("source_url", F.lit("")).alias("url"))).alias("links")).filter(F.size("titles") >= 2)
    cells = placed.join(heads.select("query_id"), "query_id").select("query_id", "place", F.posexplode("fields").alias("at", "f")).select("query_id", "place", "at", text.cleaned(F.col("f.key")).alias("key"), text.cleaned(F.col("f.value")).alias("value")).filter("key <> '' AND value <> ''")
    last = cells.groupBy("query_id", "place", "key").agg(F.max_by("value", "at").alias("value"), F.min("at").alias("at"))
    preferred = F.array(*map(F.lit, config.PREFERRED_KEYS))
    tier = F.coalesce(F.nullif(F.array_position(preferred, F.col("key")).cast("int"), F.lit(0)), F.lit(len(config.PREFERRED_KEYS) + 1))
    by_key = last.groupBy("query_id", "key").agg(F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("values"), F.min(F.struct("place", "at")).alias("seen")).withColumn("order", F.struct(tier.alias("tier"), "seen", "key"))
    by_title = F.transform("titles", lambda _, i: F.try_element_at("values", i + 1))
    td = F.transform("values", lambda v: F.concat(F.lit("<td>"), escaped(F.coalesce(v, F.lit("—"))), F.lit("</td>")))
    lined = by_key.join(heads, "query_id").withColumn("values", by_title).withColumn("line", F.concat(F.lit('<tr><th scope="row">'), escaped(F.col("key")), F.lit("</th>"), F.array_join(td, ""), F.lit("</tr>")))
    body = lined.groupBy("query_id").agg(F.array_join(in_turn("order", F.col("line")), "\n").alias("body"), in_turn("order", F.struct("key", "values")).alias("keyed"))
    th = F.array_join(F.transform("titles", lambda t: F.concat(F.lit("<th>"), escaped(t), F.lit("</th>"))), "")
    said = F.concat(
        F.lit("<p>Comparison of <strong>"), escaped(F.array_join("titles", " vs ")), F.lit("</strong> from the country overview tables:</p>\n"),
        F.lit('<div class="compare-table-wrap">\n<table class="compare-table">\n<thead><tr><th>Criteria</th>'), th, F.lit("</tr></thead>\n<tbody>\n"), F.coalesce("body", F.lit("")), F.lit("\n</tbody>\n</table>\n</div>\n"),
    )
    linked = F.filter("links", lambda x: x["url"] != "")
    items = F.array_join(F.transform(linked, lambda x: F.concat(F.lit('<li><a href="'), escaped(x["url"]), F.lit('" target="_blank" rel="noopener noreferrer">'), escaped(x["title"]), F.lit("</a></li>"))), "\n")
    answer = F.concat(said, F.when(F.size(linked) > 0, F.concat(F.lit("<p><strong>Source pages:</strong></p>\n<ul>\n"), items, F.lit("\n</ul>"))).otherwise(""))

    def source(link: Column, i: Column) -> Column:
        lines = F.array_compact(F.transform("keyed", lambda k: F.concat(k["key"], F.lit(": "), k["values"][i])))
        return F.struct(
            (i + 1).alias("position"), F.concat(F.lit("compare-"), (i + 1).cast("string")).alias("chunk_id"), link["url"].alias("source_url"), F.lit("website").alias("source_type"), F.lit("country_overview").alias("page_kind"),
            link["title"].alias("doc_title"), F.concat(F.lit("compare > "), link["title"]).alias("heading_path"), F.array_join(F.concat(F.array(F.concat(F.lit("Comparison peer: "), link["title"])), F.coalesce(lines, F.array().cast("array<string>"))), "\n").alias("chunk_text"), F.round(F.lit(1.0) - (i + 1) * 0.01, 2).alias("score"),
        )

    whole = heads.join(body, "query_id", "left")
    return whole.select("query_id", answer.alias("answer"), F.transform("links", source).cast(SOURCE).alias("sources"))


def _one_source(chunk_id: Column, url: Column, kind: str, title: Column, heading: Column, body: Column) -> Column:
    one = F.struct(F.lit(1).alias("position"), chunk_id.alias("chunk_id"), url.alias("source_url"), F.lit("website").alias("source_type"), F.lit(kind).alias("page_kind"), title.alias("doc_title"), heading.alias("heading_path"), body.alias("chunk_text"), F.lit(1.0).alias("score"))
    return F.array(one).cast(SOURCE)


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def country_counts(questions: DataFrame, countries: DataFrame) -> DataFrame:
    """(query_id, answer, sources) of questions for how many funds or packages a named country has."""
    asked = questions.filter(p.location_count_question(F.col("question")))
    meant = matched(asked, countries, config.COUNTRY_ALIASES).join(asked.select("query_id", "question"), "query_id")
    known = meant.join(countries, "name").withColumnRenamed("name", "country")
    said = reports.country_answer(known, F.col("question"), "query_id", "source_url", "items")
    names = F.transform("items", lambda x: x["name"])
    title = F.concat("country", F.lit(" — "), F.col("kind"), F.lit(" catalog"))
    body = _lines(F.concat(F.lit("Country: "), "country"), F.concat("kind", F.lit(" count: "), F.col("n").cast("string")), *(F.nullif(F.array_join(names, "\n"), F.lit("")),))
    url = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.concat(F.lit("catalog://"), "country"))
    return said.select("query_id", "answer", _one_source(F.concat(F.lit("location-catalog|"), "country", F.lit("|"), "kind"), url, "country_overview", title, F.concat(F.lit("location_catalog > "), "kind"), body).alias("sources"))


def service_counts(questions: DataFrame, services: DataFrame) -> DataFrame:
    """(query_id, answer, sources) of questions for how many packages a named service has."""
    asked = questions.filter(p.service_count_question(F.col("question")))
    meant = matched(asked, services, config.SERVICE_ALIASES, longest_alias=True).join(asked.select("query_id", "question"), "query_id")
    counted = services.withColumn("packages", F.filter("packages", lambda x: F.trim(F.coalesce(x["name"], F.lit(""))) != "")).withColumn("n", F.size("packages"))
    known = meant.join(counted, "name").withColumnRenamed("name", "service")
    said = reports.service_answer(known, "service", F.col("question"), 40, 8, "query_id", "source_url", "packages")
    body = _lines(F.concat(F.lit("Service: "), "service"), F.concat(F.lit("Package count: "), F.col("n").cast("string")), F.lit("Packages:"), F.nullif(F.array_join(F.transform("packages", lambda x: x["name"]), "\n"), F.lit("")))
    url = F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.concat(F.lit("catalog://"), "service"))
    return said.select("query_id", "answer", _one_source(F.concat(F.lit("service-catalog|"), "service", F.lit("|count")), url, "service_landing", F.concat("service", F.lit(" — package catalog")), F.lit("service_catalog > package_count"), body).alias("sources"))


def answers(questions: DataFrame, catalogs: Catalogs) -> DataFrame:
    """(query_id, route, answer, sources) of the questions (query_id, question) that catalogs answer: a comparison before a country's count, that before a service's; other questions have no row."""
    # each is read several times; of a table in files Spark knows the size, and whether to broadcast it
    questions = rows.stored(questions.select("query_id", "question"))
    catalogs = Catalogs(rows.stored(catalogs.countries), rows.stored(catalogs.services), catalogs.compared)
    parts = (("compare", comparisons(questions, catalogs)), ("location_count", country_counts(questions, catalogs.countries)), ("service_count", service_counts(questions, catalogs.services)))
    every = None
    for i, (route, part) in enumerate(parts):
        part = part.select("query_id", F.lit(i).alias("tier"), F.lit(route).alias("route"), "answer", "sources")
        every = part if every is None else every.unionByName(part)
    return rows.keep_first(every, ["query_id"], "tier").drop("tier")
