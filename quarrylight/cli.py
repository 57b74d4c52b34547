"""The command line: ingest, retrieval, evaluation and reports over a store in a folder; results are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import config, jobs
from quarrylight.engine import HashedBag, QueryEngine, VectorStore
from quarrylight.functions import urls
from quarrylight.operators import crawl, evaluation, messages, payloads, reports, retrieval
from quarrylight.sources import api, files, sinks
from quarrylight.sources.tables import Table

#: Commands and what they do; all share the options of `parser`.
COMMANDS = {
    "crawl": "what is reached from --seed within --domains by --levels: over the web, which goes on where it stopped, or along the links of pages (url, html) if there is an --input",
    "website-crawl": "the same, with listings that lead nowhere",
    "ingest": "pages (url, html), of the --input or of the last crawl, into the store as blog",
    "index-posts": "the same, of those addresses alone that have no chunks yet",
    "website-ingest": "pages into the store as website",
    "extract": "sections of pages as JSON",
    "locations-ingest": "country payloads (key, payload)",
    "services-ingest": "service payloads",
    "fund-ingest": "setup product payloads",
    "announcement-content-ingest": "pages (url, html) of press releases and events; events to come are left out",
    "case-study-ingest": "case study payloads (key, payload)",
    "team-leadership-ingest": "curated records (kind bio, qa or press); refused without every --required name and --questions answers",
    "drive-list": "files (id, parent_id, name, mime) with paths",
    "drive-discover": "files by extension and folder",
    "drive-sync": "files that can be read, less --skip",
    "drive-ingest": "CSV and XLSX files of a folder",
    "drive-purge": "all chunks of the drive go",
    "build-pricing-index": "the lexical index of the store's pricing rows",
    "whatsapp-sync": "messages that count, of the --input or of an API's --url and --endpoint of each chat",
    "whatsapp-ingest": "messages by episodes",
    "api-scan": "records of a paged JSON API (--url with {page} or {offset}, --rows) with what they hold",
    "inspect": "what the store has, or what --question retrieves",
    "query": "the answer to --question",
    "eval-rag": "cases (case_id, query, refs, needles, must, forbid, tags) against the store",
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarrylight", description="\n".join(f"{k}: {v}" for k, v in COMMANDS.items()), formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("--input", help="a table (Parquet or JSON lines) or a folder of files")
    p.add_argument("--store", default="store", help="the store's folder; the state table lies beside it")
    p.add_argument("--output", help="where tables go; without it the first --limit rows are printed")
    p.add_argument("--question")
    p.add_argument("--source", default="all")
    p.add_argument("--page-kind", default="product_detail")
    p.add_argument("--seed", action="append", default=[])
    p.add_argument("--domains", action="append", default=[])
    p.add_argument("--skip", action="append", default=[])
    p.add_argument("--required", action="append", default=[])
    p.add_argument("--questions", type=int, default=0)
    p.add_argument("--path-filter")
    p.add_argument("--url", help="of an API, with {endpoint}, {page}, {offset}, {limit} in it")
    p.add_argument("--endpoint", action="append", default=[])
    p.add_argument("--rows", default="", help="where an API's answer has its rows")
    p.add_argument("--key", default="id")
    p.add_argument("--address", default=f"{config.SITE}/product-details/", help="what stands before an API record's slug in its address")
    p.add_argument("--levels", type=int, default=2)
    p.add_argument("--most-children", type=int, default=0, help="of a listing over all its pages, 0 for any number")
    p.add_argument("--delay", type=float, default=1.0, help="seconds between requests to a host")
    p.add_argument("--limit", type=int, default=0, help="rows of the input, 0 for all")
    p.add_argument("--tokenizer", help="a tokenizer's JSON whose tokens chunks are cut by; words where none is given")
    p.add_argument("--chunk-cap", type=int, default=0, help="chunks a file, 0 for all")
    p.add_argument("--min-score", type=float, default=None)
    p.add_argument("--force", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--dim", type=int, default=256)
    return p


def table(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    df = spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return reports.limited(df, limit)


#: What messages of an API have.
MESSAGE = "endpoint string, message_id string, body string, sent_at string, deleted boolean, from_me boolean"


def from_api(spark: SparkSession, a: argparse.Namespace, schema: str) -> DataFrame:
    """Records of the API that the options name."""
    said = {"url": a.url, "endpoints": json.dumps(a.endpoint or [""]), "rows": a.rows, "key": a.key}
    return reports.limited(api.registered(spark).read.format("json_api").schema(schema).options(**said).load(), a.limit)


def run(spark: SparkSession, argv: list[str]) -> dict | DataFrame:
    """What a command gives: counters or facts as a dictionary, or a table."""
    a = parser().parse_args(argv)
    embedder = HashedBag(a.dim)
    store = VectorStore(spark, f"{a.store}/chunks", a.dim)
    ingest = jobs.Ingest(spark, store, embedder, f"{a.store}/state", a.tokenizer)
    engine = QueryEngine(spark, store, embedder) if a.min_score is None else QueryEngine(spark, store, embedder, least=a.min_score)
    how = {"force": a.force, "dry_run": a.dry_run, "cap": a.chunk_cap}
    web = Table(spark, f"{a.store}/crawl", crawl.SEEN, key="url")

    def read() -> DataFrame:
        """The input, or what an API has, or the pages of the last crawl."""
        if a.input:
            return table(spark, a.input, a.limit)
        if a.url and a.command.startswith("whatsapp"):
            return from_api(spark, a, MESSAGE).withColumnRenamed("endpoint", "chat_id")
        if a.url:
            return from_api(spark, a, "slug string, payload string").select(F.concat(F.lit(a.address), "slug").alias("key"), "payload")
        return reports.limited(web.read().filter("html IS NOT NULL AND status BETWEEN 1 AND 399").select("url", "html"), a.limit)

    match a.command:
        case "crawl" | "website-crawl":
            if not a.input:
                if not a.seed:
                    raise ValueError("a crawl over the web needs a --seed")
                seeds = spark.createDataFrame([(u,) for u in a.seed], "url string")
                found = crawl.crawl_live(seeds, lambda asked: crawl.fetched(asked, a.delay), a.levels, a.most_children, a.domains or None, lambda d: d.filter(~urls.denied(F.col("target"), tuple(a.skip))), web).drop("html", "base")
                return found if a.command == "crawl" else crawl.empty_listings(found, found.filter("status BETWEEN 1 AND 399")).join(found, "url", "full_outer")
            site = read()
            seeds = site.select("url").filter(F.col("url").isin(*a.seed)) if a.seed else site.select("url")
            found = crawl.crawl(seeds, crawl.links(site, a.domains or None), a.levels)
            if a.command == "crawl":
                return found
            return crawl.empty_listings(found, site).join(found, "url", "full_outer")
        case "ingest":
            return ingest.pages(read(), "blog", **how)
        case "index-posts":
            known = store.table.read(["blog"]).select(F.col("source_url").alias("url")).distinct()
            return ingest.pages(read().join(known, "url", "left_anti"), "blog", **how)
        case "website-ingest":
            return ingest.pages(read(), "website", **how)
        case "announcement-content-ingest":
            return ingest.announcements(read(), **how)
        case "case-study-ingest":
            return ingest.case_studies(read(), **how)
        case "team-leadership-ingest":
            return ingest.leadership(read(), a.required, a.questions, **how)
        case "extract":
            from quarrylight.operators import pages, sections

            blocks = read().select("url", F.inline(pages.html_blocks("html")))
            return sections.sections(sections.clean_blocks(blocks, "url"), "url", F.col("url"))
        case "locations-ingest":
            return ingest.payloads(read(), payloads.country_sections, "country_overview", **how)
        case "services-ingest":
            return ingest.payloads(read(), payloads.service_sections, a.page_kind, **how)
        case "fund-ingest":
            return ingest.payloads(read(), payloads.product_sections, a.page_kind, **how)
        case "drive-list":
            nodes = read()
            return files.folder_paths(nodes, nodes.filter("parent_id IS NULL").select("id"))
        case "drive-discover":
            f = read()
            return reports.folder_totals(f.select("folder", "name"), f.select("folder"))
        case "drive-sync":
            return files.readable(read(), a.path_filter, a.skip)
        case "drive-ingest":
            return ingest.files(a.input, **how)
        case "drive-purge":
            ingest.purge("drive")
            return store.describe_stats()
        case "build-pricing-index":
            return sinks.lexical_index(retrieval.index_codes(store.rows()), a.output or f"{a.store}/pricing")
        case "whatsapp-sync":
            return messages.valid(read())
        case "whatsapp-ingest":
            return ingest.chats(read(), **how)
        case "api-scan":
            return from_api(spark, a, "endpoint string, payload string")
        case "inspect":
            return {"retrieved": engine.inspect_retrieve(a.question, a.source)} if a.question else engine.inspect(ingest.state.read())
        case "query":
            return engine.ask(a.question, a.source)
        case _:  # eval-rag
            cases = read()
            scored = evaluation.run(cases, lambda q: retrieved(engine, q), lambda q, _: answered(engine, q))
            return evaluation.means(scored, ["hit", "recall", "included", "forbidden_ok"])


def _questions(cases: DataFrame) -> DataFrame:
    return cases.select(F.col("case_id").alias("query_id"), F.col("query").alias("question"), F.lit("all").alias("source"), F.lit("").alias("prior"))


def retrieved(engine: QueryEngine, cases: DataFrame) -> DataFrame:
    """(case_id, rank, url, text) of cases (case_id, query)."""
    return engine.retrieve(_questions(cases)).select(F.col("query_id").alias("case_id"), F.col("position").alias("rank"), F.col("source_url").alias("url"), F.col("chunk_text").alias("text"))


def answered(engine: QueryEngine, cases: DataFrame) -> DataFrame:
    return engine.answers(_questions(cases)).select(F.col("query_id").alias("case_id"), "answer")


def main(argv: list[str] | None = None) -> int:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    argv = sys.argv[1:] if argv is None else argv
    got, a = run(spark, argv), parser().parse_args(argv)
    if isinstance(got, dict):
        print(json.dumps(got, default=str))
    elif a.output:
        got.write.mode("overwrite").json(a.output)
    else:
        for row in got.limit(a.limit or 20).collect():
            print(json.dumps(row.asDict(True), default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
