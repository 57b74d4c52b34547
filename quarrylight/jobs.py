"""Ingest jobs: scan, extract, hash, skip what is known, chunk, embed, replace by address; one DataFrame plan each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.engine import CHUNKS, Embedder, VectorStore
from quarrylight.functions import text, urls
from quarrylight.operators import announcements, messages, pages, payloads, reports, rows, sections, tree
from quarrylight.sources import files
from quarrylight.sources.tables import Table

STATE = "source_url string, content_sha1 string, status string, chunks long"
ARTIFACTS = "source_url string, source_type string, doc_title string, content_sha1 string, sections array<struct<ordinal:int,heading_path:string,text:string>>"


class Ingest:
    """A store with a state table and the documents' sections as artifacts: documents (source_url, source_type, page_kind, doc_title, service, and sections) become chunks.

    All three tables change in one commit.
    """

    def __init__(self, spark: SparkSession, store: VectorStore, embedder: Embedder, state_path: str, tokenizer: str | None = None):
        self.spark, self.store, self.embedder, self.tokenizer = spark, store, embedder, tokenizer
        ledger = store.table.ledger
        self.state = Table(spark, state_path, STATE, key="source_url", ledger=ledger, name="state")
        self.artifacts = Table(spark, f"{state_path}_artifacts", ARTIFACTS, key="source_url", part="source_type", ledger=ledger, name="artifacts")

    def documents(self, found: DataFrame, source_type: str, force: bool = False, dry_run: bool = False, cap: int = 0) -> dict:
        """Sections (source_url, doc_title, page_kind, service, ordinal, section_id, heading_path, text) of documents into the store; counters.

        A document's hash is that of its sections; one that is known is skipped unless forced, a
        changed one replaces all its chunks, so that none stays of what has gone.
        """
        plain = lambda c: text.cleaned(text.compatible(F.coalesce(F.col(c), F.lit("")))).alias(c)
        found = rows.stored(found.select(*(plain(c) if c in ("text", "heading_path", "doc_title") else c for c in found.columns)))
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "\n")
        docs = found.groupBy("source_url").agg(F.sha1(parts).alias("content_sha1"))
        known = self.state.read().select("source_url", F.col("content_sha1").alias("old"))
        both = docs.join(known, "source_url", "left")
        status = F.when(F.col("old").isNull(), "new").when((F.col("old") != F.col("content_sha1")) | F.lit(force), "changed").otherwise("skipped")
        judged = both.select("source_url", F.col("content_sha1").alias("doc_sha1"), status.alias("status"))
        todo = found.join(judged.filter("status <> 'skipped'").select("source_url"), "source_url", "left_semi")
        made = sections.chunks(todo, F.col("source_url"), F.col("doc_title"), F.col("page_kind"), F.col("service"), cap=cap, tokenizer=self.tokenizer)
        made = rows.keep_first(made, ["chunk_id"], "source_url")
        counted = judged.join(made.groupBy("source_url").agg(F.count("*").alias("chunks")), "source_url", "left").select("source_url", F.col("doc_sha1").alias("content_sha1"), "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))
        counted = rows.stored(counted)
        if not dry_run:
            domain = F.regexp_replace(F.lower(urls.part(F.col("source_url"), 2)), r"^www\.", "")
            full = self.embedder.embed_texts(made.withColumn("source_type", F.lit(source_type)).withColumn("source_domain", domain), "embed_text")
            full = rows.stored(full.select(*(x.split()[0] for x in CHUNKS.split(", "))))
            changed = counted.filter("status = 'changed'").select("source_url")
            kept = counted.filter("status <> 'skipped'")
            section = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "heading_path", "text")
            documents = found.join(kept.select("source_url", "content_sha1"), "source_url").groupBy("source_url").agg(F.first("doc_title").alias("doc_title"), F.first("content_sha1").alias("content_sha1"), F.array_sort(F.collect_list(section)).alias("sections")).withColumn("source_type", F.lit(source_type))
            with self.store.table.ledger.transaction():
                if changed.head(1):
                    stale = self.store.table.read().join(changed, "source_url", "left_semi").join(full.select("chunk_id"), "chunk_id", "left_anti")
                    self.store.table.delete_ids(stale.select("chunk_id"))
                self.store.upsert_chunks(full)
                self.artifacts.upsert(documents)
                self.state.upsert(kept)
        return reports.counters(counted).first().asDict()

    def pages(self, found: DataFrame, source_type: str = "website", **options) -> dict:
        """Pages (url, html) by their blocks; hubs and listings are not kept."""
        url = urls.canonicalised(F.col("url"))
        kept = found.select(url.alias("source_url"), "html").filter(~urls.skipped(F.col("source_url")))
        kept = rows.keep_first(kept, ["source_url"], "html")
        blocks = kept.select("source_url", F.inline(pages.html_blocks("html")))
        made = sections.sections(sections.clean_blocks(blocks, "source_url"), "source_url")
        # listings of services show what they offer as cards
        cards = tree.service_cards(kept.filter(urls.page_kind(F.col("source_url")) == "service_landing"), "source_url")
        heading = F.concat(F.lit("Catalog > "), "title")
        carded = cards.select("source_url", (F.col("ordinal") + 1_000_000).alias("ordinal"), F.concat(F.substring(F.sha1("source_url"), 1, 12), F.lit("_"), F.substring(F.sha1(heading), 1, 16)).alias("section_id"), heading.alias("heading_path"), "text")
        made = made.select("source_url", "ordinal", "section_id", "heading_path", "text").unionByName(carded)
        facts = kept.select("source_url", sections.page_title(F.col("html")).alias("doc_title"), urls.page_kind(F.col("source_url")).alias("page_kind"), sections.page_category(F.col("html"), F.col("source_url"))["name"].alias("service"))
        return self.documents(made.join(facts, "source_url"), source_type, **options)

    def payloads(self, found: DataFrame, read: Callable[[DataFrame], DataFrame] = payloads.service_sections, page_kind: str = "product_detail", **options) -> dict:
        """Payloads (key: address, payload) by a function of payloads."""
        made = read(found).select(F.col("key").alias("source_url"), "ordinal", F.concat(F.substring(F.sha1("key"), 1, 12), F.lit("_"), F.substring(F.sha1(F.concat_ws("|", "path", F.col("ordinal").cast("string"))), 1, 16)).alias("section_id"), F.col("path").alias("heading_path"), "text")
        inner = F.coalesce(F.get_json_object("payload", "$.attributes"), F.col("payload"))
        facts = found.select(F.col("key").alias("source_url"), F.coalesce(F.get_json_object(inner, "$.title"), F.get_json_object(inner, "$.productName")).alias("doc_title"), F.get_json_object(inner, "$.type").alias("service"), F.lit(page_kind).alias("page_kind"))
        return self.documents(made.join(facts, "source_url"), "website", **options)

    def announcements(self, found: DataFrame, **options) -> dict:
        """Press releases and events of pages (url, html), two paragraphs a section; the counters tell how many were left out and why."""
        told = rows.stored(announcements.details(found))
        facts = told.select("url", F.col("title").alias("doc_title"), F.col("kind").alias("page_kind"), F.element_at(F.create_map(*(F.lit(x) for kv in announcements.SECTION_NAMES.items() for x in kv)), F.col("kind")).alias("service"))
        made = announcements.parts(told).join(facts, "url").withColumnRenamed("url", "source_url")
        made = made.withColumn("section_id", F.concat(F.substring(F.sha1("source_url"), 1, 12), F.lit("_"), F.col("ordinal").cast("string")))
        left = {r.problem: r.n for r in told.filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n")).collect()}  # three kinds
        return self.documents(made, "website", **options) | {"left_out": left}

    def leadership(self, found: DataFrame, required: list[str], questions: int, **options) -> dict:
        """Curated records (kind bio, qa or press, with name, role, bio, question, answer, title, summary); an error where a required name is missing or the answers are another number."""
        by = lambda kind, *names: found.filter(F.col("kind") == kind).select(*(F.coalesce(F.col(n), F.lit("")).alias(n) for n in names))
        told = payloads.records(by("bio", "name", "role", "bio"), by("qa", "question", "answer"), by("press", "title", "summary"), required, questions)
        address = F.concat(F.lit(f"{config.SITE}/leadership/"), "kind", F.lit("/"), text.slug(F.col("name")))
        kept = rows.keep_first(told.withColumn("source_url", address), ["source_url"], "text")
        made = kept.select("source_url", F.col("name").alias("doc_title"), F.lit("leadership").alias("page_kind"), F.col("kind").alias("service"), F.lit(1).alias("ordinal"), F.sha1("source_url").alias("section_id"), F.col("kind").alias("heading_path"), "text")
        return self.documents(made, "website", **options)

    def case_studies(self, found: DataFrame, **options) -> dict:
        """Case studies (key: address, payload) whose description is rich text: by headings, or paragraphs two by two."""
        inner = F.coalesce(F.get_json_object("payload", "$.attributes"), F.col("payload"))
        node = F.from_json(F.get_json_object(inner, "$.description"), "array<string>")
        plain = text.cleaned(pages.rich_text(F.col("node")))
        blocks = found.select("key", F.posexplode(node).alias("pos", "node")).select("key", "pos", F.when(F.get_json_object("node", "$.type") == "heading", "heading").otherwise("text").alias("kind"), plain.alias("text")).filter("text <> ''")
        made = payloads.case_study_sections(blocks)
        facts = found.select("key", F.get_json_object(inner, "$.title").alias("doc_title"), F.lit("case_study").alias("page_kind"), F.coalesce(F.get_json_object(inner, "$.industry.name"), F.lit("Case Studies")).alias("service"))
        named = made.select("key", "ordinal", F.concat(F.substring(F.sha1("key"), 1, 12), F.lit("_"), F.col("ordinal").cast("string")).alias("section_id"), F.col("path").alias("heading_path"), "text").join(facts, "key").withColumnRenamed("key", "source_url")
        return self.documents(named, "website", **options)

    def chats(self, found: DataFrame, gap_minutes: int = 720, most: int = 40, least: int = 3, **options) -> dict:
        """Messages by episodes, with a summary that no model writes."""
        made = messages.dry_summary(messages.episodes(messages.valid(found), gap_minutes, most, least))
        body = messages.episode_text(F.col("chat_id"), F.col("started_at"), F.col("ended_at"), F.col("summary"), F.col("transcript"))
        rows_ = made.select(F.concat(F.lit("chat://"), "chat_id", F.lit("/"), "episode_id").alias("source_url"), F.col("chat_id").alias("doc_title"), F.lit("chat").alias("page_kind"), F.lit(None).cast("string").alias("service"), F.lit(1).alias("ordinal"), F.col("episode_id").alias("section_id"), F.lit("Episode").alias("heading_path"), body.alias("text"))
        return self.documents(rows_, "whatsapp", **options)

    def files(self, path: str, cap: int = 0, **options) -> dict:
        """CSV and XLSX files below a path, rows under their headers."""
        parts = [reports.header_rows(read(self.spark, f"{path}/*.{kind}"), ["path", "sheet"]) for kind, read in (("csv", files.csv_rows), ("xlsx", files.xlsx_rows)) if files.any_file(self.spark, f"{path}/*.{kind}")]
        if not parts:
            return {}
        found = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        name = F.regexp_extract("path", "([^/]*)$", 1)
        made = found.select(F.col("path").alias("source_url"), name.alias("doc_title"), F.lit("pricing").alias("page_kind"), F.lit(None).cast("string").alias("service"), F.col("row").alias("ordinal"), F.concat(F.substring(F.sha1(F.concat_ws("|", "path", "sheet")), 1, 12), F.lit("_"), F.col("row").cast("string")).alias("section_id"), F.coalesce(F.nullif(F.col("sheet"), F.lit("")), name).alias("heading_path"), "text")
        return self.documents(made, "drive", cap=cap, **options)

    def purge(self, source_type: str) -> None:
        """All chunks of a kind of source go, and what is known of their documents."""
        with self.store.table.ledger.transaction():
            self.state.delete_ids(self.store.table.read([source_type]).select("source_url"))
            self.store.table.purge(source_type)
            self.artifacts.purge(source_type)
