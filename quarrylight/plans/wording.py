"""Functions on texts and addresses, one by one, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight import config as c
from quarrylight.functions import predicates, text, urls
from quarrylight.operators import reports, retrieval
from quarrylight.plans import Slate, read
from quarrylight.plans.focus import MADE, TITLE, case, chunks_of, codes, has, nearest_of, questions_of

slate = Slate()


@slate(MADE + f"""d AS (SELECT doc_id, doc_title, heading_path, chunk_text FROM chunks)
    SELECT doc_id, lower(trim(split_part(heading_path, '>', 1))) AS root, len(regexp_extract_all(heading_path, '>'))::INT AS depth, {TITLE} AS title, array_to_string({codes("doc_title || ' ' || chunk_text")}, ',') AS codes,
        trim(regexp_replace(lower(chunk_text), '[^a-z0-9%]+', ' ', 'g')) AS matchable, replace(replace(replace(replace(replace(chunk_text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped,
        length(trim(chunk_text)) < 20 OR {has('trim(chunk_text)', c.NOISE_TEXT)} AS noise, {has('heading_path', c.BREADCRUMB_HEADING)} AS crumb FROM d""")
def chunk_wording(spark, sf_dir):
    """Roots, depths, titles, codes and forms for matching of chunks."""
    t = F.col("chunk_text")
    return chunks_of(spark, sf_dir).select(
        "doc_id", text.heading_root(F.col("heading_path")).alias("root"), text.heading_depth(F.col("heading_path")).alias("depth"), text.row_title(t).alias("title"), F.array_join(text.service_codes(F.concat("doc_title", F.lit(" "), "chunk_text")), ",").alias("codes"),
        text.matchable(t).alias("matchable"), text.escaped(t).alias("escaped"), predicates.noise_text(t).alias("noise"), predicates.noise_heading(F.col("heading_path")).alias("crumb"),
    )


@slate("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 1 END AS members, '1. ' || event_type || chr(10) || '2. Untitled: note' AS list, CASE WHEN event_id % 2 = 0 THEN 'Best Seller' ELSE '' END AS tags,
    'USD ' || CASE WHEN event_id % 4 = 0 THEN event_id::VARCHAR ELSE event_id::VARCHAR || '.50' END AS price, event_id::VARCHAR || '. left' || CASE WHEN event_id % 2 = 0 THEN ': ' || event_type ELSE '' END AS fact, '| a\\|b | ' || event_type || ' |' AS cells FROM events""")
def record_wording(spark, sf_dir):
    """Counts of members, lists, tags, prices, facts and rows of tables."""
    i = F.col("event_id")
    said = F.expr(case("event_id % 5", ["""'{"member_count": 7}'""", """'{"members": ["a", "b"]}'""", """'{"participants": [1, 2, 3]}'""", """'{"members": {"x": 1}}'""", "'{}'"]))
    items = F.array(F.struct(F.lit("").alias("title"), F.col("event_type").alias("name"), F.lit(None).cast("string").alias("note")), F.struct(F.lit(" ").alias("title"), F.lit(None).cast("string").alias("name"), F.lit(" note ").alias("note")))
    amount = F.when(i % 4 == 0, i.cast("string")).otherwise(F.concat(i.cast("string"), F.lit(".5")))
    return read(spark, sf_dir, "events").select(
        "event_id", text.member_count(said).alias("members"), text.numbered_list(items).alias("list"), F.array_join(text.rank_tags(F.when(i % 2 == 0, 1).otherwise(0)), ",").alias("tags"), text.priced(amount, F.lit(" usd")).alias("price"),
        text.fact_line(i, F.lit("left"), F.when(i % 2 == 0, F.col("event_type"))).alias("fact"), text.table_row(F.lit("a|b"), F.col("event_type")).alias("cells"),
    )


@slate("""WITH q AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'Visa Services' WHEN 1 THEN 'Visa' WHEN 2 THEN 'Tax' END AS longest, CASE conv_id % 4 WHEN 0 THEN 'V' WHEN 1 THEN 'V' WHEN 2 THEN 'T' END AS first FROM q""")
def named_in_question(spark, sf_dir):
    """The longest known name of a question, and the first alias."""
    q = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    t = F.expr(case("conv_id % 4", ["'about visa services and tax'", "'a VISA or Tax'", "'tax only'", "'none'"]))
    return q.select("conv_id", reports.longest_name(t, ["Tax", "Visa", "Visa Services"]).alias("longest"), reports.first_name(t, [(r"(?i)\bvisa\b", "V"), (r"(?i)\btax\b", "T")]).alias("first"))


@slate("""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 3 THEN 'system' ELSE upper(role) || ' ' END AS role, CASE WHEN turn % 7 = 6 THEN ' ' ELSE text END AS content FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t)
    SELECT conv_id, turn, lower(trim(role)) AS role, left(trim(content), 50) AS content FROM r WHERE n <= 8 AND lower(trim(role)) IN ('user', 'assistant') AND trim(content) <> ''""")
def history_turns(spark, sf_dir):
    """The last eight turns, then those that count, cut to their first characters."""
    t = F.col("turn")
    said = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(t % 5 == 3, "system").otherwise(F.concat(F.upper("role"), F.lit(" "))).alias("role"), F.when(t % 7 == 6, " ").otherwise(F.col("text")).alias("content"))
    return retrieval.history(said, ["conv_id"], "turn", longest=50)


@slate(MADE + """s AS (SELECT query_id, rank::INT AS position, doc_title AS title, heading_path AS heading, left(chunk_text, 400) AS excerpt, CASE WHEN source_type = 'blog' THEN 'website' ELSE source_type END AS source_type,
        CASE WHEN contains(source_url, '/product-details/') THEN rtrim(source_url, '/') ELSE source_url END AS open_url FROM matches)
    SELECT *, true AS can_open, '' AS note FROM s""")
def source_cards(spark, sf_dir):
    """What an answer shows of its sources."""
    once, every = retrieval.asked_once(questions_of(spark, sf_dir), "question")
    chunks = chunks_of(spark, sf_dir).withColumn("chunk_text", F.substring("chunk_text", 1, 400))  # all that a card shows
    found = nearest_of(spark, sf_dir, once).join(chunks, "doc_id").withColumn("position", F.col("rank"))
    return retrieval.spread(retrieval.cards(retrieval.with_defaults(found)), every)


@slate(MADE + f"""d AS (SELECT doc_id, source_url, split_part(regexp_extract(source_url, '^https://[^/]*(/.*)$', 1), '/', 2) AS s FROM chunks)
    SELECT doc_id, CASE s WHEN 'hk' THEN 'Hong Kong' WHEN 'sg' THEN 'Singapore' WHEN 'hong-kong' THEN 'Hong Kong' END AS country, CASE doc_id % 4 WHEN 0 THEN 'https://www.example.com/product-details/x' WHEN 1 THEN 'https://www.example.com/country-overview/x' WHEN 2 THEN 'https://drive.google.com/file/d/x/view' ELSE 'https://www.example.com/x' END AS built FROM d""")
def page_addresses(spark, sf_dir):
    """Countries of addresses, and addresses of pages."""
    kind = F.expr(case("doc_id % 4", ["'product_detail'", "'country_overview'", "'file'", "'other'"]))
    return chunks_of(spark, sf_dir).select("doc_id", urls.country_of(F.col("source_url"), {"hk": "Hong Kong", "sg": "Singapore", "hong-kong": "Hong Kong"}).alias("country"), urls.page_url(kind, F.lit("x")).alias("built"))


@slate("""WITH m AS (SELECT user_id, date_trunc('month', ts)::DATE AS month, round(sum(value) / 100, 8) AS cost FROM events GROUP BY ALL) SELECT user_id, month, round(5 - cost, 6) AS left_over, cost > 5 AS over FROM m""")
def usage_budget(spark, sf_dir):
    """What is left of a monthly budget."""
    cost = read(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.round(F.sum("value") / 100, 8).alias("cost"))
    return reports.budgets(cost, 5.0).select("user_id", "month", F.round("left_over", 6).alias("left_over"), "over")


def answer_events(spark, sf_dir):
    """Answers as ordered events; tested for their order."""
    a = read(spark, sf_dir, "conversations").filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.coalesce("text", F.lit("")).alias("answer"), F.array(F.col("conv_id").cast("string")).alias("sources"), F.when(F.col("turn") % 4 == 1, F.array(F.lit("What else?"))).otherwise(F.array().cast("array<string>")).alias("related"))
    return retrieval.events(a)


QUERIES, ORACLES = slate.queries | {"answer_events": answer_events}, slate.oracles
