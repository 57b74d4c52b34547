"""Messages, catalogs, comparisons and reports over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text, urls
from quarrylight.operators import messages, reports
from quarrylight.plans import Slate, read
from quarrylight.plans.focus import case

slate = Slate()

BODY = "CASE WHEN event_id % 17 = 0 THEN '  ' ELSE concat(event_type, '  of ', CAST(event_id AS STRING), ' .') END"
VALID = """WITH v AS (SELECT 'c' || user_id::VARCHAR AS chat_id, event_id AS message_id, event_type || ' of ' || event_id::VARCHAR || '.' AS body, date_trunc('second', ts) AS ts, event_id % 3 = 0 AS from_me FROM events WHERE event_id % 17 <> 0 AND event_id % 13 <> 0 AND event_id % 11 <> 0)"""


def chats_of(spark, sf_dir):
    """Events as messages, some deleted, blank or without a time."""
    i = F.col("event_id")
    sent = F.when(i % 13 == 0, "yesterday").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(i % 2 == 0, "Z").otherwise("")))
    return read(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("chat_id"), i.alias("message_id"), F.expr(BODY).alias("body"), sent.alias("sent_at"), F.when(i % 11 == 0, True).alias("deleted"), (i % 3 == 0).alias("from_me"))


@slate(VALID + " SELECT chat_id, message_id, body, epoch(ts)::BIGINT AS at FROM v")
def message_validity(spark, sf_dir):
    """Messages that count, with their time."""
    return messages.valid(chats_of(spark, sf_dir)).select("chat_id", "message_id", "body", F.unix_seconds("ts").alias("at"))


@slate(VALID + """, g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 86400000000)::INT, 0) AS fresh FROM v WINDOW w AS (PARTITION BY chat_id ORDER BY ts, message_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY chat_id ORDER BY ts, message_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
    p AS (SELECT *, (row_number() OVER (PARTITION BY chat_id, session ORDER BY ts, message_id) - 1) // 10 AS part FROM s)
    SELECT chat_id, sha1(chat_id || '|' || arg_min(message_id, (ts, message_id))::VARCHAR || '|' || arg_max(message_id, (ts, message_id))::VARCHAR) AS episode_id, count(*)::INT AS messages,
        sha1(string_agg(strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z|' || CASE WHEN from_me THEN 'True' ELSE 'False' END || '|' || body, chr(10) ORDER BY ts, message_id)) AS content_sha1,
        sha1('[' || string_agg(strftime(ts, '%Y-%m-%d %H:%M') || '] ' || CASE WHEN from_me THEN 'Us' ELSE 'Them' END || ': ' || body, chr(10) || '[' ORDER BY ts, message_id)) AS transcript_sha1
    FROM p GROUP BY chat_id, session, part HAVING count(*) >= 2""")
def chat_episodes(spark, sf_dir):
    """Episodes of chats with hash and transcript."""
    found = messages.episodes(messages.valid(chats_of(spark, sf_dir)), gap_minutes=1440, most=10, least=2)
    return found.select("chat_id", "episode_id", "messages", "content_sha1", F.sha1("transcript").alias("transcript_sha1"))


@slate("""SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'https://chat.whatsapp.com/AbCdEfGhIj' || c_custkey::VARCHAR WHEN c_custkey % 4 = 1 THEN 'https://chat.whatsapp.com/RegisteredCode' WHEN c_custkey % 4 = 2 THEN 'https://wa.me/' || (971500000000 + c_custkey)::VARCHAR END AS open_url FROM customer""")
def chat_invites(spark, sf_dir):
    """Where chats open: own invite, registered one, or phone."""
    k = F.col("c_custkey")
    chat = F.when(k % 4 == 2, F.concat((F.lit(971500000000) + k).cast("string"), F.lit("@c.us"))).otherwise(F.concat(k.cast("string"), F.lit("-1@g.us")))
    own = F.when(k % 4 == 0, F.concat(F.lit("https://chat.whatsapp.com/invite/AbCdEfGhIj"), k.cast("string"))).otherwise(" ")
    src = read(spark, sf_dir, "customer").select(k.alias("id"), chat.alias("chat_id"), own.alias("invite"))
    registry = src.filter("id % 4 = 1").select("chat_id", F.lit("https://chat.whatsapp.com/RegisteredCode").alias("invite"))
    return messages.invites(src, registry).select("id", "open_url")


@slate("""WITH p AS (SELECT p_type, p_partkey, p_name FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_type, count(*)::INT AS n, list(p_name ORDER BY p_partkey) AS l FROM p GROUP BY p_type)
    SELECT p_type, n, p_type || ' has ' || n::VARCHAR || ' packages: ' || CASE WHEN n <= 10 OR contains(p_type, 'ALL') THEN array_to_string(l, '; ') ELSE array_to_string(l[1:8], '; ') || ' and ' || (n - 8)::VARCHAR || ' more' END AS answer FROM n""")
def service_answers(spark, sf_dir):
    """Counts with names by service; nameless packages do not count."""
    listing = read(spark, sf_dir, "part").select("p_type", F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    question = F.when(F.contains("p_type", F.lit("ALL")), "list all packages").otherwise("how many packages")
    return reports.service_answer(reports.nested_catalog(listing, "p_type", "pos", ["name"]), "p_type", question, most=10)


@slate("""WITH f AS (SELECT s_nationkey AS k, list(s_name ORDER BY s_suppkey) AS l FROM supplier GROUP BY 1), p AS (SELECT c_nationkey AS k, list(c_name ORDER BY c_custkey) AS l FROM customer GROUP BY 1),
    n AS (SELECT n_name AS country, n_nationkey % 2 = 0 AS wants, coalesce(f.l, []) AS f, coalesce(p.l, []) AS p FROM nation LEFT JOIN f ON f.k = n_nationkey LEFT JOIN p ON p.k = n_nationkey),
    a AS (SELECT country, CASE WHEN wants THEN 'funds' WHEN len(p) > 0 THEN 'packages' ELSE 'funds' END AS kind, f, p FROM n), b AS (SELECT *, CASE WHEN kind = 'funds' THEN f ELSE p END AS l, CASE WHEN kind = 'funds' THEN ' (from USD 10)' ELSE ' (from AED 2.50)' END AS price FROM a)
    SELECT country, kind, len(l)::INT AS n, country || ' has ' || len(l)::VARCHAR || ' ' || kind || CASE WHEN len(l) = 0 THEN '.' ELSE ':' || chr(10) || array_to_string(list_transform(list_slice(l, 1, CASE WHEN len(l) <= 12 THEN 12 ELSE 8 END), lambda x, i: i::VARCHAR || '. ' || x || price), chr(10)) || CASE WHEN len(l) > 12 THEN chr(10) || 'and ' || (len(l) - 8)::VARCHAR || ' more' ELSE '' END END AS answer FROM b""")
def country_answers(spark, sf_dir):
    """Funds or packages of a country with prices."""
    listed = lambda t, k, o, name, price, cur: reports.in_order([k], read(spark, sf_dir, t), o, F.struct(F.col(name).alias("name"), F.lit(price).alias("price"), F.lit(cur).alias("currency")), "l")
    funds, packages = listed("supplier", "s_nationkey", "s_suppkey", "s_name", 10.0, "usd"), listed("customer", "c_nationkey", "c_custkey", "c_name", 2.5, "AED")
    none = F.array().cast("array<struct<name:string,price:double,currency:string>>")
    n = read(spark, sf_dir, "nation").join(funds.withColumnRenamed("l", "funds"), F.col("n_nationkey") == F.col("s_nationkey"), "left").join(packages.withColumnRenamed("l", "packages"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    catalog = n.select("n_nationkey", F.col("n_name").alias("country"), F.coalesce("funds", none).alias("funds"), F.coalesce("packages", none).alias("packages"))
    return reports.country_answer(catalog, F.when(F.col("n_nationkey") % 2 == 0, "how many funds").otherwise("how many packages"))


@slate("""WITH f AS (SELECT r_name AS peer, n_nationkey AS pos, ['VAT Rate', 'Banking', 'Other ' || (n_nationkey % 2)::VARCHAR][n_nationkey % 3 + 1] AS key, n_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey),
    l AS (SELECT peer, key, arg_max(value, pos) AS value, min(pos) AS pos FROM f GROUP BY peer, key), o AS (SELECT key, min(pos) AS pos, CASE key WHEN 'VAT Rate' THEN 4 WHEN 'Banking' THEN 10 ELSE 13 END AS tier FROM l GROUP BY key)
    SELECT o.key, max(value) FILTER (peer = 'ASIA') AS ASIA, max(value) FILTER (peer = 'EUROPE') AS EUROPE, (row_number() OVER (ORDER BY tier, o.pos, o.key))::INT AS ordinal FROM o JOIN l USING (key) GROUP BY o.key, tier, o.pos""")
def comparison_matrix(spark, sf_dir):
    """One row a key with a column a peer; preferred keys first."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    key = F.when(k % 3 == 0, "VAT Rate").when(k % 3 == 1, "Banking").otherwise(F.concat(F.lit("Other "), (k % 2).cast("string")))
    return reports.comparison(n.select(F.col("r_name").alias("peer"), k.alias("pos"), key.alias("key"), F.col("n_name").alias("value")), ["ASIA", "EUROPE"])


QUESTIONS = case("conv_id % 4", ["'compare Nation 1 and nation-12'", "'n3 vs n4'", "'nation 5'", "'n7 and the nation 8'"])


@slate("""SELECT conv_id AS query_id, CASE conv_id % 4 WHEN 0 THEN 'NATION_12,NATION_1' WHEN 1 THEN 'NATION_3,NATION_4' WHEN 2 THEN 'NATION_5' ELSE 'NATION_8,NATION_7' END AS slugs FROM (SELECT DISTINCT conv_id FROM conversations)""")
def country_slugs(spark, sf_dir):
    """Countries that a question names, by name and else by shortcode."""
    q = read(spark, sf_dir, "conversations").select("conv_id").distinct().select(F.col("conv_id").alias("query_id"), F.expr(QUESTIONS).alias("question"))
    dim = read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("shortcode"), F.col("n_name").alias("slug"))
    return reports.slugs_of(q, dim).select("query_id", F.array_join("slugs", ",").alias("slugs"))


@slate("""WITH c AS (SELECT n_regionkey AS page, n_nationkey AS pos, n_regionkey + n_nationkey % 2 AS peer, n_name AS fields FROM nation)
    SELECT peer AS slug, arg_min(page, (CASE WHEN page = peer THEN 0 ELSE 1 END, page, pos)) AS page, arg_min(fields, (CASE WHEN page = peer THEN 0 ELSE 1 END, page, pos)) AS fields FROM c WHERE peer < 5 GROUP BY peer""")
def peer_rows(spark, sf_dir):
    """A peer's row of its own page, else of any."""
    compared = read(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("page"), F.col("n_nationkey").alias("pos"), (F.col("n_regionkey") + F.col("n_nationkey") % 2).alias("peer"), F.col("n_name").alias("fields"))
    return reports.peer_rows(read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("slug")), compared)


@slate("""SELECT user_id % 5 AS sheet, event_id AS row, array_to_string(list_filter([CASE WHEN event_type <> 'view' THEN 'kind: ' || event_type END, event_id::VARCHAR], lambda x: x IS NOT NULL), chr(10)) AS text FROM events
    QUALIFY event_id > min(event_id) OVER (PARTITION BY user_id % 5) AND event_id <= min(event_id) OVER (PARTITION BY user_id % 5) + 5000""")
def header_rows(spark, sf_dir):
    """Rows of sheets as lines under their first row; five thousand a sheet, as the format has it."""
    sheet = F.col("user_id") % 5
    first = read(spark, sf_dir, "events").groupBy(sheet.alias("sheet")).agg(F.min("event_id").alias("row")).select("sheet", "row", F.array(F.lit(" kind "), F.lit("")).alias("cells"))
    e = read(spark, sf_dir, "events").select(sheet.alias("sheet"), F.col("event_id").alias("row"), F.array(F.when(F.col("event_type") == "view", " ").otherwise(F.col("event_type")), F.col("event_id").cast("string")).alias("cells"))
    rest = e.join(F.broadcast(first.select("sheet", F.col("row").alias("head"))), "sheet").filter("row <> head").select("sheet", "row", "cells")  # five rows
    return reports.header_rows(first.unionByName(rest), ["sheet"])


@slate("""WITH a AS (SELECT n_nationkey AS k, n_nationkey AS pos, 0 AS src FROM nation WHERE n_nationkey % 2 = 0), b AS (SELECT n_nationkey AS k, -n_nationkey AS pos, 1 AS src FROM nation WHERE n_nationkey % 3 = 0), u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
    f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY src, pos) = 1) SELECT k, pos, (row_number() OVER (ORDER BY src, pos))::INT AS ordinal FROM f""")
def ordered_union(spark, sf_dir):
    """One discovery after the other, each key once."""
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return reports.ordered_union(n.filter("k % 2 = 0").withColumn("pos", F.col("k")), n.filter("k % 3 = 0").withColumn("pos", -F.col("k")), key="k")


@slate("""WITH m AS (SELECT DISTINCT c_nationkey AS k FROM customer), i AS (SELECT DISTINCT s_nationkey AS k FROM supplier), a AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 2), u AS (SELECT k FROM m UNION SELECT k FROM i)
    SELECT (SELECT count(*) FROM m) AS main, (SELECT count(*) FROM i) AS industry, (SELECT count(*) FROM u) AS union, (SELECT count(*) FROM (SELECT k FROM u EXCEPT SELECT k FROM a)) AS unfetched, (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM u)) AS unlisted,
    greatest(0, (SELECT count(*) FROM m) + (SELECT count(*) FROM i) - (SELECT count(*) FROM u)) AS repeats, (SELECT count(*) FROM (SELECT k FROM u EXCEPT SELECT k FROM a)) + (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM u)) = 0 AS same""".replace("AS union,", 'AS "union",'))
def overlap_account(spark, sf_dir):
    """Repeats between discoveries and what one side lacks."""
    main = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    return reports.overlap_account(main, read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), read(spark, sf_dir, "nation").filter("n_nationkey > 2").select(F.col("n_nationkey").alias("k")), "k")


@slate("""WITH h AS (SELECT source, list_distinct(list(CASE WHEN source = 'src1' THEN 'terms' WHEN doc_id % 3 = 0 THEN 'faq' WHEN doc_id % 3 = 1 THEN 'pricing' ELSE 'terms' END)) AS h FROM documents GROUP BY source)
    SELECT source, array_to_string(list_filter(['faq', 'pricing', 'overview'], lambda x: NOT list_contains(h, x)), ',') AS missing FROM h""")
def missing_sections(spark, sf_dir):
    """Expected sections that a source lacks."""
    path = F.expr("CASE WHEN source = 'src1' THEN 'terms' WHEN doc_id % 3 = 0 THEN 'FAQ > One' WHEN doc_id % 3 = 1 THEN ' pricing' ELSE 'terms' END")
    found = read(spark, sf_dir, "documents").select("source", path.alias("heading_path"))
    return reports.missing_sections(found, "source", ["faq", "pricing", "overview"]).select("source", F.array_join("missing", ",").alias("missing"))


@slate("""WITH f AS (SELECT source AS file, count(*) AS pages, sum(length(trim(coalesce(text, '')))) AS chars FROM documents GROUP BY source), p AS (SELECT *, round(chars / pages, 1) AS per_page FROM f)
    SELECT file, pages, chars::BIGINT AS chars, per_page, CASE WHEN chars = 0 THEN 'empty' WHEN per_page < 1500 THEN 'poor' WHEN per_page < 2500 THEN 'fair' ELSE 'good' END AS status FROM p""")
def pdf_audit(spark, sf_dir):
    """Files by how much text their pages have."""
    return reports.pdf_audit(read(spark, sf_dir, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("page"), "text"), poor=1500, fair=2500)


@slate("""WITH c AS (SELECT 's' || s_suppkey::VARCHAR AS folder FROM supplier), x AS (SELECT 's' || l_suppkey::VARCHAR AS folder, ['pdf', 'xlsx', 'none'][l_linenumber % 3 + 1] AS ext, count(*) AS n FROM lineitem WHERE l_suppkey % 3 <> 0 GROUP BY ALL)
    SELECT folder, coalesce(sum(n), 0)::BIGINT AS files, coalesce(string_agg(ext || '=' || n::VARCHAR, ',' ORDER BY ext), '') AS by_extension FROM c LEFT JOIN x USING (folder) GROUP BY folder""")
def folder_totals(spark, sf_dir):
    """Files of every folder by extension, empty folders too."""
    name = F.expr("CASE l_linenumber % 3 WHEN 0 THEN 'A.PDF' WHEN 1 THEN 'b.xlsx' ELSE 'readme' END")
    files = read(spark, sf_dir, "lineitem").filter("l_suppkey % 3 <> 0").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("folder"), name.alias("name"))
    found = reports.folder_totals(files, read(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("folder")))
    return found.select("folder", "files", F.array_join(F.transform(F.map_entries("by_extension"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("by_extension"))


@slate("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'https://x.example/p/' || o_orderkey::VARCHAR || '/a' END AS detail, first.l_partkey AS part FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, l_linenumber) AS l_partkey FROM lineitem GROUP BY 1) first ON l_orderkey = o_orderkey""")
def first_lookup(spark, sf_dir):
    """The first detail address with the slug, and the first row of the same key."""
    k = F.col("o_orderkey").cast("string")
    found = F.array(F.lit("https://x.example/none"), F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://x.example/p/"), k, F.lit("/a"))).otherwise("-"), F.concat(F.lit("https://x.example/q/"), F.when(F.col("o_orderkey") % 3 == 0, k).otherwise("-")))
    left = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), reports.detail_url(F.concat(F.lit("/"), k, F.lit("/")), found).alias("detail"))
    # lines of an order can have one number: the first in the file comes first
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    counted = read(spark, sf_dir, "lineitem").filter("l_partkey IS NOT NULL AND l_linenumber IS NOT NULL")  # as in arg_min
    right = counted.select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("part"), "l_linenumber", *place)
    return reports.first_match(left, right, "id", "l_linenumber", "file", "row")


@slate("""SELECT l_orderkey AS page, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY (l_partkey % 100) // 20, l_suppkey, l_linenumber::VARCHAR) AS text FROM lineitem GROUP BY 1""")
def reading_order(spark, sf_dir):
    """Words of a page by lines and from the left."""
    words = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 100).alias("top"), F.col("l_suppkey").alias("left"), F.col("l_linenumber").cast("string").alias("text"))
    return reports.reading_order(words, "page")


SAID = case("doc_id % 9", ["'Showing 9 out of 117 packages'", "'Result - 41 Packages'", "'Now starting from AED 1,250.50 only'", "'```json [\"How much is it now?\", \"no\", \"What  about the visa?\"] ```'", "'12 Filing of returns'", "'Text cut here Read More'", "'a<b> & \"c\"'", "'FAQs & more'", "'None'"])


@slate("""SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 117 WHEN 1 THEN 41 END AS total, CASE WHEN doc_id % 9 = 2 THEN 'AED 1250.50' END AS price, CASE WHEN doc_id % 9 = 3 THEN 'How much is it now?|What about the visa?' ELSE '' END AS related, CASE WHEN doc_id % 9 = 4 THEN 12 END AS serial,
    CASE doc_id % 9 WHEN 5 THEN 'Text cut here' WHEN 6 THEN 'a<b> & "c"' ELSE 'x' END AS crumbs, CASE doc_id % 9 WHEN 6 THEN 'a&lt;b&gt; &amp; &quot;c&quot;' WHEN 7 THEN 'FAQs &amp; more' ELSE 'x' END AS escaped, CASE doc_id % 9 WHEN 7 THEN 'faqs' WHEN 8 THEN 'none' ELSE 'x' END AS label FROM documents""")
def text_facts(spark, sf_dir):
    """Totals, prices, questions, serials, crumbs, escapes and labels in texts."""
    t, n = F.expr(SAID), F.col("doc_id") % 9
    price = text.starting_price(t)
    return read(spark, sf_dir, "documents").select(
        "doc_id", text.stated_total(t).alias("total"), text.priced(price["amount"].cast("string"), price["currency"]).alias("price"), F.array_join(text.related_questions(t), "|").alias("related"), text.leading_serial(t)["sr"].alias("serial"),
        F.when(n.isin(5, 6), text.without_crumbs(t)).otherwise("x").alias("crumbs"), F.when(n.isin(6, 7), text.escaped(t)).otherwise("x").alias("escaped"), F.when(n.isin(7, 8), text.section_label(t)).otherwise("x").alias("label"),
    )


LINKS = ["https://www.example.com/product-details/a/", "http://evil.example.net/x", "https://drive.google.com/file/d/1/view", "ftp://example.com/", "https://docs.google.com/d?x=1", "12025550123@c.us", "https://chat.whatsapp.com/AbCdEfGhIjKl", "+1 (202) 555-0123"]


@slate("""SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'https://www.example.com/product-details/a' WHEN 2 THEN 'https://drive.google.com/file/d/1/view?usp=sharing' WHEN 4 THEN 'https://docs.google.com/d?x=1&usp=sharing' WHEN 6 THEN 'https://chat.whatsapp.com/AbCdEfGhIjKl' END AS open_url,
    CASE WHEN doc_id % 8 = 5 THEN '12025550123@c.us' END AS chat, CASE WHEN doc_id % 8 = 6 THEN 'AbCdEfGhIjKl' END AS invite, CASE WHEN doc_id % 8 IN (5, 7) THEN '12025550123' END AS phone, CASE doc_id % 8 WHEN 0 THEN 'a' WHEN 2 THEN 'view' ELSE '' END AS slug FROM documents""")
def open_links(spark, sf_dir):
    """Addresses that may be opened, chat ids, invites, phones and slugs."""
    u, n = F.expr(case("doc_id % 8", [f"'{x}'" for x in LINKS])), F.col("doc_id") % 8
    return read(spark, sf_dir, "documents").select("doc_id", urls.open_url(u).alias("open_url"), urls.chat_id(u).alias("chat"), urls.invite_code(u).alias("invite"), F.when(n.isin(5, 7), urls.phone_digits(u)).alias("phone"), F.when(n.isin(0, 2), urls.slug_of(u)).otherwise("").alias("slug"))


@slate("""WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS p, count(*) AS n FROM events GROUP BY 1), s AS (SELECT CASE WHEN p = 0 THEN 'failed' WHEN n % 3 = 0 THEN 'new' WHEN n % 3 = 1 THEN 'changed' ELSE 'skipped' END AS status, n FROM r)
    SELECT count(*) AS seen, count(*) FILTER (status = 'new') AS new, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS failed, sum(n)::BIGINT AS chunks FROM s""")
def ingest_counters(spark, sf_dir):
    """Counts of an ingest by status."""
    r = read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count("*").alias("chunks"))
    return reports.counters(r.select(F.when(F.col("p") == 0, "failed").when(F.col("chunks") % 3 == 0, "new").when(F.col("chunks") % 3 == 1, "changed").otherwise("skipped").alias("status"), "chunks"))


QUERIES, ORACLES = slate.queries, slate.oracles
