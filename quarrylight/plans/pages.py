"""Sections, chunks, payloads and crawls over the tables, by the functions of operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight import config as c
from quarrylight.functions import urls
from quarrylight.operators import crawl, pages, payloads, sections
from quarrylight.plans import Slate, read
from quarrylight.plans.focus import case, has

slate = Slate()

KIND = case("pos % 8", ["'h2'", "'p'", "'p'", "'list'", "'h3'", "'p'", "'h4'", "'p'"])
TEXT = "CASE WHEN pos % 40 = 8 THEN 'Table of contents of this page' WHEN pos % 24 = 12 THEN 'By someone, 3 Jan 2024 min read' ELSE line END"
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace({}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[ \t\n\r\f\v]+([,.;:!?])', '\1', 'g')"
NOISE_HEAD = f"({has('text', c.BYLINE_HEADING)} OR {has('text', c.TOC_HEADING)} OR {has('text', c.BREADCRUMB_HEADING)})"
BLOCKS = f"""WITH a AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM a),
    raw AS (SELECT doc_id, pos, {KIND} AS kind, {CLEAN.format('(' + TEXT + ')')} AS text FROM lines),
    toc AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('h2', 'h3', 'h4') THEN {has('text', c.TOC_HEADING)} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), false) AS toc FROM raw),
    kept AS (SELECT doc_id, pos, kind, text FROM toc WHERE CASE WHEN kind IN ('h2', 'h3', 'h4') THEN NOT {NOISE_HEAD} ELSE NOT toc END AND NOT (length(trim(text)) < 20 OR {has('trim(text)', c.NOISE_TEXT)})
        AND NOT (kind = 'list' AND len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 3)),
    blocks AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY doc_id, kind, text ORDER BY pos) = 1)
"""


def blocks_of(spark, sf_dir):
    """Lines of documents as blocks of all kinds."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    return d.select("doc_id", "pos", F.expr(KIND).alias("kind"), F.expr(TEXT).alias("text"))


@slate(BLOCKS + "SELECT doc_id, pos, kind, sha1(text) AS sha FROM blocks")
def section_blocks(spark, sf_dir):
    """Blocks without noise, contents and repeats."""
    return sections.clean_blocks(blocks_of(spark, sf_dir), "doc_id").select("doc_id", "pos", "kind", F.sha1("text").alias("sha"))


@slate(BLOCKS + f""", g AS (SELECT *, sum((kind = 'h2')::INT) OVER w AS g2, sum((kind IN ('h2', 'h3'))::INT) OVER w AS g3, last_value(CASE WHEN kind = 'h2' THEN text END IGNORE NULLS) OVER w AS a FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    b AS (SELECT *, last_value(CASE WHEN kind = 'h3' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, g2 ORDER BY pos) AS b FROM g),
    x AS (SELECT *, last_value(CASE WHEN kind = 'h4' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, g3 ORDER BY pos) AS c FROM b),
    p AS (SELECT doc_id, pos, text, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN 'Introduction' ELSE concat_ws(' > ', a, b, c) END AS heading_path, coalesce(c, b, a, 'Introduction') AS heading_text FROM x WHERE kind NOT IN ('h2', 'h3', 'h4')),
    s AS (SELECT doc_id, heading_path, any_value(heading_text) AS heading_text, min(pos) AS first_pos, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, count(*) AS n FROM p GROUP BY doc_id, heading_path)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first_pos))::INT AS ordinal, sha1(doc_id::VARCHAR)[:12] || '_' || sha1(heading_path)[:16] AS section_id, sha1(heading_text) AS heading, sha1(text) AS sha, n::INT AS n
    FROM s WHERE NOT {NOISE_HEAD.replace("'text'", "'heading_text'").replace('(text,', '(heading_text,')}""")
def document_sections(spark, sf_dir):
    """Sections by heading path."""
    found = sections.sections(sections.clean_blocks(blocks_of(spark, sf_dir), "doc_id"), "doc_id")
    return found.select("doc_id", "ordinal", "section_id", F.sha1("heading_text").alias("heading"), F.sha1("text").alias("sha"), F.size("spans").alias("n"))


@slate(r"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '([^ \t\n\r\f\v]+)', 1) AS w FROM documents),
    c AS (SELECT doc_id, unnest(CASE WHEN len(w) <= 400 THEN [text] ELSE list_transform(range(0, ceil((len(w) - 400) / 320.0)::INT + 1), lambda i: array_to_string(list_slice(w, i * 320 + 1, i * 320 + 400), ' ')) END) AS chunk, unnest(range(CASE WHEN len(w) <= 400 THEN 1 ELSE ceil((len(w) - 400) / 320.0)::INT + 1 END))::INT AS chunk_index FROM w)
    SELECT doc_id, chunk_index, sha1(doc_id::VARCHAR || '|s|' || chunk_index::VARCHAR || '|hashed-bag') AS chunk_id, sha1(chunk) AS content_sha1, length(chunk)::INT AS chunk_char_len, sha1('Title: Doc ' || doc_id::VARCHAR || chr(10) || 'PageKind: pricing' || chr(10) || 'PriceDisclaimer: public starting-from price, not a quote. Drive SKU rows win on exact fees.' || chr(10) || 'Section: all' || chr(10) || chunk) AS embed_sha FROM c""")
def section_chunks(spark, sf_dir):
    """Chunks of whole documents as sections, with ids and what is embedded."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit("s").alias("section_id"), F.lit("all").alias("heading_path"), F.lit(1).alias("ordinal"), F.coalesce("text", F.lit("")).alias("text"))
    title = F.concat(F.lit("Doc "), F.col("doc_id").cast("string"))
    found = sections.chunks(d, F.col("doc_id").cast("string"), title, F.lit("pricing"), F.lit(None).cast("string"))
    return found.select("doc_id", "chunk_index", "chunk_id", "content_sha1", "chunk_char_len", F.sha1("embed_text").alias("embed_sha"))


def page_sections(spark, sf_dir):
    """Sections of real pages; tested against a loop over their blocks."""
    found = read(spark, sf_dir, "pages").select("page_id", F.inline(pages.html_blocks("html")))
    made = sections.sections(sections.clean_blocks(found, "page_id"), "page_id")
    return made.select("page_id", "ordinal", "heading_path", F.sha1("text").alias("sha"))


def one(pattern: str) -> str:
    found = f"regexp_replace(regexp_extract(html, '{pattern}', 1), '<[^>]+>', ' ', 'g')"
    return f"nullif({CLEAN.format(found)}, '')"


@slate(rf"""SELECT page_id, sha1(coalesce({one("(?is)<h1[^>]*>(.*?)</h1>")}, {one("(?is)<title[^>]*>(.*?)</title>")}, 'Untitled')) AS title,
    nullif(regexp_extract(html, '\b([0-9][0-9]? (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* [0-9][0-9][0-9][0-9])\b', 1), '') AS date FROM pages""")
def page_facts(spark, sf_dir):
    """Titles and dates of pages; none of them has author or category."""
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.sha1(sections.page_title(h)).alias("title"), sections.page_date(h).alias("date"))


MARKED = "concat('Intro ', coalesce(left(text, 20), ''), ' Overview: ', lang, ' Process: ', source, CASE WHEN doc_id % 3 = 0 THEN ' Steps: again' ELSE '' END, ' Fees: ', CAST(doc_id AS STRING))"


@slate(f"""WITH t AS (SELECT doc_id, doc_id % 3 = 0 AS again, lang, source FROM documents)
    SELECT doc_id, lang AS overview, CASE WHEN again THEN 'again' ELSE source END AS process, doc_id::VARCHAR AS fees FROM t""")
def marker_split(spark, sf_dir):
    """Parts between markers; of two markers of one label the last counts."""
    parts = sections.marker_split(F.expr(MARKED), {"Overview:": "overview", "Process:": "process", "Steps:": "process", "Fees:": "fees"})
    return read(spark, sf_dir, "documents").select("doc_id", parts.alias("p")).select("doc_id", *(F.col("p")[k].alias(k) for k in ("overview", "process", "fees")))


@slate("""SELECT doc_id, unnest(CASE WHEN doc_id % 2 = 0 THEN [0, 1] ELSE [0] END)::INT AS n, unnest(CASE WHEN doc_id % 2 = 0 THEN ['What is ' || lang || '?', 'Is it ' || source || '?'] ELSE ['Who are you?'] END) AS question, unnest(CASE WHEN doc_id % 2 = 0 THEN ['A language.', 'Yes.'] ELSE ['Nobody.' || chr(10) || 'Really.'] END) AS answer FROM documents""")
def faq_texts(spark, sf_dir):
    """Questions and answers out of numbered and of plain texts."""
    said = F.expr("CASE WHEN doc_id % 2 = 0 THEN concat('FAQ 1. What is ', lang, '? A language. 2. Is it ', source, '? Yes.') ELSE concat('About', chr(10), 'Who are you?', chr(10), 'Nobody.', chr(10), 'Really.') END")
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(sections.question_answers(said)).alias("n", "x")).select("doc_id", "n", "x.question", "x.answer")


@slate("""SELECT doc_id, len(list_filter([lang, source, 'Third'], lambda x: x <> ''))::INT AS points, 'Growth' AS title, 'It is ' || lang || '.' AS text FROM documents""")
def point_texts(spark, sf_dir):
    """Bullets and named insights of running text."""
    bullets = sections.points(F.concat(F.lit("• "), "lang", F.lit(" • "), "source", F.lit("\n- Third")))
    named = sections.insights(F.concat(F.lit("Growth: It is "), "lang", F.lit(". Trade: It "), "source", F.lit(".")))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(bullets).alias("points"), named[0]["title"].alias("title"), named[0]["text"].alias("text"))


def _payloads(spark, sf_dir):
    """Nations as payloads of country pages."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lit = lambda x: F.lit(x)
    qa = lambda q, a: F.struct(q.alias("question"), a.alias("answer"))
    name = F.col("n_name")
    return n.select(F.col("n_nationkey").alias("key"), F.to_json(F.struct(
        name.alias("title"), F.lit("  Set up here ").alias("subHeader"), F.concat(lit("All about "), name).alias("overviewDetail"), F.struct(name.alias("name"), F.lower(name).alias("slug")).alias("country"),
        F.array(F.struct(F.lit("Market size").alias("title"), F.concat(lit("Large in "), name).alias("text"))).alias("marketInsights"), F.array(F.struct(F.concat(lit("Low tax in "), name).alias("value"))).alias("keySellingPoints"),
        F.array(qa(lit("Apply"), lit("Fill in the form")), qa(lit("Wait"), F.lit(None).cast("string"))).alias("processStep"), F.array(qa(F.concat(lit("Why "), name, lit("?")), lit("Because it is near"))).alias("FAQs"),
        F.array(F.struct(F.col("n_nationkey").alias("id"), lit("Green fund").alias("title"), lit("green").alias("slug"), (F.col("n_nationkey") * 1000.0).alias("startingPrice"), lit("USD").alias("currency"), F.col("r_name").alias("authorityName"))).alias("funds"),
        F.array(F.struct(lit("Peerland").alias("countryName"), F.array(F.struct(lit("VAT Rate").alias("key"), lit("5 %").alias("value"))).alias("comparison"))).alias("compare"),
    )).alias("payload"))


@slate("""WITH n AS (SELECT n_nationkey AS key, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    s AS (SELECT key, 0 AS k, 'market_insights > Market size' AS path, 'Market size' AS heading, 'Large in ' || n_name AS text FROM n
    UNION ALL SELECT key, 1, 'selling_points > Low tax in ' || n_name, 'Low tax in ' || n_name, 'Low tax in ' || n_name FROM n
    UNION ALL SELECT key, 2, 'overview', 'Country Overview', 'Set up here' || chr(10) || chr(10) || 'All about ' || n_name FROM n
    UNION ALL SELECT key, 3, 'process_flow', 'Application process', '1. Apply: Fill in the form' FROM n
    UNION ALL SELECT key, 4, 'process_flow > Apply', 'Apply', 'Apply' || chr(10) || 'Fill in the form' FROM n
    UNION ALL SELECT key, 5, 'faq > Why ' || n_name || '?', 'Why ' || n_name || '?', 'Q: Why ' || n_name || '?' || chr(10) || 'A: Because it is near' FROM n
    UNION ALL SELECT key, 6, 'top_funds > Green fund', 'Green fund', 'Fund: Green fund' || chr(10) || 'Starting from: USD ' || CASE WHEN key = 0 THEN '0' ELSE key::VARCHAR || ',000' END || chr(10) || 'Country: ' || r_name || chr(10) || 'Slug: green' || chr(10) || 'Details: /product-details/funds/' || replace(lower(r_name), ' ', '-') || '/green/' || key::VARCHAR FROM n
    UNION ALL SELECT key, 8, 'compare', 'Comparison', 'Country comparison for ' || n_name || '.' || chr(10) || 'Peerland — VAT Rate: 5 %' FROM n
    UNION ALL SELECT key, 9, 'compare > Peerland', 'Peerland', 'Comparison peer: Peerland' || chr(10) || 'VAT Rate: 5 %' FROM n
    UNION ALL SELECT key, 10, 'compare > Peerland > VAT Rate', 'Peerland VAT Rate', 'Peerland — VAT Rate: 5 %' FROM n)
    SELECT key, (row_number() OVER (PARTITION BY key ORDER BY k))::INT AS ordinal, path, heading, text FROM s""")
def country_payloads(spark, sf_dir):
    """Country pages from JSON to sections."""
    return payloads.country_sections(_payloads(spark, sf_dir))


@slate("""WITH p AS (SELECT p_partkey AS key, p_name, p_type, p_retailprice FROM part),
    s AS (SELECT key, 0 AS k, 0 AS i, 'introduction' AS path, 'Introduction' AS heading, 'About ' || p_name AS text FROM p
    UNION ALL SELECT key, 1, 0, 'documents_required', 'Documents Required', '1. Passport' || chr(10) || '2. Photo: In colour' FROM p
    UNION ALL SELECT key, 4, 0, 'faqs > Which?', 'Which?', 'Q: Which?' || chr(10) || 'A: ' || p_type FROM p
    UNION ALL SELECT key, 5, 0, 'terms_and_conditions', 'Terms & Conditions', 'No refunds at all' FROM p
    UNION ALL SELECT key, 8, 0, 'pricing', 'Pricing', 'Service: ' || p_name || chr(10) || 'Type: ' || p_type || chr(10) || 'Starting from: AED 10' FROM p)
    SELECT key, (row_number() OVER (PARTITION BY key ORDER BY k))::INT AS ordinal, path, heading, text FROM s""")
def service_payloads(spark, sf_dir):
    """Services from JSON to sections."""
    item = lambda **f: F.struct(*(F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in f.items()))
    made = F.struct(
        F.col("p_name").alias("title"), F.col("p_type").alias("type"), F.concat(F.lit("About "), "p_name").alias("description"), F.lit("10").alias("price"), F.lit("AED").alias("currency"),
        F.array(item(name="Passport", description=""), item(name="Photo", description="In colour")).alias("documentsRequired"),
        F.array(item(question="Which?", answer=F.col("p_type"))).alias("faqs"), F.array(item(termAndCondition="No refunds at all")).alias("termsAndConditions"),
    )
    return payloads.service_sections(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.to_json(F.struct(made.alias("attributes"))).alias("payload")))


SEEN = "https://www.example.com"


@slate(r"""WITH e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 7) % 25 FROM nation),
    l0 AS (SELECT 0 AS n, 0 AS level), l1 AS (SELECT DISTINCT b AS n, 1 AS level FROM e JOIN l0 ON a = n WHERE b <> 0),
    s1 AS (SELECT n FROM l0 UNION SELECT n FROM l1), l2 AS (SELECT DISTINCT b AS n, 2 AS level FROM e JOIN l1 ON a = n WHERE b NOT IN (SELECT n FROM s1)),
    s2 AS (SELECT n FROM s1 UNION SELECT n FROM l2), l3 AS (SELECT DISTINCT b AS n, 3 AS level FROM e JOIN l2 ON a = n WHERE b NOT IN (SELECT n FROM s2)),
    every AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3)
    SELECT 'https://www.example.com/' || n::VARCHAR || '/' AS url, level, CASE WHEN level > 0 THEN (SELECT min('https://www.example.com/' || p.n::VARCHAR || '/') FROM every p JOIN e ON e.a = p.n WHERE e.b = x.n AND p.level = x.level - 1) END AS found_on FROM every x""")
def crawl_frontier(spark, sf_dir):
    """Nations as pages that link to two others each, crawled by levels from the first."""
    k = F.col("n_nationkey")
    html = F.concat(F.lit('<p><a class="x" HREF="/'), ((k * 3 + 1) % 25).cast("string"), F.lit("?utm=1\">a</a> <a href='../"), ((k + 7) % 25).cast("string"), F.lit("/#top'>b</a><a href='#no'>c</a><a href='mailto:x@y.zz'>m</a>"))
    site = read(spark, sf_dir, "nation").select(F.concat(F.lit(SEEN + "/"), k.cast("string"), F.lit("/")).alias("url"), html.alias("html"))
    edges = crawl.links(site, ["example.com"]).select("url", "pos", "target")
    return crawl.crawl(site.filter(F.col("url") == SEEN + "/0/").select("url"), edges, levels=3)


CRAWL_LEVELS, CRAWL_CAP = 3, 3


def _levels() -> str:
    """Levels of a crawl in SQL: pages that answer from another address count as that one, and a listing (pages of the same number div 5) gives CRAWL_CAP children at most."""
    parts = ["s0 AS (SELECT 0 AS n, 0 AS level, NULL::INT AS found, NULL::INT AS base, NULL::INT AS status)"]
    for i in range(CRAWL_LEVELS + 1):
        before = "".join(f" AND final NOT IN (SELECT final FROM a{j})" for j in range(i))
        parts.append(f"a{i} AS (SELECT s.n, s.base, t.final, t.status FROM s{i} s JOIN site t USING (n) WHERE s.level = {i} AND s.status IS NULL)")
        parts.append(f"r{i} AS (SELECT final AS n, {i} AS level, min(n) AS found, arg_min(base, n) AS base, arg_min(status, n) AS status FROM a{i} WHERE final <> n AND final NOT IN (SELECT n FROM s{i}) GROUP BY final)")
        parts.append(f"k{i} AS (SELECT s.n, s.level, s.found, s.base, coalesce(s.status, a.status) AS status FROM s{i} s LEFT JOIN a{i} a USING (n) UNION ALL SELECT * FROM r{i})")
        parts.append(f"p{i} AS (SELECT DISTINCT final AS n FROM a{i} WHERE status < 400{before})")
        parts.append(f"n{i} AS (SELECT target AS n, e.n AS found, e.n // 5 AS base, pos FROM p{i} JOIN e USING (n) WHERE target NOT IN (SELECT n FROM k{i}) QUALIFY row_number() OVER (PARTITION BY target ORDER BY e.n, pos) = 1)")
        parts.append(f"c{i} AS (SELECT n, {i + 1} AS level, found, base, NULL::INT AS status FROM n{i} x QUALIFY row_number() OVER (PARTITION BY base ORDER BY found, pos) + (SELECT count(*) FROM k{i} k WHERE k.base = x.base) <= {CRAWL_CAP})")
        parts.append(f"s{i + 1} AS (SELECT * FROM k{i} UNION ALL SELECT * FROM c{i})")
    return ",\n    ".join(parts)


@slate(f"""
    WITH site AS (SELECT n_nationkey AS n, CASE WHEN n_nationkey % 4 = 3 THEN (n_nationkey + 9) % 25 ELSE n_nationkey END AS final, CASE WHEN n_nationkey % 11 = 10 THEN 404 ELSE 200 END AS status FROM nation),
    e AS (SELECT n_nationkey AS n, d AS pos, CASE d WHEN 0 THEN (n_nationkey * 3 + 1) % 25 WHEN 1 THEN (n_nationkey + 7) % 25 ELSE (n_nationkey * 2 + 3) % 25 END AS target FROM nation, range(0, 3) t(d)
        QUALIFY row_number() OVER (PARTITION BY n_nationkey, target ORDER BY d) = 1),
    {_levels()}
    SELECT 'p' || n AS page, level::INT AS level, 'p' || found AS found_on, status FROM k{CRAWL_LEVELS}""")
def crawl_redirects(spark, sf_dir):
    """Nations as pages of which some answer from another one's address and some do not answer, crawled with fetching between levels."""
    k = F.col("n_nationkey")
    at = lambda n: F.concat(F.lit(SEEN + "/l"), F.floor(n / 5).cast("string"), F.lit("/page/"), n.cast("string"), F.lit("/"))
    html = F.concat(*(x for n in ((k * 3 + 1) % 25, (k + 7) % 25, (k * 2 + 3) % 25) for x in (F.lit('<a href="'), at(n), F.lit('">x</a>'))))
    site = read(spark, sf_dir, "nation").select(k.alias("n"), F.when(k % 4 == 3, (k + 9) % 25).otherwise(k).alias("final"), F.when(k % 11 == 10, 404).otherwise(200).alias("status"), html.alias("html"))
    served = site.select(at(F.col("n")).alias("url"), F.col("final").alias("to"), "status").join(site.select(F.col("n").alias("to"), "html"), "to").select("url", "status", at(F.col("to")).alias("final_url"), "html")
    found = crawl.crawl_live(site.filter("n = 0").select(at(F.col("n")).alias("url")), lambda asked: served.join(asked, "url"), CRAWL_LEVELS, CRAWL_CAP, ["example.com"])
    name = lambda c: F.concat(F.lit("p"), F.regexp_extract(c, r"/page/(\d+)/$", 1))
    return found.select(name("url").alias("page"), "level", F.when(F.col("found_on").isNotNull(), name("found_on")).alias("found_on"), "status")


@slate("""WITH l AS (SELECT n_nationkey AS k, n_nationkey % 5 + 1 AS n FROM nation) SELECT 'https://www.example.com/blog/category/' || k::VARCHAR || '/page/1' AS url, p::INT AS page, 'https://www.example.com/blog/category/' || k::VARCHAR || '/page/' || p::VARCHAR || '/' AS target FROM l, range(2, 7) t(p) WHERE p <= n""")
def inferred_pages(spark, sf_dir):
    """Pages 2 to N by what a pager says."""
    k = F.col("n_nationkey")
    n = (k % 5 + 1).cast("string")
    pager = F.when(k % 2 == 0, F.concat(F.lit("Page 1 of "), n)).when(k % 5 >= 2, F.concat(F.lit("1 2 3 ... "), n, F.lit(" >"))).otherwise(F.concat(F.lit("page 1 / "), n))
    return crawl.inferred_pages(read(spark, sf_dir, "nation").select(F.concat(F.lit(SEEN + "/blog/category/"), k.cast("string"), F.lit("/page/1")).alias("url"), pager.alias("pager")))


@slate("SELECT event_id AS id, event_id // 100 AS page FROM events WHERE event_id // 100 BETWEEN 0 AND 5")
def paged_listing(spark, sf_dir):
    """Rows of a paged listing until a page repeats what was seen, here the seventh."""
    e = read(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("p"), (F.col("event_id") % 100).alias("pos"), F.col("event_id").alias("id"))
    rows_ = e.select(F.col("p").alias("page"), "pos", F.expr("CASE WHEN p = 6 THEN id - 600 ELSE id END").alias("id"))
    return crawl.paged(rows_, ["id"]).select("id", "page")


@slate("SELECT DISTINCT 'https://www.example.com/' || n_name AS loc FROM nation")
def sitemap_index(spark, sf_dir):
    """An index of sitemaps by region, and their addresses."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    child = F.concat(F.lit("https://m.example.com/"), F.col("key").cast("string"))
    maps = n.groupBy(F.col("n_regionkey").alias("key")).agg(F.concat_ws("", F.collect_list(F.concat(F.lit("<url><loc>https://www.example.com/"), "n_name", F.lit("</loc></url>")))).alias("xml")).select(child.alias("url"), "xml")
    index = r.agg(F.concat_ws("", F.lit("<sitemapindex>"), F.collect_list(F.concat(F.lit("<sitemap><loc>https://m.example.com/"), F.col("r_regionkey").cast("string"), F.lit("</loc></sitemap>")))).alias("xml")).select(F.lit("https://m.example.com/index").alias("url"), "xml")
    return crawl.sitemap(index.select("url"), index.unionByName(maps))


PATHS = ["/", "/blog", "/blog/a-post/", "/blog/category/x/", "/blog/category/x/page/3", "/blog/feed", "/services/visa", "/services/visa/gold", "/services/overview/tax", "/services/funds/x", "/country-overview/cyprus", "/HK/", "/sg", "/product-details/a/b", "/products/tool", "/products/affiliate-program", "/case-studies", "/case-studies/one", "/case-studies/industries/oil", "/announcement/events/", "/announcement/events/2024/fair", "/announcement/press-releases/2023/news", "/announcement/other", "/pricing-master-list", "/business-guides/uae", "/product-listing", "/llms.txt", "/contact-us", "/checkout/step", "/career-days", "/a/b/c"]
URL = "concat('https://www.example.com', " + case(f"page_id % {len(PATHS)}", [f"'{p}'" for p in PATHS]) + ", CASE WHEN page_id % 2 = 0 THEN '?q=1#x' ELSE '' END)"
KINDS = r"""CASE WHEN p = '/' THEN 'hub' WHEN p = '/llms.txt' OR p = '/contact-us' THEN 'company' WHEN regexp_matches(p, '^/announcement/press-releases/.') THEN 'press_release' WHEN regexp_matches(p, '^/announcement/events/.') THEN 'event' WHEN p LIKE '/announcement/%' THEN 'hub'
    WHEN p LIKE '/pricing-master-list%' THEN 'pricing' WHEN p LIKE '/business-guides%' THEN 'business_guide' WHEN regexp_matches(p, '^/case-studies/[^/]+$') THEN 'case_study' WHEN p LIKE '/case-studies%' THEN 'hub' WHEN p = '/sg' OR regexp_matches(p, '^/country-overview/[^/]*$') THEN 'country_overview'
    WHEN p LIKE '/product-listing%' THEN 'package_listing' WHEN p LIKE '/services/funds%' THEN 'fund' WHEN p LIKE '/product-details/%' OR p = '/products/tool' THEN 'product_detail' WHEN p = '/services/visa/gold' THEN 'service_package' ELSE 'service_landing' END"""


@slate(f"""WITH u AS (SELECT page_id, {URL} AS url FROM pages), v AS (SELECT page_id, url, coalesce(nullif(regexp_replace(regexp_extract(url, '^https://[^/]*([^?#]*)', 1), '/+$', ''), ''), '/') AS p FROM u)
    SELECT page_id, {KINDS} AS kind, p IN ('/blog/a-post') AS post, p IN ('/', '/blog') OR p LIKE '/blog/category/%' AS listing, p LIKE '%/page/3' AS paging,
    regexp_matches(lower(p), '^/(blog|checkout|career|products/affiliate-program)') AS denied, {KINDS} IN ('package_listing', 'hub') AS skipped,
    CASE WHEN regexp_extract(url, '^https://[^/]*([^?#]*)', 1) LIKE '%.txt' OR regexp_extract(url, '^https://[^/]*([^?#]*)', 1) LIKE '%/' THEN 'https://www.example.com' || regexp_extract(url, '^https://[^/]*([^?#]*)', 1) ELSE 'https://www.example.com' || regexp_extract(url, '^https://[^/]*([^?#]*)', 1) || '/' END AS canonical FROM v""")
def url_rules(spark, sf_dir):
    """Kinds and predicates of addresses."""
    u = F.expr(URL)
    return read(spark, sf_dir, "pages").select("page_id", urls.page_kind(u).alias("kind"), urls.blog_post(u).alias("post"), urls.listing(u).alias("listing"), urls.pagination(u).alias("paging"), urls.denied(u).alias("denied"), urls.skipped(u).alias("skipped"), urls.canonicalised(u).alias("canonical"))


QUERIES, ORACLES = slate.queries | {"page_sections": page_sections}, slate.oracles
