"""Documents, pages and conversations: cleaning, structure, chunks, addresses, history and intents."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.functions import text, urls
from quarrylight.operators import rows, sections, timelines
from quarrylight.plans import Slate, read

slate = Slate()
CHUNK, OVERLAP = 400, 80


@slate(r"""SELECT doc_id, sha1(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'),
    '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '[ \t\n\r\f\v]+([,.;:!?])', '\1', 'g')) AS sha FROM documents""")
def clean_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sha1(text.cleaned(F.col("text"))).alias("sha"))


def _lines(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))


LINES = """WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
    lines AS (SELECT doc_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS line FROM a)"""


@slate(LINES + " SELECT doc_id, min(pos) AS pos, sha1(line) AS sha FROM lines GROUP BY doc_id, line")
def block_dedupe(spark, sf_dir):
    """The first of equal blocks of a document."""
    return _lines(spark, sf_dir).groupBy("doc_id", "line").agg(F.min("pos").alias("pos")).select("doc_id", "pos", F.sha1("line").alias("sha"))


@slate(LINES + """, h AS (SELECT *, CASE WHEN pos % 6 = 0 THEN (pos % 18 = 0) END AS toc FROM lines),
    s AS (SELECT *, last_value(toc IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos) AS skipped FROM h)
    SELECT doc_id, count(*) AS blocks, count(*) FILTER (skipped) AS skipped FROM s GROUP BY doc_id""")
def toc_skip(spark, sf_dir):
    """Blocks after a heading of contents are skipped until the next heading."""
    flag = F.when(F.col("pos") % 6 == 0, F.col("pos") % 18 == 0)
    seen = _lines(spark, sf_dir).withColumn("toc", flag).withColumn("off", F.last("toc", True).over(W.partitionBy("doc_id").orderBy("pos")))
    return seen.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if("off").alias("skipped"))


@slate(LINES + """, h AS (SELECT *, CASE WHEN pos % 8 = 0 THEN line END AS h2, CASE WHEN pos % 8 = 4 THEN line WHEN pos % 8 = 0 THEN '' END AS h3 FROM lines),
    f AS (SELECT doc_id, pos, line, last_value(h2 IGNORE NULLS) OVER w AS a, last_value(h3 IGNORE NULLS) OVER w AS b FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, sha1(a || ' > ' || b) AS heading, min(pos) AS first_pos, count(*) AS blocks, sha1(string_agg(line, chr(10) ORDER BY pos)) AS sha FROM f GROUP BY doc_id, a, b""")
def heading_sections(spark, sf_dir):
    """Sections by heading path: headings are filled forward, a heading of the upper level resets the lower one."""
    at = W.partitionBy("doc_id").orderBy("pos")
    level = F.col("pos") % 8
    marked = _lines(spark, sf_dir).withColumn("a", F.last(F.when(level == 0, F.col("line")), True).over(at))
    marked = marked.withColumn("b", F.last(F.when(level == 4, F.col("line")).when(level == 0, ""), True).over(at))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    found = marked.groupBy("doc_id", "a", "b").agg(F.min("pos").alias("first_pos"), F.count("*").alias("blocks"), F.sha1(joined).alias("sha"))
    return found.select("doc_id", F.sha1(F.concat("a", F.lit(" > "), "b")).alias("heading"), "first_pos", "blocks", "sha")


@slate(LINES + " SELECT doc_id, pos // 2 AS part, sha1(string_agg(line, chr(10) ORDER BY pos)) AS sha FROM lines GROUP BY doc_id, pos // 2")
def paragraph_groups(spark, sf_dir):
    """Paragraphs two by two."""
    pairs = timelines.groups_of(_lines(spark, sf_dir), ["doc_id"], "pos", 2).groupBy("doc_id", F.col("part").cast("int").alias("part"))
    return pairs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("t")).select("doc_id", "part", F.sha1("t").alias("sha"))


@slate(rf"""
    WITH w AS (SELECT doc_id, regexp_extract_all(text, '([^ \t\n\r\f\v]+)', 1) AS w FROM documents),
    c AS (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - {OVERLAP}), {CHUNK - OVERLAP})) AS start FROM w WHERE len(w) > 0)
    SELECT doc_id, (start // {CHUNK - OVERLAP})::INT AS chunk_index, start::INT AS start, len(list_slice(w, start + 1, start + {CHUNK}))::INT AS n_tokens, sha1(array_to_string(list_slice(w, start + 1, start + {CHUNK}), ' ')) AS sha FROM c""")
def chunk_windows(spark, sf_dir):
    """Windows of 400 words that overlap by 80; the last one reaches the end."""
    found = read(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.lit(1), F.size("w") - OVERLAP) - 1, F.lit(CHUNK - OVERLAP))
    cut = found.select("doc_id", F.posexplode(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("w", s + 1, CHUNK).alias("w")))).alias("chunk_index", "c"))
    return cut.select("doc_id", "chunk_index", F.col("c.start").alias("start"), F.size("c.w").alias("n_tokens"), F.sha1(F.array_join("c.w", " ")).alias("sha"))


@slate("SELECT doc_id, sha1(coalesce(source, '') || '|' || doc_id::VARCHAR)[1:16] AS chunk_id, lang, CASE WHEN source IN ('src0', 'src1') THEN 'blog' ELSE 'website' END AS source_type, left(text, 400) AS excerpt, greatest(1, (length(text) + 3) // 4) AS est_tokens FROM documents")
def chunk_metadata(spark, sf_dir):
    """Ids, kinds, excerpt and estimated tokens of a chunk."""
    d = read(spark, sf_dir, "documents")
    key = F.sha1(F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")))
    kind = F.when(F.col("source").isin("src0", "src1"), "blog").otherwise("website")
    return d.select("doc_id", F.substring(key, 1, 16).alias("chunk_id"), "lang", kind.alias("source_type"), F.substring("text", 1, 400).alias("excerpt"), F.expr("greatest(1, (length(text) + 3) div 4)").alias("est_tokens"))


NOISE = "NOT contains(lower(text), 'license') AND contains(lower(text), 'the')"


@slate(f"""
    WITH f AS (SELECT doc_id, source, n_chars, {NOISE} AS noise, contains(lower(text), 'license') AS priced FROM documents),
    k AS (SELECT * FROM f QUALIFY NOT noise OR bool_and(noise) OVER (PARTITION BY source))
    SELECT doc_id, source, priced, (row_number() OVER (PARTITION BY source ORDER BY CASE WHEN priced THEN 0 ELSE 1 END, n_chars DESC, doc_id))::INT AS position FROM k QUALIFY position <= 10""")
def fee_focus_order(spark, sf_dir):
    """Noise goes unless nothing else is there; priced rows first, then by size; ten a source."""
    flagged = read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", F.expr(NOISE).alias("noise"), F.expr("contains(lower(text), 'license')").alias("priced"))
    only = flagged.groupBy("source").agg(F.bool_and("noise").alias("all_noise"))
    kept = flagged.join(rows.broadcast_if_small(only), "source").filter("NOT noise OR all_noise")
    return rows.numbered(kept, "position", ["source"], F.when(F.col("priced"), 0).otherwise(1), F.desc("n_chars"), "doc_id").filter("position <= 10").select("doc_id", "source", "priced", "position")


@slate("""
    WITH r AS (SELECT doc_id, source, lang, n_chars, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS n FROM documents)
    SELECT doc_id, source, lang, (row_number() OVER (PARTITION BY source ORDER BY least(n, 2), n_chars DESC, doc_id))::INT AS position FROM r QUALIFY position <= 8""")
def section_diversify(spark, sf_dir):
    """One row a section first, then the others, eight a source; groups are cut to eight before they meet."""
    cut = rows.numbered(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "n", ["source", "lang"], F.desc("n_chars"), "doc_id").filter("n <= 8")
    return rows.numbered(cut, "position", ["source"], F.least("n", F.lit(2)), F.desc("n_chars"), "doc_id").filter("position <= 8").select("doc_id", "source", "lang", "position")


@slate(r"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '([^ \t\n\r\f\v]+)', 1), 1, 12), ' ') AS phrase, trim(regexp_replace(regexp_replace(lower(left(text, 80)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, len(regexp_extract_all(text, '(?m)^[0-9]+\.\s+'))::INT AS numbered FROM documents")
def excerpts(spark, sf_dir):
    """First twelve words, a slug, and how many numbered lines there are."""
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(text.words(t), 1, 12), " ").alias("phrase"), text.slug(F.substring(t, 1, 80)).alias("slug"), F.regexp_count(t, F.lit(r"(?m)^[0-9]+\.\s+")).alias("numbered"))


STOP = ("the", "and", "for", "with", "that")


@slate("SELECT doc_id, len(list_filter(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}')), lambda t: t NOT IN ('the', 'and', 'for', 'with', 'that')))::INT AS n_terms FROM documents")
def match_terms(spark, sf_dir):
    """Distinct terms without stop words."""
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.array_except(text.terms(F.col("text")), F.array(*map(F.lit, STOP)))).alias("n_terms"))


@slate("SELECT doc_id FROM documents WHERE NOT coalesce(lang = 'fr' AND n_chars < 2000, false)")
def delete_by_filter(spark, sf_dir):
    return rows.delete_where(read(spark, sf_dir, "documents"), F.expr("lang = 'fr' AND n_chars < 2000")).select("doc_id")


U = r"""WITH p AS (SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
    coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), ''), '/') AS path FROM pages) """


@slate(U + r"SELECT page_id, 'https://' || regexp_replace(host, '^www\.', '') || path || CASE WHEN regexp_matches(path, '\.[^/]*$') OR path = '/' THEN '' ELSE '/' END AS url FROM p")
def url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("url"))


@slate(U + r"SELECT page_id, CASE WHEN path = '/' THEN 'home' WHEN host LIKE 'blog.%' THEN 'post' WHEN path LIKE '%.html' THEN 'document' WHEN host LIKE 'm.%' THEN 'mobile' ELSE 'landing' END AS kind FROM p")
def url_page_kind(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", urls.kind(F.col("url")).alias("kind"))


@slate(U + r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') AND host LIKE '%.example.com' THEN regexp_replace(url, '#.*$', '') END AS open_url, regexp_matches(url, '^https?://') AND host LIKE '%.example.com' AS can_open FROM p")
def url_sanitize(spark, sf_dir):
    found = urls.openable(F.col("url"), ".example.com")
    return read(spark, sf_dir, "pages").select("page_id", found.alias("open_url"), found.isNotNull().alias("can_open"))


@slate(U + "SELECT page_id, split_part(path, '/', 2) AS lang, host FROM p WHERE split_part(path, '/', 2) IN ('en', 'de') OR host LIKE '%.example.org'")
def country_noise_filter(spark, sf_dir):
    """Pages of other countries by path segment go, unless the host is ours."""
    u = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", F.element_at(F.split(urls.path(u), "/"), 2).alias("lang"), urls.host(u).alias("host")).filter("lang IN ('en', 'de') OR host LIKE '%.example.org'")


@slate(U + r", k AS (SELECT host, split_part(path, '/', 2) AS folder, coalesce(nullif(regexp_extract(path, '\.([a-z]+)$', 1), ''), 'none') AS ext FROM p) SELECT host, ext, count(*) AS n, count(DISTINCT folder) AS folders FROM k GROUP BY GROUPING SETS ((host, ext), (host), (ext), ())")
def folder_report(spark, sf_dir):
    """Counts by host and file extension with all subtotals."""
    u = F.col("url")
    ext = F.regexp_extract(urls.path(u), r"\.([a-z]+)$", 1)
    k = read(spark, sf_dir, "pages").select(urls.host(u).alias("host"), F.element_at(F.split(urls.path(u), "/"), 2).alias("folder"), F.when(ext == "", "none").otherwise(ext).alias("ext"))
    return k.groupingSets([["host", "ext"], ["host"], ["ext"], []], "host", "ext").agg(F.count("*").alias("n"), F.countDistinct("folder").alias("folders"))


@slate("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS heading FROM pages")
def html_title(spark, sf_dir):
    h = F.col("html")
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract(h, "<h1>([^<]*)</h1>", 1).alias("heading"))


@slate(r"SELECT page_id, sha1(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v]+', ' ', 'g'))) AS sha FROM pages")
def html_text(spark, sf_dir):
    """Visible text of well-formed pages."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?s)<(?:script|style)[^>]*>.*?</(?:script|style)>", " "), "<[^>]+>", " ")
    return read(spark, sf_dir, "pages").select("page_id", F.sha1(F.trim(F.regexp_replace(bare, r"[ \t\n\r\f\v]+", " "))).alias("sha"))


@slate(U + r""", l AS (SELECT host, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM p),
    a AS (SELECT host, CASE WHEN regexp_matches(href, '^[a-z]+:') THEN href WHEN starts_with(href, '//') THEN 'https:' || href WHEN starts_with(href, '/') THEN 'https://' || host || href ELSE 'https://' || host || '/' || href END AS target FROM l WHERE NOT regexp_matches(href, '^(#|mailto:|tel:|javascript:)'))
    SELECT host, target, count(*) AS n FROM a GROUP BY ALL""")
def crawl_links(spark, sf_dir):
    """Absolute targets of a host's links without in-page, mail, phone and script ones."""
    links = read(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("host"), F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("href")).filter(~F.col("href").rlike("^(#|mailto:|tel:|javascript:)"))
    base = F.concat(F.lit("https://"), "host")
    target = F.when(F.col("href").rlike("^[a-z]+:"), F.col("href")).when(F.startswith("href", F.lit("//")), F.concat(F.lit("https:"), "href")).when(F.startswith("href", F.lit("/")), F.concat(base, "href")).otherwise(F.concat(base, F.lit("/"), "href"))
    return links.select("host", target.alias("target")).groupBy("host", "target").agg(F.count("*").alias("n"))


LIST, PACKAGE = r"(?i)\b(list|all|every|with)\b", r"(?i)\b(package|detail|that)\b"


@slate(rf"SELECT conv_id, turn, CASE WHEN regexp_matches(text, '{LIST}') THEN 12 WHEN regexp_matches(text, '{PACKAGE}') THEN 8 ELSE 5 END AS max_returned, CASE WHEN regexp_matches(text, '{LIST}') THEN 10 ELSE 2 END AS max_per_url, CASE WHEN regexp_matches(text, '{LIST}') THEN 40 ELSE 20 END AS top_k FROM conversations WHERE role = 'user'")
def dynamic_limits(spark, sf_dir):
    """Limits of a question by what it asks for."""
    wide, package = F.col("text").rlike(LIST), F.col("text").rlike(PACKAGE)
    asked = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return asked.select("conv_id", "turn", F.when(wide, 12).when(package, 8).otherwise(5).alias("max_returned"), F.when(wide, 10).otherwise(2).alias("max_per_url"), F.when(wide, 40).otherwise(20).alias("top_k"))


FAMILIES = {"website": r"(?i)\b(site|page|with)\b", "drive": r"(?i)\b(file|sheet|was)\b", "chat": r"(?i)\b(chat|group|for)\b"}


@slate("WITH f AS (SELECT conv_id, turn, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in FAMILIES.items()) + "], lambda x: x IS NOT NULL) AS l FROM conversations WHERE role = 'user') SELECT conv_id, turn, CASE WHEN len(l) = 1 THEN l[1] ELSE 'all' END AS family FROM f")
def source_intent(spark, sf_dir):
    """The one family a question names; none or several mean all."""
    named = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), n) for n, p in FAMILIES.items())))
    return read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", F.when(F.size(named) == 1, F.get(named, F.lit(0))).otherwise("all").alias("family"))


@slate("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)\\bcompare|versus|ingea') THEN 'compare' WHEN regexp_matches(text, '(?i)how many|\\bwas\\b') THEN 'count' WHEN length(text) < 120 THEN 'short' ELSE 'vector' END AS route FROM conversations WHERE role = 'user'")
def route_questions(spark, sf_dir):
    t = F.col("text")
    route = F.when(t.rlike(r"(?i)\bcompare|versus|ingea"), "compare").when(t.rlike(r"(?i)how many|\bwas\b"), "count").when(F.length(t) < 120, "short").otherwise("vector")
    return read(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", route.alias("route"))


@slate("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
    SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || left(text, 200), chr(10) ORDER BY turn) AS history FROM r WHERE n <= 4 AND role IN ('user', 'assistant') GROUP BY conv_id""")
def history_last4(spark, sf_dir):
    """The last four turns, then those of users and assistants, cut to 200 characters each."""
    last = rows.numbered(read(spark, sf_dir, "conversations"), "n", ["conv_id"], F.desc("turn")).filter("n <= 4 AND role IN ('user', 'assistant')")
    said = F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 200)).alias("t"))
    return last.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["t"]), "\n").alias("history"))


@slate("""WITH p AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations)
    SELECT conv_id, turn, CASE WHEN prior IS NOT NULL AND length(text) < 300 THEN left(prior, 300) || chr(10) || text ELSE text END AS search_text FROM p WHERE role = 'user'""")
def search_text(spark, sf_dir):
    """Short follow-ups are searched with the user's turn before."""
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    seen = read(spark, sf_dir, "conversations").withColumn("prior", F.last(F.when(F.col("role") == "user", F.col("text")), True).over(before)).filter("role = 'user'")
    return seen.select("conv_id", "turn", F.when(F.col("prior").isNotNull() & (F.length("text") < 300), F.concat(F.substring("prior", 1, 300), F.lit("\n"), "text")).otherwise(F.col("text")).alias("search_text"))


@slate("""WITH n AS (SELECT *, lead(role) OVER w AS r2, lead(text) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text AS question, t2 AS answer FROM n WHERE role = 'user' AND r2 = 'assistant'""")
def faq_pairs(spark, sf_dir):
    """Questions with the answer that follows."""
    found = timelines.followed(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", F.col("role") == "user", F.col("role") == "assistant", "text")
    return found.select("conv_id", "turn", F.col("text").alias("question"), F.col("next_value").alias("answer"))


#: Where the public vocabulary files are; read by the driver only.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def bpe_chunks(spark, sf_dir):
    """Windows of 400 tokens that overlap by 80 over whole documents; tested against a loop over ids."""
    cut = sections.bpe_windows(spark, f"{TOKENIZERS}/byte_bpe_50k.json", CHUNK, OVERLAP)
    found = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut(F.col("text"))).alias("chunk_index", "w"))
    return found.select("doc_id", "chunk_index", "w.start", "w.end", "w.tokens", F.sha1("w.text").alias("sha"))


QUERIES, ORACLES = slate.queries | {"bpe_chunks": bpe_chunks}, slate.oracles
