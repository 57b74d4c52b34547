"""Retrieval steps over questions and chunks made of the tables, by the rules of config; SQL has the same expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight import config as c
from quarrylight.engine import HashedBag
from quarrylight.functions import predicates as p
from quarrylight.operators import retrieval as r
from quarrylight.operators import rows
from quarrylight.operators.vectors import top_k_of_copies
from quarrylight.plans import Slate, read

slate = Slate()


def case(n: str, values: list[str]) -> str:
    """An expression of both dialects: the value at a number, values being expressions themselves."""
    return f"CASE {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


CODE = "CAST(1000 + {} % 50 AS STRING)"
CHUNK = {
    "chunk_id": "CAST(doc_id AS STRING)",
    "source_url": "concat('https://www.example.com', " + case("doc_id % 7", ["'/hk/'", "'/sg'", "'/product-details/alpha'", "'/product-details/beta/'", "'/services/visa/x'", "'/blog/post'", "'/hong-kong/setup'"]) + ")",
    "source_type": case("doc_id % 4", ["'website'", "'drive'", "'blog'", "'whatsapp'"]),
    "page_kind": case("doc_id % 5", ["'product_detail'", "'country_overview'", "''", "'service_landing'", "'post'"]),
    "doc_title": case("doc_id % 6", ["'Pricing Master'", "'Hong Kong overview'", "'Singapore setup'", "'Package A'", "'Payments'", "'Notes'"]),
    "heading_path": case("doc_id % 9", ["'FAQ'", "'compare'", "'Compare > Tax'", "'compare > Tax > VAT'", "'documents_required'", "'introduction'", "'selling_points'", "'top_packages > A'", "'pricing'"]),
    "chunk_text": case("doc_id % 8", [f"concat('Title: Corporate Compliance and Tax Services', chr(10), 'Service code PM', {CODE.format('doc_id')})", "'We use Stripe as payment gateway'", f"concat('x', chr(10), 'Title: Annual Licence Renewal Support ', chr(10), 'Authority fee 100, pm-', {CODE.format('doc_id')})"] + ["coalesce(text, '')"] * 4 + [f"concat('see PM ', {CODE.format('doc_id')})"]),
}
QUESTION = case("(conv_id + turn) % 14", [
    f"concat('What is the fee for PM', {CODE.format('conv_id')}, '?')", "'Price of Corporate Compliance and Tax Services please'", "'list all packages for Singapore'", "'compare Hong Kong vs Singapore corporate tax'",
    "'documents required for package detail page'", "'show the faqs for Hong Kong'", f"concat('Tell me about PM-', {CODE.format('conv_id')}, ' and its process')", "'annual licence renewal support: what is it'",
    "'key selling points'", "coalesce(text, '')", "'how many packages are there in Singapore?'", "'package detail: introduction, highlights, FAQ'", "'what about the cost?'", "concat('first line on packages', chr(10), 'on the website: faqs in the UK')",
])
PRIOR = case("conv_id % 3", ["''", "'Setting up in Cyprus from the google drive'", "' Visa for Ireland '"])
#: Places of the hashed words that candidates are searched by.
DIM = 64
MADE = f"""
    WITH chunks AS (SELECT doc_id, {', '.join(f'{e} AS {k}' for k, e in CHUNK.items())} FROM documents),
    questions AS (SELECT conv_id * 100 + turn AS query_id, {QUESTION} AS question, {PRIOR} AS prior FROM conversations WHERE role = 'user'),
    texts AS (SELECT 0 AS kind, doc_id AS id, chunk_text AS t FROM chunks UNION ALL SELECT 1, query_id, question FROM questions),
    words AS (SELECT kind, id, ('0x' || md5(w)[1:8])::BIGINT AS h FROM (SELECT kind, id, unnest(regexp_split_to_array(lower(t), '[\\x20\\x09-\\x0D]+')) AS w FROM texts) WHERE w <> ''),
    cells AS (SELECT kind, id, h % {DIM} AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM words GROUP BY ALL),
    norms AS (SELECT kind, id, sqrt(sum(v * v)) AS norm FROM cells GROUP BY ALL HAVING norm > 0),
    near AS (SELECT q.id AS query_id, d.id AS doc_id, round(sum(d.v / dn.norm * (q.v / qn.norm)), 6) AS score FROM cells d JOIN norms dn ON dn.kind = 0 AND dn.id = d.id JOIN cells q ON q.place = d.place AND q.kind = 1 JOIN norms qn ON qn.kind = 1 AND qn.id = q.id WHERE d.kind = 0 GROUP BY ALL),
    matches AS (SELECT query_id, question, c.*, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 20) JOIN chunks c USING (doc_id) JOIN questions USING (query_id)),
"""


def chunks_of(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", *(F.expr(e).alias(k) for k, e in CHUNK.items()))


def questions_of(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").filter("role = 'user'").select(F.expr("conv_id * 100 + turn").alias("query_id"), F.expr(QUESTION).alias("question"), F.expr(PRIOR).alias("prior"))


def nearest_of(spark, sf_dir, questions: DataFrame) -> DataFrame:
    """(query_id, doc_id, score, rank): the twenty nearest of all chunks to each of the questions, by their words."""
    embedder, chunks = HashedBag(DIM, unit=False), chunks_of(spark, sf_dir)
    made = embedder.embed_texts(chunks.select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("label"), "chunk_text"), "chunk_text")
    asked = embedder.embed_texts(questions.select("query_id", F.lit(0).alias("query_label"), "question"), "question").withColumnRenamed("embedding", "query")
    return top_k_of_copies(made, asked, 20).select("query_id", F.col("vec_id").alias("doc_id"), "score", "rank")


def matches_of(spark, sf_dir) -> DataFrame:
    """Candidates of every question: the twenty nearest of all chunks by their words."""
    once, every = r.asked_once(questions_of(spark, sf_dir), "question")
    near = r.spread(nearest_of(spark, sf_dir, once), every)
    return near.join(chunks_of(spark, sf_dir), "doc_id").select("query_id", "doc_id", *r.CHUNK, "score", "rank")


def stepped(spark, sf_dir, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a step makes of the candidates of every question; equal questions take it once, and only facts of the chunks' texts go along."""
    once, every = r.asked_once(questions_of(spark, sf_dir), "question")
    chunks = r.known(chunks_of(spark, sf_dir)).drop("chunk_text")
    found = nearest_of(spark, sf_dir, once).join(chunks, "doc_id").withColumn("lexical", F.lit(False)).join(r.asked(once), "query_id")
    return r.spread(step(r.described(found)), every)


def has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def cues(column: str, table) -> str:
    return "flatten([" + ", ".join(f"CASE WHEN {has(column, pattern)} THEN [{', '.join(map(repr, labels))}] ELSE [] END" for pattern, labels in table) + "])"


LAST = "coalesce(list_filter(string_split(question, chr(10)), lambda x: trim(x) <> '')[-1], '')"


def codes(column: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({column}, '{c.SERVICE_CODE}', 1), lambda x: 'PM' || x))"


TITLE = f"trim(regexp_extract(chunk_text, '{c.ROW_TITLE}', 1))"
ALL = "[" + ", ".join(map(repr, c.CATALOG_SECTIONS)) + "]"
ASKED = f"""
    asked AS (SELECT query_id, question, {has('question', c.FEE_QUERY)} AS fee, {has('question', c.PACKAGE_INTENT)} AS package, {has('question', c.DOCUMENTS_QUERY)} AS documents, {has('question', c.LIST_INTENT)} AS wide,
        {codes('question')} AS codes, CASE WHEN len({cues(LAST, c.SECTION_CUES)}) > 0 THEN list_distinct({cues(LAST, c.SECTION_CUES)}) WHEN len({cues('question', c.SECTION_CUES)}) > 0 THEN list_distinct({cues('question', c.SECTION_CUES)}) ELSE {ALL} END AS targets,
        list_distinct({cues('question', c.COUNTRY_CUES)}) AS countries, prior FROM questions),
"""
PRICING = f"({has('doc_title', c.PRICING_TITLE)} OR {has('heading_path', c.PRICING_TITLE)} OR {has('chunk_text', c.PRICING_ROW)})"
BLOB = "doc_title || ' ' || heading_path || ' ' || chunk_text"
ROOT = "lower(trim(split_part(heading_path, '>', 1)))"
PATH = "regexp_replace(regexp_extract(source_url, '^https?://[^/]*([^?#]*)', 1), '/+$', '')"
COUNTRY = f"""(len(countries) = 0 OR len(list_filter(countries, lambda t: CASE WHEN length(t) <= 3 AND regexp_matches(t, '^[a-z]+$') THEN list_contains(string_split(lower({PATH}), '/'), t)
    ELSE contains(lower(doc_title) || ' ' || lower(source_url), t) END)) > 0)"""
DESCRIBED = MADE + ASKED + f"""
    described AS (SELECT m.*, a.* EXCLUDE (query_id, question), {PRICING} AS pricing, NOT {PRICING} AND {has(BLOB, c.VENDOR_NOISE)} AS noise, page_kind = 'product_detail' OR contains(lower(source_url), '/product-details/') AS detail,
        {ROOT} AS root, len(list_intersect(codes, {codes(BLOB)})) > 0 AS code_hit, length({TITLE}) AS title_length, length({TITLE}) >= 20 AND contains(lower(m.question), lower({TITLE})) AS title_hit,
        (page_kind IN ('country_overview', 'product_detail', 'service_landing') OR source_type IN ('website', '')) AND list_contains(targets, {ROOT}) AS section, {COUNTRY} AS country_hit
        FROM matches m JOIN asked a USING (query_id))
"""


@slate(MADE + ASKED[:-2] + f"""
    SELECT query_id, fee, package, documents, wide, array_to_string(list_sort(codes), ',') AS codes, array_to_string(list_sort(targets), ',') AS targets, array_to_string(list_sort(countries), ',') AS countries,
        {has('question', c.ELLIPTICAL)} AS elliptical, {has('question', c.COMPARE_QUERY)} AS compare, {has('question', c.SERVICE_COUNT)} AS service_count, {has('question', c.LOCATION_COUNT)} AS location_count,
        greatest(CASE WHEN wide THEN 12 ELSE 5 END, CASE WHEN package THEN 12 ELSE 0 END) AS max_returned, greatest(CASE WHEN wide THEN 10 ELSE 2 END, CASE WHEN package THEN 8 ELSE 0 END) AS max_per_url, greatest(CASE WHEN wide THEN 40 ELSE 20 END, CASE WHEN package THEN 40 ELSE 0 END) AS top_k FROM asked""")
def question_facts(spark, sf_dir):
    """What a question asks for, and its limits."""
    q = F.col("question")
    joined = lambda name: F.array_join(F.array_sort(name), ",").alias(name)
    more = p.elliptical(q).alias("elliptical"), p.compare_question(q).alias("compare"), p.service_count_question(q).alias("service_count"), p.location_count_question(q).alias("location_count")
    return r.asked(questions_of(spark, sf_dir)).select("query_id", "fee", "package", "documents", "wide", joined("codes"), joined("targets"), joined("countries"), *more, "max_returned", "max_per_url", "top_k")


@slate(DESCRIBED + "SELECT query_id, doc_id, pricing, noise, detail, root, code_hit, title_length, title_hit, section, country_hit FROM described")
def candidate_facts(spark, sf_dir):
    """What a candidate is, and how it fits its question."""
    return stepped(spark, sf_dir, lambda df: df.select("query_id", "doc_id", "pricing", "noise", "detail", "root", "code_hit", "title_length", "title_hit", "section", "country_hit"))


def _said(family: str) -> str:
    return has("t", c.SOURCE_CUES[family])


@slate(MADE + f"""q AS (SELECT query_id, trim(question) AS q, trim(prior) AS prior, CASE query_id % 5 WHEN 0 THEN 'blog' WHEN 1 THEN 'drive' ELSE 'all' END AS given FROM questions),
    t AS (SELECT *, CASE WHEN length(q) >= 12 OR {' OR '.join(has('q', x) for x in c.SOURCE_CUES.values())} OR prior = '' OR q = '' THEN q ELSE prior || chr(10) || q END AS t FROM q),
    f AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {_said(n)} THEN '{n}' END" for n in c.SOURCE_CUES)}], lambda x: x IS NOT NULL) AS f FROM t)
    SELECT query_id, CASE WHEN given = 'blog' THEN 'website' WHEN given <> 'all' THEN given WHEN {has('t', c.FORCE_ALL)} THEN 'all' WHEN len(f) = 1 THEN f[1] ELSE 'all' END AS source,
        CASE WHEN {has('q', c.COMPARE_QUERY)} THEN 'compare' WHEN {has('q', r'(?i)singapore|hong kong')} AND {has('q', c.LOCATION_COUNT)} THEN 'location_count' WHEN {has('q', c.SERVICE_COUNT)} THEN 'service_count' ELSE 'retrieve' END AS route,
        CASE WHEN {has('q', c.ELLIPTICAL)} AND prior <> '' THEN left(prior, 300) || chr(10) || q ELSE q END AS search_text FROM f""")
def question_routes(spark, sf_dir):
    """Source, path and search text of a question with the turn before it."""
    q = questions_of(spark, sf_dir)
    client = F.when(F.col("query_id") % 5 == 0, "blog").when(F.col("query_id") % 5 == 1, "drive").otherwise("all")
    known = F.col("question").rlike(r"(?i)singapore|hong kong")
    return q.select("query_id", r.resolved_source(F.col("question"), client, F.col("prior")).alias("source"), r.route(F.trim("question"), known).alias("route"), r.search_text(F.col("question"), F.col("prior")).alias("search_text"))


@slate(MADE + ASKED + f"""index AS (SELECT doc_id, chunk_id, unnest({codes(BLOB)}) AS code FROM chunks),
    hits AS (SELECT query_id, chunk_id, min(code) AS code FROM (SELECT query_id, unnest(codes) AS code FROM asked) JOIN index USING (code) GROUP BY ALL)
    SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY code, chunk_id))::INT AS pos FROM hits""")
def lexical_code_join(spark, sf_dir):
    """Every chunk that has a code of the question."""
    return r.code_ids(r.asked(questions_of(spark, sf_dir)), r.index_codes(chunks_of(spark, sf_dir)))


@slate(MADE + f"""t AS (SELECT chunk_id, lower({TITLE}) AS t FROM chunks)
    SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id ORDER BY length(t) DESC, chunk_id))::INT AS pos FROM questions, t WHERE length(t) >= 20 AND contains(lower(question), t)""")
def lexical_title_join(spark, sf_dir):
    """Every chunk whose title the question contains."""
    return r.title_ids(questions_of(spark, sf_dir), chunks_of(spark, sf_dir))


def _final(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "doc_id", "rank", *more)


@slate(DESCRIBED + """, e AS (SELECT *, bool_or(code_hit) OVER (PARTITION BY query_id) AS exact FROM described)
    SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY (exact AND code_hit) DESC, rank))::INT AS rank FROM e WHERE NOT exact OR code_hit OR NOT (fee OR pricing)""")
def lexical_merge(spark, sf_dir):
    """Rows with a code of the question first, and which others stay."""
    return stepped(spark, sf_dir, lambda df: _final(r.prefer_codes(df)))


@slate(DESCRIBED + """, o AS (SELECT *, bool_and(noise) OVER (PARTITION BY query_id) AS all_noise FROM described)
    SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fee AND NOT package AND NOT pricing THEN 1 ELSE 0 END, CASE WHEN fee AND NOT package THEN -score ELSE 0 END, rank))::INT AS rank
    FROM o WHERE NOT (fee AND NOT package) OR NOT noise OR all_noise""")
def fee_focus(spark, sf_dir):
    return stepped(spark, sf_dir, lambda df: _final(r.fee_focus(df)))


@slate(DESCRIBED + """, t AS (SELECT *, bool_or(title_hit) OVER (PARTITION BY query_id) AS titled FROM described)
    SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY (NOT package AND title_hit) DESC, CASE WHEN NOT package AND title_hit THEN -title_length ELSE 0 END, rank))::INT AS rank
    FROM t WHERE NOT (NOT package AND fee AND titled) OR title_hit""")
def title_boost(spark, sf_dir):
    return stepped(spark, sf_dir, lambda df: _final(r.title_boost(df)))


@slate(DESCRIBED + """, g AS (SELECT *, package AND pricing AND NOT detail AS gone FROM described), k AS (SELECT *, bool_and(gone) OVER (PARTITION BY query_id) AS all_gone FROM g),
    u AS (SELECT *, CASE WHEN package AND detail THEN least(0.99, score + 0.22) ELSE score END AS s FROM k WHERE NOT gone OR all_gone),
    b AS (SELECT *, CASE WHEN package AND detail AND documents AND root IN ('documents_required', 'documents', 'documents_from_authority', 'more_about_required_documents') THEN least(0.99, s + 0.18) WHEN package AND detail AND documents AND root IN ('faq', 'faqs') THEN greatest(0.01, s - 0.12) ELSE s END AS b FROM u)
    SELECT query_id, doc_id, round(b, 6) AS boosted, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN package THEN -b ELSE 0 END, rank))::INT AS rank FROM b""")
def package_focus(spark, sf_dir):
    return stepped(spark, sf_dir, lambda df: r.package_focus(df).select("query_id", "doc_id", F.round("score", 6).alias("boosted"), "rank"))


@slate(DESCRIBED + """, h AS (SELECT *, wide AND NOT package AND section AND country_hit AS hit FROM described),
    u AS (SELECT *, CASE WHEN hit THEN least(0.99, score + 0.18) ELSE score END AS s, bool_or(hit) OVER (PARTITION BY query_id) AS any_hit, hit AND list_contains(targets, 'compare') AND root = 'compare' AS cmp, len(regexp_extract_all(heading_path, '>')) AS deep FROM h),
    b AS (SELECT *, CASE WHEN cmp AND deep = 0 THEN least(0.99, s + 0.35) WHEN cmp AND deep = 1 THEN least(0.99, s + 0.28) WHEN cmp THEN greatest(0.01, s - 0.08) ELSE s END AS b FROM u),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN any_hit THEN -b ELSE 0 END, rank) AS n FROM b)
    SELECT query_id, doc_id, round(b, 6) AS boosted, n::INT AS rank FROM k WHERE NOT (wide AND NOT package AND len(countries) > 0 AND section AND NOT country_hit)""")
def catalog_focus(spark, sf_dir):
    """Wanted sections rise; those of other countries go."""
    return stepped(spark, sf_dir, lambda df: r.country_filter(r.catalog_boost(df)).select("query_id", "doc_id", F.round("score", 6).alias("boosted"), "rank"))


@slate(DESCRIBED + f", g AS (SELECT query_id, doc_id, score >= {c.MIN_SCORE} OR code_hit OR title_hit AS kept FROM described) SELECT query_id, doc_id FROM g WHERE kept")
def score_gate(spark, sf_dir):
    """Enough score, or a code or title of the question."""
    return stepped(spark, sf_dir, lambda df: r.gate(df).select("query_id", "doc_id"))


@slate(DESCRIBED + """, p AS (SELECT *, package AND detail AND root IN ('introduction', 'highlights_and_benefits', 'highlights', 'process_flow', 'faqs', 'faq', 'terms_and_conditions', 'terms', 'pricing', 'documents', 'documents_required', 'documents_from_authority') AS first, rtrim(lower(source_url), '/') AS page FROM described),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id, first, page, root ORDER BY rank) AS n FROM p),
    k AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY (package AND NOT first), rank))::INT AS r FROM n WHERE NOT first OR n = 1)
    SELECT query_id, doc_id, r AS rank FROM k WHERE NOT package OR r <= 36""")
def package_sections(spark, sf_dir):
    """One row an address and section of package questions, then the rest."""
    return stepped(spark, sf_dir, lambda df: _final(r.package_sections(df)))


@slate(DESCRIBED + """, k AS (SELECT *, NOT package AND (code_hit OR title_hit OR (wide AND section AND country_hit)) AS kept, row_number() OVER (PARTITION BY query_id, source_url ORDER BY rank) AS n,
        greatest(CASE WHEN wide THEN 12 ELSE 5 END, CASE WHEN package THEN 12 ELSE 0 END) AS most, greatest(CASE WHEN wide THEN 10 ELSE 2 END, CASE WHEN package THEN 8 ELSE 0 END) AS per FROM described),
    f AS (SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS position, most FROM k WHERE kept OR n <= per)
    SELECT query_id, doc_id, position FROM f WHERE position <= most""")
def protected_caps(spark, sf_dir):
    """Caps by address and in all, with protected rows."""
    return stepped(spark, sf_dir, lambda df: r.capped(df).select("query_id", "doc_id", "position"))


def retrieve_questions(spark, sf_dir):
    """The whole pipeline over all questions; tested against a loop over lists."""
    # texts are looked through once; what is left of them tells chunks without an id apart
    chunks = rows.stored(r.known(chunks_of(spark, sf_dir)).withColumn("chunk_text", F.substring("chunk_text", 1, r.KEY_CHARS)))
    q = questions_of(spark, sf_dir).select("query_id", "question", r.search_text(F.col("question"), F.col("prior")).alias("search_text"))
    once, every = r.asked_once(q, "question", "search_text")
    near = nearest_of(spark, sf_dir, once).join(chunks, "doc_id").select("query_id", *r.CHUNK, *r.FACTS, "score", "rank")
    found = r.retrieve(once, near, chunks).select("query_id", "position", "chunk_id", F.round("score", 6).alias("score"), "lexical")
    return r.spread(found, every)


QUERIES, ORACLES = slate.queries | {"retrieve_questions": retrieve_questions}, slate.oracles
