"""Evaluation over the tables: benchmark passages as cases, documents as what was found."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight import config
from quarrylight.functions import text
from quarrylight.operators import evaluation as e
from quarrylight.plans import Slate, read

slate = Slate()

REFS = "CASE WHEN item_id % 4 = 3 THEN [] ELSE ['https://www.example.com/' || (item_id % 5)::VARCHAR, ' '] END"
FOUND = "SELECT doc_id % 50 AS case_id, doc_id // 50 + 1 AS rank, 'https://www.example.com/' || (doc_id % 7)::VARCHAR || '/x' AS url, coalesce(text, '') AS text FROM documents WHERE doc_id % 50 % 6 <> 5"


def cases_of(spark, sf_dir):
    i = F.col("item_id")
    refs = F.when(i % 4 == 3, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://www.example.com/"), (i % 5).cast("string")), F.lit(" ")))
    needles = F.when(i % 3 == 2, None).otherwise(F.array(F.lit("The"), F.lit("the\nth"), F.lit("e"), F.substring("text", 1, 5)))
    return read(spark, sf_dir, "benchmark").select(i.alias("case_id"), F.col("text").alias("query"), refs.alias("refs"), needles.alias("needles"), F.array(F.lit("tion"), F.lit("THE")).alias("must"), F.when(i % 2 == 0, F.array(F.lit("zzz"), F.lit("un"))).alias("forbid"), F.array(F.concat(F.lit("t"), (i % 3).cast("string")), F.lit("all")).alias("tags"))


def found_of(spark, sf_dir):
    d = F.col("doc_id")
    return read(spark, sf_dir, "documents").filter("doc_id % 50 % 6 <> 5").select((d % 50).alias("case_id"), F.expr("doc_id div 50 + 1").alias("rank"), F.concat(F.lit("https://www.example.com/"), (d % 7).cast("string"), F.lit("/x")).alias("url"), F.coalesce("text", F.lit("")).alias("text"))


CASES = f"""WITH cases AS (SELECT item_id AS case_id, text AS query, {REFS} AS refs, CASE WHEN item_id % 3 = 2 THEN NULL ELSE ['The', 'the' || chr(10) || 'th', 'e', left(text, 5)] END AS needles FROM benchmark),
    found AS ({FOUND}),
    hits AS (SELECT case_id, max((len(list_filter(refs, lambda r: trim(r) <> '' AND starts_with(url, r))) > 0)::INT)::DOUBLE AS hit FROM found JOIN cases USING (case_id) WHERE rank <= 5 GROUP BY case_id),
    context AS (SELECT case_id, lower(string_agg(text, chr(10) ORDER BY rank)) AS c FROM found WHERE rank <= 5 GROUP BY case_id),
    scored AS (SELECT case_id, query, CASE WHEN len(refs) > 0 THEN coalesce(hit, 0) END AS hit, CASE WHEN needles IS NOT NULL THEN len(list_filter(needles, lambda n: trim(n) <> '' AND contains(coalesce(c, ''), lower(trim(n))))) / len(list_filter(needles, lambda n: trim(n) <> '')) END AS recall
        FROM cases LEFT JOIN hits USING (case_id) LEFT JOIN context USING (case_id))
"""


@slate(CASES + "SELECT case_id, hit::DOUBLE AS hit, round(recall, 9) AS recall FROM scored")
def eval_recall(spark, sf_dir):
    """Hit at five by reference prefixes and recall of needles; null where a case asks for neither."""
    cases, found = cases_of(spark, sf_dir), found_of(spark, sf_dir)
    return e.hit_at_k(cases, found).join(e.context_recall(cases, found), "case_id").select("case_id", "hit", F.round("recall", 9).alias("recall"))


@slate(CASES + """, tagged AS (SELECT 't' || (case_id % 3)::VARCHAR AS tag, hit, recall FROM scored UNION ALL SELECT 'all', hit, recall FROM scored UNION ALL SELECT 'overall', hit, recall FROM scored)
    SELECT tag, count(*) AS cases, round(avg(hit), 9) AS hit, round(avg(recall), 9) AS recall FROM tagged GROUP BY tag""")
def eval_means(spark, sf_dir):
    """A run over all cases, with means by tag and overall."""
    scored = e.run(cases_of(spark, sf_dir), lambda _: found_of(spark, sf_dir))
    return e.means(scored, ["hit", "recall"]).select("tag", "cases", F.round("hit", 9).alias("hit"), F.round("recall", 9).alias("recall"))


@slate("""WITH u AS (SELECT DISTINCT url FROM pages), r AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]*/[^/]*)', 1) AS ref FROM pages)
    SELECT url, count(*) AS refs FROM u JOIN r ON starts_with(url, ref) GROUP BY url""")
def url_prefix_join(spark, sf_dir):
    """Addresses with the references that they go on from; references are cut at a slash, so that the address's first two parts are the key."""
    key = lambda c: F.regexp_extract(c, "^(https?://[^/]*/[^/]*)", 1)
    u = read(spark, sf_dir, "pages").select("url").distinct()
    r = read(spark, sf_dir, "pages").select(key(F.col("url")).alias("ref")).distinct()
    # every reference that an address starts with is the beginning of its first segment: all of them are keys
    first = F.regexp_extract("url", "^(https?://[^/]*/)", 1)
    keys = F.transform(F.sequence(F.length(first), F.length(key(F.col("url")))), lambda n: F.substring(F.col("url"), F.lit(1), n))
    return u.select("url", F.explode(keys).alias("ref")).join(r, "ref").groupBy("url").agg(F.count("*").alias("refs"))


NAMES = "regexp_replace(lower(id), '[^a-z0-9%]+', ' ', 'g')"


@slate(f"""WITH d AS (SELECT DISTINCT p_type AS id FROM part), n AS (SELECT id, list_distinct(list_filter(string_split(trim({NAMES}), ' '), lambda t: length(t) > 2 AND t NOT IN ('the', 'and', 'for', 'with', 'that'))) AS t FROM d)
    SELECT a.id AS left_id, b.id AS right_id FROM n a, n b WHERE len(list_intersect(a.t, b.t)) >= greatest(1, (least(len(a.t), len(b.t)) + 1) // 2)""")
def token_overlap_join(spark, sf_dir):
    """Names of types that share half of the shorter one's words."""
    n = read(spark, sf_dir, "part").select(F.col("p_type").alias("id"), F.col("p_type").alias("name")).distinct()
    return e.overlapping(n, n)


@slate("""WITH a AS (SELECT item_id AS case_id, CASE WHEN item_id % 7 <> 3 THEN text END AS answer FROM benchmark)
    SELECT case_id, len(list_filter(['tion', 'the'], lambda n: contains(lower(coalesce(answer, '')), n))) / 2 AS included, CASE WHEN case_id % 2 = 0 THEN (len(list_filter(['zzz', 'un'], lambda n: contains(lower(coalesce(answer, '')), n))) = 0)::INT::DOUBLE END AS forbidden_ok FROM a""")
def eval_answers(spark, sf_dir):
    """What answers must include, and what they must not."""
    answers = read(spark, sf_dir, "benchmark").filter("item_id % 7 <> 3").select(F.col("item_id").alias("case_id"), F.col("text").alias("answer"))
    return e.answer_measures(cases_of(spark, sf_dir), answers)


M = "trim(regexp_replace(lower({}), '[^a-z0-9%]+', ' ', 'g'))"
WORDS = "list_slice(list_filter(string_split({}, ' '), lambda t: length(t) > 2), 1, 8)"


@slate(f"""WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 9 = 5 THEN 'I could not find that' ELSE coalesce(text, '') || CASE WHEN doc_id % 4 = 0 THEN ' in Singapore' ELSE '' END END AS answer, [coalesce(text, ''), 'the thing and the other one', 'no', 'x y', source || ' of the ' || lang] AS phrases FROM documents),
    p AS (SELECT *, {M.format('coalesce(answer, chr(32))')} AS a, list_filter(list_transform(phrases, lambda f: {M.format('f')}), lambda f: length(f) >= 4 AND len({WORDS.format('f')}) > 0) AS asked FROM d),
    c AS (SELECT *, CASE WHEN len(asked) = 0 THEN 1 ELSE len(list_filter(asked, lambda f: contains(a, f) OR len(list_filter({WORDS.format('f')}, lambda w: contains(a, w))) >= greatest(1, round_even(len({WORDS.format('f')}) * 0.7, 0)::INT))) / len(asked) END AS covered, CASE WHEN contains(' ' || a || ' ', ' singapore ') THEN ['Singapore'] ELSE [] END AS leaked FROM p)
    SELECT doc_id, source, round(covered, 9) AS covered, len(leaked)::INT AS leaked, CASE WHEN answer IS NULL THEN 'N/A' WHEN length(answer) < 220 AND contains(lower(answer), 'could not find') THEN 'FAIL' WHEN len(leaked) > 0 THEN CASE WHEN covered < 0.5 THEN 'FAIL' ELSE 'PARTIAL' END WHEN covered >= 0.75 THEN 'PASS' WHEN covered >= 0.4 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM c""")
def eval_verdicts(spark, sf_dir):
    """Coverage of phrases, countries that leak, and the verdict on every answer."""
    answer = F.expr("CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 9 = 5 THEN 'I could not find that' ELSE concat(coalesce(text, ''), CASE WHEN doc_id % 4 = 0 THEN ' in Singapore' ELSE '' END) END")
    phrases = F.array(F.expr("coalesce(text, '')"), F.lit("the thing and the other one"), F.lit("no"), F.lit("x y"), F.concat("source", F.lit(" of the "), "lang"))
    d = read(spark, sf_dir, "documents").select("doc_id", "source", answer.alias("answer"), phrases.alias("phrases"))
    d = d.withColumn("plain", text.matchable(F.col("answer")))
    d = d.withColumn("covered", e.coverage(F.col("plain"), F.col("phrases"), plain=True)).withColumn("leaked", e.leaks(F.col("plain"), F.array(F.lit("Singapore"), F.lit("Hong Kong")), F.array(F.lit("Hong Kong")), plain=True))
    return d.select("doc_id", "source", F.round("covered", 9).alias("covered"), F.size("leaked").alias("leaked"), e.verdict(F.col("answer"), F.col("covered"), F.col("leaked"), F.lit(False)).alias("verdict"))


@slate("""WITH v AS (SELECT source, CASE doc_id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'FAIL' ELSE 'N/A' END AS verdict FROM documents),
    t AS (SELECT source, count(*) FILTER (verdict = 'PASS') AS passed, count(*) FILTER (verdict = 'PARTIAL') AS partly, count(*) FILTER (verdict = 'FAIL') AS failed, count(*) FILTER (verdict = 'N/A') AS ungraded, round(avg(CASE WHEN verdict <> 'N/A' THEN (verdict = 'PASS')::INT END), 9) AS pass_rate FROM v GROUP BY source)
    SELECT *, failed + 0.5::DOUBLE * partly AS weight, (row_number() OVER (ORDER BY failed + 0.5 * partly DESC, passed, source))::INT AS place FROM t""")
def eval_worst_first(spark, sf_dir):
    """Verdicts by source, the worst first."""
    v = F.expr("CASE doc_id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN 'PASS' WHEN 2 THEN 'PARTIAL' WHEN 3 THEN 'FAIL' ELSE 'N/A' END")
    return e.verdict_table(read(spark, sf_dir, "documents").select("source", v.alias("verdict")), "source").withColumn("pass_rate", F.round("pass_rate", 9))


PACKAGES = ["'Gold Visa Package'", "'Golden visa for investors'", "'gold-visa'", "'Company setup in a Free Zone'", "'Free Zone licence (company formation)'", "''", "'the and for'", "'Visa renewal, family'"]
SERVICES = ["'Visa Services'", "'Funds'", "'Fund administration'", "'Licence'", "'business-setup (UAE)'", "''", "'visa'"]
SECTIONS = ["'introduction'", "'FAQs > Who'", "'faqs'", "'pricing'", "NULL", "'documents_required'", "'faqs > What'"]


def _pick(n: str, values: list[str]) -> str:
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_PLAIN = "trim(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'))"
_TELLING = "list_distinct(list_filter(string_split({}, ' '), lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(map(repr, config.PACKAGE_STOPS)) + "], w)))"
_FAMILY = " OR ".join(f"(regexp_matches(es, '{'|'.join(w)}') AND regexp_matches(fs, '{'|'.join(w)}'))" for w in config.SERVICE_FAMILIES)


@slate(f"""
    WITH cases AS (SELECT doc_id // 4 AS case_id, {_pick('(doc_id // 4)', SERVICES)} AS service, {_pick('(doc_id // 4 * 3)', PACKAGES)} AS package, coalesce(text, '') AS answer FROM documents WHERE doc_id % 4 = 0),
    found AS (SELECT doc_id // 4 AS case_id, doc_id % 4 + 1 AS rank, {_pick('(doc_id * 5)', SERVICES)} AS service, {_pick('(doc_id * 3 + doc_id // 7)', PACKAGES)} AS package, {_pick('(doc_id * 2 + doc_id // 5)', SECTIONS)} AS section FROM documents WHERE doc_id % 36 > 3),
    named AS (SELECT f.case_id, rank, section, {_PLAIN.format('c.package')} AS ep, {_PLAIN.format('f.package')} AS fp, {_PLAIN.format('c.service')} AS es, {_PLAIN.format('f.service')} AS fs FROM found f JOIN cases c USING (case_id) WHERE rank <= 3),
    told AS (SELECT *, {_TELLING.format('ep')} AS et, {_TELLING.format('fp')} AS ft FROM named),
    judged AS (
        SELECT *, ep <> '' AND fp <> '' AND (contains(ep, fp) OR contains(fp, ep) OR (len(et) > 0 AND len(ft) > 0 AND len(list_intersect(et, ft)) >= greatest(1, (least(len(et), len(ft)) + 1) // 2))) AS ok,
            es <> '' AND fs <> '' AND (contains(es, fs) OR contains(fs, es) OR {_FAMILY}) AS near FROM told),
    top AS (
        SELECT case_id, arg_min(ok, rank) AS leads, bool_or(ok OR near) AS anywhere, lower(coalesce((array_agg(section ORDER BY rank))[1], '')) AS section,
            count(DISTINCT CASE WHEN ok THEN nullif(lower(trim(split_part(coalesce(section, ''), '>', 1))), '') END) AS sections FROM judged GROUP BY case_id),
    named_buckets AS (
        SELECT CASE WHEN leads IS NULL THEN 'no_retrieval' WHEN NOT anywhere THEN 'cross_service_bleed' WHEN NOT leads THEN 'cross_package_bleed' WHEN sections >= 2 AND length({_PLAIN.format('answer')}) > 80 THEN 'correct_retrieval_wrong_answer'
            WHEN sections < 2 AND list_contains([{', '.join(map(repr, config.NARROW_SECTIONS))}], section) THEN 'wrong_section_right_package' ELSE 'right_chunk_incomplete' END AS bucket
        FROM cases LEFT JOIN top USING (case_id))
    SELECT bucket, count(*) AS n FROM named_buckets GROUP BY bucket""")
def eval_failures(spark, sf_dir):
    """Why cases failed, by the service, package and section of their first three rows, most common first."""
    docs = read(spark, sf_dir, "documents")
    div = lambda said: said.replace("//", "div")
    cases = docs.filter("doc_id % 4 = 0").select(F.expr("doc_id div 4").alias("case_id"), F.expr(div(_pick("(doc_id // 4)", SERVICES))).alias("service"), F.expr(div(_pick("(doc_id // 4 * 3)", PACKAGES))).alias("package"), F.coalesce("text", F.lit("")).alias("answer"))
    found = docs.filter("doc_id % 36 > 3").select(F.expr("doc_id div 4").alias("case_id"), F.expr("doc_id % 4 + 1").alias("rank"), F.expr(div(_pick("(doc_id * 5)", SERVICES))).alias("service"), F.expr(div(_pick("(doc_id * 3 + doc_id // 7)", PACKAGES))).alias("package"), F.expr(div(_pick("(doc_id * 2 + doc_id // 5)", SECTIONS))).alias("section"))
    return e.most_common(e.failures(cases, found), "bucket")


@slate("""WITH now AS (SELECT lang AS metric, avg(n_chars) AS value FROM documents GROUP BY lang), base AS (SELECT lang AS metric, avg(n_chars) + 10 AS value FROM documents WHERE lang <> 'fr' GROUP BY lang)
    SELECT coalesce(n.metric, b.metric) AS metric, round(n.value - b.value, 6) AS delta, coalesce(n.value - b.value < -0.05, false) AS failed FROM now n FULL JOIN base b ON n.metric = b.metric""")
def eval_baseline(spark, sf_dir):
    """Measures against a baseline that lacks one of them."""
    d = read(spark, sf_dir, "documents")
    now = d.groupBy(F.col("lang").alias("metric")).agg(F.avg("n_chars").alias("value"))
    base = d.filter("lang <> 'fr'").groupBy(F.col("lang").alias("metric")).agg((F.avg("n_chars") + 10).alias("value"))
    return e.gate(now, base).select("metric", F.round("delta", 6).alias("delta"), "failed")


QUERIES, ORACLES = slate.queries, slate.oracles
