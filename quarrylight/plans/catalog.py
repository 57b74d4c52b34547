"""Catalogs, reconciliation, timelines, usage and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import evaluation, rows, timelines
from quarrylight.operators.retrieval import contained
from quarrylight.operators.vectors import top_k
from quarrylight.plans import Slate, read
from quarrylight.plans.vectors import chunks_and_questions

slate = Slate()


@slate("SELECT n_name, count(c_custkey) AS customers, (SELECT count(*) FROM supplier s WHERE s.s_nationkey = n.n_nationkey) AS suppliers, CASE WHEN count(c_custkey) > 0 THEN 'customers' ELSE 'suppliers' END AS listed FROM nation n LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey")
def location_count(spark, sf_dir):
    """Entries of a country by kind; the second kind is listed where the first has none."""
    c = read(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("customers"))
    s = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"))
    n = read(spark, sf_dir, "nation")
    both = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(s, n.n_nationkey == s.s_nationkey, "left").na.fill(0, ["customers", "suppliers"])
    return both.select("n_name", "customers", "suppliers", F.when(F.col("customers") > 0, "customers").otherwise("suppliers").alias("listed"))


@slate("""WITH r AS (SELECT p_type, p_name, p_retailprice, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
    SELECT p_type, string_agg(rn::VARCHAR || '. ' || p_name || ' (USD ' || CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE printf('%.2f', p_retailprice) END || ')', chr(10) ORDER BY rn) AS answer FROM r WHERE rn <= 8 GROUP BY p_type""")
def catalog_list(spark, sf_dir):
    """The eight dearest packages of a service as a numbered list with prices."""
    first = rows.numbered(read(spark, sf_dir, "part"), "rn", ["p_type"], F.desc("p_retailprice"), "p_partkey").filter("rn <= 8")
    line = F.concat(F.col("rn").cast("string"), F.lit(". "), "p_name", F.lit(" (USD "), text.money(F.col("p_retailprice")), F.lit(")"))
    return first.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", line.alias("t")))), lambda x: x["t"]), "\n").alias("answer"))


PEERS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@slate("SELECT c_mktsegment AS key, " + ", ".join(f"count(*) FILTER (r_name = '{p}') AS {p.lower().replace(' ', '_')}" for p in PEERS) + " FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def compare_pivot(spark, sf_dir):
    """One row a key, one column a peer."""
    c, n, r = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.groupBy(F.col("c_mktsegment").alias("key")).agg(*(F.count_if(F.col("r_name") == p).alias(p.lower().replace(" ", "_")) for p in PEERS))


@slate("""WITH l AS (SELECT l_orderkey FROM lineitem GROUP BY 1)
    SELECT o_orderpriority AS area, count(*) AS discovered, count(l_orderkey) AS scraped, count(*) = count(l_orderkey) AS complete FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1""")
def completeness_gate(spark, sf_dir):
    """Discovered against scraped by area; an area passes when none is missing."""
    o = read(spark, sf_dir, "orders")
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(1).alias("hit")).distinct()
    return o.join(l, "o_orderkey", "left").groupBy(F.col("o_orderpriority").alias("area")).agg(F.count("*").alias("discovered"), F.count("hit").alias("scraped"), (F.count("*") == F.count("hit")).alias("complete"))


@slate("""SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'bag', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'unseen', count(*) FROM (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""")
def discovery_setops(spark, sf_dir):
    """Sizes of the set operations between discoveries."""
    c, s, n = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    made = {"union": c.union(s).distinct(), "except": c.subtract(s), "intersect": c.intersect(s), "bag": c.union(s), "unseen": n.subtract(s)}
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, d in made.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@slate("""WITH n AS (SELECT o_custkey, count(*) AS orders, max(o_orderdate) AS last_at FROM orders GROUP BY 1)
    SELECT coalesce(c_custkey, o_custkey) AS custkey, coalesce(orders, 0) AS orders, last_at, CASE WHEN o_custkey IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM customer FULL JOIN n ON c_custkey = o_custkey""")
def state_merge(spark, sf_dir):
    """Old state and new observations by key: kept, inserted or updated."""
    new = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last_at"))
    old = read(spark, sf_dir, "customer").select("c_custkey")
    both = old.join(new, F.col("c_custkey") == F.col("o_custkey"), "full_outer")
    action = F.when(F.col("o_custkey").isNull(), "kept").when(F.col("c_custkey").isNull(), "inserted").otherwise("updated")
    return both.select(F.coalesce("c_custkey", "o_custkey").alias("custkey"), F.coalesce("orders", F.lit(0)).alias("orders"), "last_at", action.alias("action"))


RATES = {"view": 0.02, "click": 0.06, "purchase": 0.24}
DEFAULT_RATE = 0.02


@slate("SELECT user_id, date_trunc('month', ts)::DATE AS month, round(sum(value / 1000000::DOUBLE * CASE event_type WHEN 'view' THEN 0.02::DOUBLE WHEN 'click' THEN 0.06::DOUBLE WHEN 'purchase' THEN 0.24::DOUBLE ELSE 0.02::DOUBLE END), 8) AS cost, count(*) AS calls FROM events GROUP BY ALL")
def usage_cost(spark, sf_dir):
    """Cost of a user's month at a rate per kind, with a default rate."""
    rate = F.lit(DEFAULT_RATE)
    for kind, value in RATES.items():
        rate = F.when(F.col("event_type") == kind, F.lit(value)).otherwise(rate)
    return read(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("month", "ts").cast("date").alias("month")).agg(F.round(F.sum(F.col("value") / F.lit(1e6) * rate), 8).alias("cost"), F.count("*").alias("calls"))


@slate("""WITH b AS (SELECT user_id, event_id, epoch_us(ts) AS top, epoch_us(ts) + (value * 1000000)::BIGINT * 60 AS bottom FROM events),
    m AS (SELECT *, max(bottom) OVER (PARTITION BY user_id ORDER BY top, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
    g AS (SELECT *, sum((coalesce(top - before > 3600000000, false))::INT) OVER (PARTITION BY user_id ORDER BY top, event_id ROWS UNBOUNDED PRECEDING) AS g FROM m)
    SELECT user_id, g::BIGINT AS cluster, count(*) AS n, max(bottom) - min(top) AS height FROM g GROUP BY user_id, g""")
def gap_clusters(spark, sf_dir):
    """Intervals in order; a gap of over an hour to the lowest end so far opens a new cluster."""
    top = F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), F.col("ts"))
    b = read(spark, sf_dir, "events").select("user_id", "event_id", top.alias("top"), (top + F.round(F.col("value") * 1_000_000).cast("long") * 60).alias("bottom"))
    g = timelines.gap_clusters(b, ["user_id"], "top", "bottom", "event_id", 3_600_000_000)
    return g.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), (F.max("bottom") - F.min("top")).alias("height"))


@slate("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN floor(value / 10)::BIGINT END AS sr, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
    SELECT user_id, event_id, coalesce(sr, i + greatest(0, coalesce(max(sr - i) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS serial FROM e""")
def serial_fill(spark, sf_dir):
    """Stated serial numbers stay; others go on from the highest before them."""
    sr = F.when(F.col("event_type") == "purchase", F.floor(F.col("value") / 10))
    return timelines.serial_fill(read(spark, sf_dir, "events"), ["user_id"], sr, "ts", "event_id").select("user_id", "event_id", "serial")


CUTOFF = "2024-01-15 00:00:00"


@slate(f"""WITH d AS (SELECT user_id, ts::DATE AS day, event_id, ts FROM events),
    n AS (SELECT user_id, day, sha1(string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id)) AS sha FROM d GROUP BY ALL),
    o AS (SELECT user_id, day, sha1(string_agg(event_id::VARCHAR, chr(10) ORDER BY event_id)) AS sha FROM d WHERE ts < TIMESTAMP '{CUTOFF}' GROUP BY ALL)
    SELECT n.user_id, n.day, CASE WHEN o.sha IS NULL THEN 'new' ELSE 'changed' END AS status FROM n LEFT JOIN o ON n.user_id = o.user_id AND n.day = o.day WHERE o.sha IS DISTINCT FROM n.sha""")
def episode_changes(spark, sf_dir):
    """Episodes whose content hash is new or differs from the state before the cut-off."""
    d = read(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    sha = lambda df, name: df.groupBy("user_id", "day").agg(F.sha1(F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), "\n")).alias(name))
    both = sha(d, "sha").join(sha(d.filter(F.expr(f"ts < timestamp_ntz'{CUTOFF}'")), "old"), ["user_id", "day"], "left")
    return both.filter(~F.col("sha").eqNullSafe(F.col("old"))).select("user_id", "day", F.when(F.col("old").isNull(), "new").otherwise("changed").alias("status"))


# evaluation: benchmark passages are the cases, documents what was retrieved

HITS = "SELECT item_id, doc_id, lang FROM documents, (SELECT item_id, lower(text) AS needle FROM benchmark) WHERE contains(lower(text), needle)"


def _hits(spark, sf_dir):
    needles = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("title"), F.lower("text").alias("t"))
    docs = read(spark, sf_dir, "documents")
    found = contained(docs.select(F.col("doc_id").alias("doc"), F.lower("text").alias("low")), needles)
    return found.select(F.col("title").alias("item_id"), F.col("doc").alias("doc_id")).join(docs.select("doc_id", "lang"), "doc_id")


@slate(f"WITH h AS ({HITS}) SELECT item_id, count(doc_id) AS docs, CASE WHEN count(doc_id) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit FROM benchmark LEFT JOIN h USING (item_id) GROUP BY item_id")
def eval_hit_at_k(spark, sf_dir):
    """1 for cases with a hit, 0 for those without any row."""
    hits = _hits(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"))
    return read(spark, sf_dir, "benchmark").select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("docs", F.lit(0)).alias("docs"), F.when(F.col("docs") > 0, 1.0).otherwise(0.0).alias("hit"))


@slate(f"""WITH h AS (SELECT DISTINCT item_id, lang FROM ({HITS})), a AS (SELECT count(*) AS cases FROM benchmark)
    SELECT coalesce(lang, 'overall') AS tag, count(DISTINCT item_id) AS hits, round(count(DISTINCT item_id) / max(cases)::DOUBLE, 6) AS recall FROM h, a GROUP BY GROUPING SETS ((lang), ())""")
def eval_by_tag(spark, sf_dir):
    """Recall by tag and overall; cases with several tags count in each."""
    found = _hits(spark, sf_dir).select("item_id", "lang").distinct()
    cases = read(spark, sf_dir, "benchmark").agg(F.count("*").alias("cases"))
    sets = found.groupingSets([["lang"], []], "lang").agg(F.countDistinct("item_id").alias("hits"))
    return sets.crossJoin(F.broadcast(cases)).select(F.coalesce("lang", F.lit("overall")).alias("tag"), "hits", F.round(F.col("hits") / F.col("cases"), 6).alias("recall"))  # one row


@slate("""WITH m AS (SELECT lang, avg(quality) AS now, avg(CASE WHEN n_chars < 3000 THEN quality END) AS base FROM documents JOIN labels USING (doc_id) GROUP BY lang)
    SELECT lang, round(now - base, 6) AS delta, coalesce(now - base < -0.05, false) AS failed FROM m""")
def eval_gate(spark, sf_dir):
    """Metrics against a baseline: a drop of over 0.05 fails, a missing one is skipped."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    m = d.groupBy("lang").agg(F.avg("quality").alias("now"), F.avg(F.when(F.col("n_chars") < 3000, F.col("quality"))).alias("base"))
    delta = F.col("now") - F.col("base")
    return m.select("lang", F.round(delta, 6).alias("delta"), F.coalesce(delta < -0.05, F.lit(False)).alias("failed"))


SWEPT = {"k": [1, 5, 10, 20], "least": [0.0, 0.1, 0.2, 0.3]}


@slate("""
    WITH scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, c.label = q.label AS hit, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0),
    found AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored QUALIFY rank <= 20),
    g AS (SELECT k.k, s.least FROM (VALUES (1), (5), (10), (20)) k(k), (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE)) s(least)),
    x AS (
        SELECT k, least, count(rank) AS cost, round(count(DISTINCT CASE WHEN hit AND vec_id <> query_id THEN query_id END) / (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0)::DOUBLE, 6) AS gain
        FROM g LEFT JOIN found ON rank <= k AND score >= least GROUP BY k, least)
    SELECT k, least, cost, gain, row_number() OVER (ORDER BY (gain >= 0.5) DESC, gain DESC, cost, k, least) = 1 AS winner FROM x""")
def eval_sweep(spark, sf_dir):
    """How many rows are kept and how many questions have a neighbour of their label, by the number and least score of what a search returns; and the setting that wins."""
    chunks, questions = chunks_and_questions(spark, sf_dir)
    found = rows.stored(top_k(chunks, questions, 20).join(questions.select("query_id", "query_label"), "query_id").withColumn("hit", (F.col("label") == F.col("query_label")) & (F.col("vec_id") != F.col("query_id"))))
    return evaluation.sweep(found, questions.count(), SWEPT, (F.col("rank") <= F.col("k")) & (F.col("score") >= F.col("least")), 0.5)


WANTED = ("the", "and", "tion", "ouen", "que", "license", "est", "schen")


@slate("""WITH c AS (SELECT doc_id, source, lang, len(list_filter(['the', 'and', 'tion', 'ouen', 'que', 'license', 'est', 'schen'], lambda w: contains(lower(text), w))) AS hits FROM documents)
    SELECT doc_id, hits::INT AS hits, hits >= 6 AS covered FROM c""")
def phrase_coverage(spark, sf_dir):
    """How many of eight words a text has; covered from 70 % on, by banker's rounding of the threshold (5.6 to 6)."""
    low = F.lower("text")
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in WANTED), F.lit(0))
    return read(spark, sf_dir, "documents").select("doc_id", hits.alias("hits")).withColumn("covered", F.col("hits") >= F.bround(F.lit(0.7 * len(WANTED))).cast("int"))


STATUS = "CASE WHEN quality IS NULL THEN 'N/A' WHEN quality = 1 AND toxic = 0 THEN 'PASS' WHEN quality = 1 OR toxic = 0 THEN 'PARTIAL' ELSE 'FAIL' END"


@slate(f"""WITH v AS (SELECT source, {STATUS} AS status FROM documents LEFT JOIN labels USING (doc_id))
    SELECT source, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'PARTIAL') AS partly, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'N/A') AS ungraded,
    round(avg(CASE WHEN status <> 'N/A' THEN (status = 'PASS')::INT END), 6) AS pass_rate, count(*) FILTER (status = 'FAIL') + 0.5::DOUBLE * count(*) FILTER (status = 'PARTIAL') AS weight FROM v GROUP BY source""")
def verdict_pivot(spark, sf_dir):
    """Verdicts by section, the pass rate of what was graded, and the weight for a worst-first order."""
    v = read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left").select("source", F.expr(STATUS).alias("status"))
    n = lambda s: F.count_if(F.col("status") == s)
    rate = F.round(F.avg(F.when(F.col("status") != "N/A", (F.col("status") == "PASS").cast("int"))), 6)
    return v.groupBy("source").agg(n("PASS").alias("passed"), n("PARTIAL").alias("partly"), n("FAIL").alias("failed"), n("N/A").alias("ungraded"), rate.alias("pass_rate"), (n("FAIL") + F.lit(0.5) * n("PARTIAL")).alias("weight"))


BUCKET = "CASE WHEN n_chars < 200 THEN 'too short' WHEN toxic = 1 THEN 'unsafe' WHEN contains(lower(text), 'license') THEN 'wrong section' ELSE 'wrong answer' END"


@slate(f"SELECT {BUCKET} AS bucket, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 0 GROUP BY 1")
def failure_buckets(spark, sf_dir):
    """Why failed cases failed, by ordered rules."""
    failed = read(spark, sf_dir, "labels").filter("quality = 0")
    return read(spark, sf_dir, "documents").join(failed, "doc_id").groupBy(F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n"))


QUERIES, ORACLES = slate.queries, slate.oracles
