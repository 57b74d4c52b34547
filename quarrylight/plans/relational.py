"""Catalog, coverage, session and usage queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.operators import messages


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def service_code_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised codes in a text, each once."""
    codes = F.regexp_extract_all("p_brand", F.lit(r"(?i)brand#(\d+)"), 1)
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.transform(codes, lambda c: F.concat(F.lit("BR"), c))), ",").alias("codes"))


def price_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole prices without decimals, others with two."""
    price = F.col("p_retailprice")
    text = F.when(price == F.floor(price), price.cast("long").cast("string")).otherwise(F.format_string("%.2f", price))
    return _read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("USD "), text).alias("price"))


def catalog_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many packages a service has, and the first eight names: whole-group counts, names cut before they are gathered."""
    part = _read(spark, sf_dir, "part")
    counts = part.groupBy("p_type").agg(F.count("*").alias("n"))
    first = part.withColumn("rn", F.row_number().over(W.partitionBy("p_type").orderBy("p_partkey"))).filter("rn <= 8")
    names = first.groupBy("p_type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "p_name"))), lambda x: x["p_name"]), "; ").alias("names"))
    return counts.join(names, "p_type").select("p_type", "n", F.when(F.col("n") > 8, F.concat("names", F.lit(" and "), (F.col("n") - 8).cast("string"), F.lit(" more"))).otherwise(F.col("names")).alias("answer"))


def coverage_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed against fetched, by status: full outer join after aggregation."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
    both = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "full_outer")
    return both.groupBy(F.coalesce("o_orderstatus", F.lit("?")).alias("status")).agg(F.count("o_orderkey").alias("listed"), F.count("l_orderkey").alias("fetched"), F.count_if(F.col("l_orderkey").isNull()).alias("missing"), F.count_if(F.col("o_orderkey").isNull()).alias("unlisted"))


def content_hash_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest status by content hash against the state left by a first run over even ids."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha"))
    state = docs.filter("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("old")).otherwise(F.col("sha")).alias("known"))
    return docs.join(state, "doc_id", "left").select("doc_id", F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("sha"), "skipped").otherwise("changed").alias("status"))


GAP_MICROS, CAP, LEAST = 43_200_000_000, 40, 3


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by gap (strictly more than 12 hours opens a new one) and size (40 at most); under three messages they go."""
    rows = messages.sessions(_read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", GAP_MICROS, CAP)
    found = rows.groupBy("user_id", "session", "part").agg(F.count("*").alias("messages"), F.min(F.struct("ts", "event_id")).alias("a"), F.max(F.struct("ts", "event_id")).alias("b")).filter(F.col("messages") >= LEAST)
    key = F.concat_ws("|", F.col("user_id").cast("string"), F.col("a.event_id").cast("string"), F.col("b.event_id").cast("string"))
    return found.select(F.sha1(key).alias("episode_id"), "user_id", "messages", F.col("a.ts").alias("started_at"), F.col("b.ts").alias("ended_at"))


def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of anchors, in page order."""
    links = F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), 1)).alias("pos", "href")
    return _read(spark, sf_dir, "pages").select("page_id", links)


QUERIES = {f.__name__: f for f in (service_code_extract, price_format, catalog_count, coverage_reconcile, content_hash_skip, episodes, usage_daily, link_extract)}

ORACLES = {
    "service_code_extract": r"SELECT p_partkey, array_to_string(list_distinct(list_transform(regexp_extract_all(p_brand, '(?i)brand#(\d+)', 1), lambda c: 'BR' || c)), ',') AS codes FROM part",
    "price_format": "SELECT p_partkey, 'USD ' || CASE WHEN p_retailprice = floor(p_retailprice) THEN (p_retailprice::BIGINT)::VARCHAR ELSE printf('%.2f', p_retailprice) END AS price FROM part",
    "catalog_count": """
        WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn, count(*) OVER (PARTITION BY p_type) AS n FROM part)
        SELECT p_type, any_value(n) AS n, string_agg(p_name, '; ' ORDER BY rn) || CASE WHEN any_value(n) > 8 THEN ' and ' || (any_value(n) - 8)::VARCHAR || ' more' ELSE '' END AS answer
        FROM r WHERE rn <= 8 GROUP BY p_type""",
    "coverage_reconcile": """
        WITH l AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey)
        SELECT coalesce(o_orderstatus, '?') AS status, count(o_orderkey) AS listed, count(l_orderkey) AS fetched,
            count(*) FILTER (l_orderkey IS NULL) AS missing, count(*) FILTER (o_orderkey IS NULL) AS unlisted
        FROM orders FULL JOIN l ON o_orderkey = l_orderkey GROUP BY 1""",
    "content_hash_skip": """
        SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN 'new' WHEN doc_id % 10 = 0 THEN 'changed' ELSE 'skipped' END AS status FROM documents""",
    "episodes": """
        WITH g AS (SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000)::INT, 0) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g),
        p AS (SELECT *, (row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) - 1) // 40 AS part FROM s)
        SELECT sha1(user_id::VARCHAR || '|' || (arg_min(event_id, (ts, event_id)))::VARCHAR || '|' || (arg_max(event_id, (ts, event_id)))::VARCHAR) AS episode_id,
            user_id, count(*) AS messages, min(ts) AS started_at, max(ts) AS ended_at
        FROM p GROUP BY user_id, session, part HAVING count(*) >= 3""",
    "usage_daily": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "link_extract": r"""
        WITH l AS (SELECT page_id, regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"', 1) AS hrefs FROM pages)
        SELECT page_id, (unnest(range(len(hrefs))))::INT AS pos, unnest(hrefs) AS href FROM l""",
}
