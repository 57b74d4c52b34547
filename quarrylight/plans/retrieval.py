"""Retrieval over vectors and words: filters, gates, boosts, caps, lexical scores and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.engine import HashedBag
from quarrylight.operators import lexical, rows
from quarrylight.operators.retrieval import contained
from quarrylight.operators.vectors import top_k
from quarrylight.plans import Slate, read
from quarrylight.plans.vectors import chunks_and_questions

slate = Slate()
SCORED = """
    WITH scored AS (
        SELECT q.vec_id AS query_id, q.label AS query_label, c.vec_id, c.label, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0),
    found AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored QUALIFY rank <= 20)
"""


def _found(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    chunks, questions = chunks_and_questions(spark, sf_dir)
    labels = questions.select("query_id", "query_label")
    return top_k(chunks, questions, k).join(rows.broadcast_if_small(labels), "query_id")


@slate(SCORED + "SELECT query_id, vec_id, score, rank FROM found")
def vector_topk(spark, sf_dir):
    """The 20 nearest chunks of every question."""
    return _found(spark, sf_dir).select("query_id", "vec_id", "score", "rank")


@slate("""
    WITH scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0 AND (c.label IN (1, 3) OR (c.label = 5 AND q.label = 5)))
    SELECT query_id, vec_id, label, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored QUALIFY rank <= 10""")
def vector_topk_filtered(spark, sf_dir):
    """Top 10 under a metadata filter with OR and AND; the filter is part of the search."""
    chunks, questions = chunks_and_questions(spark, sf_dir)
    return top_k(chunks, questions, 10, lambda label, wanted, _: ((label == 1) | (label == 3))[:, None] | ((label == 5)[:, None] & (wanted == 5)))


@slate("""
    WITH scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, c.label = (q.vec_id // 100) % 12 AS fits, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0),
    kept AS (SELECT * FROM scored QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY query_id))
    SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM kept QUALIFY rank <= 5""")
def vector_filter_fallback(spark, sf_dir):
    """Top 5 under a filter; questions that it leaves without a row are answered unfiltered."""
    chunks, questions = chunks_and_questions(spark, sf_dir)
    kept = top_k(chunks, questions, 5, lambda label, _, query_id: label[:, None] == query_id // 100 % 12)
    rest = top_k(chunks, questions, 5).join(kept.select("query_id").distinct(), "query_id", "left_anti")
    return kept.unionByName(rest).select("query_id", "vec_id", "score", "rank")


@slate(SCORED + """, capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM found)
    SELECT query_id, vec_id, label, rank, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS position FROM capped WHERE n <= 2 OR vec_id % 7 = 0 QUALIFY position <= 8""")
def diversify(spark, sf_dir):
    """Two rows a label, eight in all; protected rows are not capped by label."""
    return rows.diversify(_found(spark, sf_dir), "query_id", "label", 2, 8, F.col("vec_id") % 7 == 0).select("query_id", "vec_id", "label", "rank", "position")


@slate(SCORED + "SELECT query_id, vec_id, score, max((vec_id % 7 = 0)::INT) OVER (PARTITION BY query_id) = 1 AS rescued FROM found WHERE score >= 0.15 OR vec_id % 7 = 0 OR label = query_label")
def relevance_gate(spark, sf_dir):
    """Rows above the least score, or rescued by a lexical hit or the same label; whether a question had a lexical hit."""
    kept = _found(spark, sf_dir).filter("score >= 0.15 OR vec_id % 7 = 0 OR label = query_label")
    return kept.select("query_id", "vec_id", "score", F.expr("max(vec_id % 7 = 0) OVER (PARTITION BY query_id)").alias("rescued"))


@slate(SCORED + "SELECT query_id, vec_id, rank, (row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN vec_id % 7 = 0 THEN 0 WHEN label = query_label THEN 1 ELSE 2 END, rank))::INT AS position FROM found")
def code_boost(spark, sf_dir):
    """Exact hits to the front, then title hits, otherwise in the old order."""
    tier = F.when(F.col("vec_id") % 7 == 0, 0).when(F.col("label") == F.col("query_label"), 1).otherwise(2)
    return rows.promote(_found(spark, sf_dir), "query_id", tier).select("query_id", "vec_id", "rank", "position")


BOOST = "CASE WHEN label = query_label THEN least(0.99, score + CASE vec_id % 3 WHEN 0 THEN 0.35 WHEN 1 THEN 0.28 ELSE 0.18 END) ELSE greatest(0.01, score - 0.08) END"


@slate(SCORED + f", b AS (SELECT query_id, vec_id, rank, round({BOOST}, 6) AS boosted FROM found) SELECT query_id, vec_id, boosted, (row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank))::INT AS position FROM b")
def catalog_boost(spark, sf_dir):
    """Scores raised or lowered by section and depth within (0.01, 0.99), then a stable order."""
    boosted = _found(spark, sf_dir).withColumn("boosted", F.round(F.expr(BOOST).cast("double"), 6))
    return rows.numbered(boosted, "position", ["query_id"], F.desc("boosted"), "rank").select("query_id", "vec_id", "boosted", "position")


@slate(SCORED + f"""
    , gated AS (SELECT *, round({BOOST}, 6) AS boosted FROM found WHERE score >= 0.1 OR vec_id % 7 = 0),
    again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted DESC, rank) AS again FROM gated),
    capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY again) AS n FROM again)
    SELECT query_id, vec_id, label, boosted, (row_number() OVER (PARTITION BY query_id ORDER BY again))::INT AS position, CASE WHEN query_label < 5 THEN 8 ELSE 5 END AS max_returned
    FROM capped WHERE vec_id % 7 = 0 OR n <= 2 QUALIFY position <= max_returned""")
def retrieve_pipeline(spark, sf_dir):
    """Search, gate, boost, re-rank, cap by label with protected rows, and a limit that depends on the question."""
    gated = _found(spark, sf_dir).filter("score >= 0.1 OR vec_id % 7 = 0").withColumn("boosted", F.round(F.expr(BOOST).cast("double"), 6))
    again = rows.numbered(gated, "again", ["query_id"], F.desc("boosted"), "rank").drop("rank").withColumnRenamed("again", "rank")
    kept = rows.diversify(again, "query_id", "label", 2, 8, F.col("vec_id") % 7 == 0)
    return kept.withColumn("max_returned", F.when(F.col("query_label") < 5, 8).otherwise(5)).filter("position <= max_returned").select("query_id", "vec_id", "label", "boosted", "position", "max_returned")


TITLES = "SELECT item_id, lower(text) AS title FROM benchmark WHERE length(text) >= 20"


@slate(f"""
    WITH b AS ({TITLES})
    SELECT doc_id, item_id, (row_number() OVER (PARTITION BY doc_id ORDER BY length(title) DESC, item_id))::INT AS position FROM documents, b WHERE contains(lower(text), title)""")
def title_contains_join(spark, sf_dir):
    """Titles of 20 and more characters that a text contains, longest first."""
    titles = read(spark, sf_dir, "benchmark").filter(F.length("text") >= 20).select(F.col("item_id").alias("title"), F.lower("text").alias("t"))
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.lower("text").alias("low"))
    hits = contained(docs, titles).join(rows.broadcast_if_small(titles), "title").select(F.col("doc").alias("doc_id"), F.col("title").alias("item_id"), F.length("t").alias("n"))
    return rows.numbered(hits, "position", ["doc_id"], F.desc("n"), "item_id").select("doc_id", "item_id", "position")


def bm25_lists(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best documents of every item by BM25, through the index in blocks."""
    return lexical.top_k(lexical.index(docs), asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), k)


BM25_SQL = """
    WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS terms FROM documents),
    s AS (SELECT count(*) AS docs, avg(len(terms)) AS mean FROM t),
    q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) AS term FROM benchmark),
    p AS (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM t),
    tf AS (SELECT term, doc_id, len, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    w AS (SELECT term, doc_id, ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean)) AS w FROM tf JOIN df USING (term), s),
    lexical AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM w JOIN q USING (term) GROUP BY ALL)
"""


@slate(BM25_SQL + "SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM lexical QUALIFY rank <= 10")
def bm25(spark, sf_dir):
    """The ten best documents of every question by BM25."""
    found = bm25_lists(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10)
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "score", "rank")


HYBRID_DIM = 64


@slate(BM25_SQL + rf"""
    , a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM lexical QUALIFY rank <= 20),
    texts AS (SELECT 0 AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
    words AS (SELECT kind, id, ('0x' || md5(w)[1:8])::BIGINT AS h FROM (SELECT kind, id, unnest(regexp_split_to_array(lower(text), '[ 	-]+')) AS w FROM texts) WHERE w <> ''),
    cells AS (SELECT kind, id, h % {HYBRID_DIM} AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS v FROM words GROUP BY ALL),
    norms AS (SELECT kind, id, sqrt(sum(v * v)) AS norm FROM cells GROUP BY ALL HAVING norm > 0),
    near AS (
        SELECT q.id AS item_id, d.id AS doc_id, round(sum(d.v / dn.norm * (q.v / qn.norm)), 6) AS score
        FROM cells d JOIN norms dn ON dn.kind = 0 AND dn.id = d.id JOIN cells q ON q.place = d.place AND q.kind = 1 JOIN norms qn ON qn.kind = 1 AND qn.id = q.id
        WHERE d.kind = 0 GROUP BY ALL),
    e AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 20),
    f AS (SELECT item_id, doc_id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM (FROM a UNION ALL FROM e) GROUP BY ALL)
    SELECT item_id, doc_id, score, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM f QUALIFY rank <= 10""")
def hybrid_rrf(spark, sf_dir):
    """Reciprocal rank fusion, half and half, of BM25 and of the nearest embeddings of the texts."""
    docs, asked = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    embedder = HashedBag(HYBRID_DIM, unit=False)
    vectors = embedder.embed_texts(docs.select(F.col("doc_id").alias("vec_id"), F.lit(0).alias("label"), "text"), "text")
    questions = embedder.embed_texts(asked.select(F.col("item_id").alias("query_id"), F.lit(0).alias("query_label"), "text"), "text").withColumnRenamed("embedding", "query")
    dense = top_k(vectors, questions, 20).withColumnRenamed("vec_id", "doc_id")
    found = lexical.fused([(bm25_lists(docs, asked, 20), 0.5), (dense, 0.5)], 10)
    return found.select(F.col("query_id").alias("item_id"), "doc_id", "score", "rank")


QUERIES, ORACLES = slate.queries, slate.oracles
