"""Vector search over embeddings: exact cosine top-k for many questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.operators.vectors import top_k

#: Rows with these remainders stand in for questions.
QUESTIONS = 100


def chunks_and_questions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    questions = chunks.filter(F.col("vec_id") % QUESTIONS == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), F.col("label").alias("query_label"))
    return chunks, questions


def retrieve_minimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top 20, relevance gate at 0.1, at most two rows a label, five rows in all."""
    chunks, questions = chunks_and_questions(spark, sf_dir)
    found = top_k(chunks, questions, 20).filter(F.col("score") >= 0.1)
    per_label = F.row_number().over(W.partitionBy("query_id", "label").orderBy("rank"))
    kept = found.withColumn("n", per_label).filter(F.col("n") <= 2)
    final = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("position", final).filter(F.col("position") <= 5).select("query_id", "position", "vec_id", "label", "score")


QUERIES = {"retrieve_minimal": retrieve_minimal}
ORACLES = {
    "retrieve_minimal": """
        WITH scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, c.label, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
            FROM embeddings c, embeddings q WHERE q.vec_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored),
        capped AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY rank) AS n FROM ranked WHERE rank <= 20 AND score >= 0.1)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY rank))::INT AS position, vec_id, label, score
        FROM capped WHERE n <= 2 QUALIFY position <= 5""",
}
