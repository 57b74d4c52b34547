"""A training corpus from `documents`: quality rules, exact and near deduplication, sanitisation, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last
give the columns of `documents`.  Between stages the rows are a Parquet table.

Cases, alike in every stage: a null text counts as empty; null and repeated ids
and repeated rows pass through unless the stage drops their text; texts of any length are
read whole; an empty table gives an empty table; columns beyond those of
`documents` are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import exact_dedup, near_dedup, packing, pii, quality_rules
from quarrylight.llm.common import drop, table, written
from quarrylight.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near duplicates in the pipeline: shingles of so many words, similarity in percent.
NEAR_WORDS, NEAR_PERCENT = 5, 80

#: The statistics of the sanitiser and the packer's windows have no form in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of documents with another text, and its length."""
    return docs.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go (an empty or null text is one); of the others, the lines that failed."""
    judged = quality_rules.quality_rules(docs.select(*COLUMNS)).filter("kept")
    return with_text(judged, F.when(F.col("lost_share") > 0, F.col("cleaned")).otherwise(F.col("text")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays; a null id only if its group has no other, and one row of those that tie."""
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows with the smallest id stay; rows without an id, and texts without words, all stay."""
    docs = docs.select(*COLUMNS)
    gone = near_dedup.near_duplicates(docs, NEAR_WORDS, NEAR_PERCENT).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that give it away are replaced or removed; a text without any stays as it is, null as empty."""
    return with_text(pii.sanitise(docs.select(*COLUMNS)), F.col("sanitised"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row per piece; an empty text is its end alone."""
    return packing.pack(docs.select(*COLUMNS), f"{TOKENIZERS}/byte_bpe_50k.json")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
