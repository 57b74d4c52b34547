"""Exact deduplication with a heavy-hitter split.

A digest that a large share of the rows carries would send all of them to one
shuffle partition.  Misra-Gries summaries find every digest that may be that
frequent; their exact counts and winners are broadcast (never more rows than
the summary has counters), so that these rows are settled where they are read.
The other digests, none of which has more than rows / (counters + 1) rows, go
through an ordinary shuffle with map-side aggregation.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import WHITE, drop, fresh, text_of, written

COUNTERS = 256


def shrink(counts: Counter, counters: int) -> Counter:
    """The Misra-Gries merge: subtract the (counters + 1)-th largest count from all and keep what stays above 0."""
    if len(counts) <= counters:
        return counts
    cut = sorted(counts.values(), reverse=True)[counters]
    return Counter({k: v - cut for k, v in counts.items() if v > cut})


def _summarise(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[key] += n
                if len(counts) >= 16 * counters:
                    counts = shrink(counts, counters)
        counts = shrink(counts, counters)
        yield pa.record_batch({"digest": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them every one with more than rows / (counters + 1) rows (column `digest`)."""
    part = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(_summarise(counters), "digest binary, n long")
    middle = max(1, round(digests.rdd.getNumPartitions() ** 0.5))
    for n in dict.fromkeys((middle, 1)):
        part = part.repartition(n).mapInArrow(_summarise(counters), "digest binary, n long")
    return part.select("digest")


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, a row number that holds for this table, and the SHA-256 of the normalised text."""
    normal = F.regexp_replace(text_of(docs, text_col), WHITE, " ")
    return docs.select(docs[id_col].alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.unhex(F.sha2(normal, 256)).alias("digest"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per row of `docs`: doc_id, rid, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white
    space became one space; null counts as empty.  The row with the smallest
    id stays; a null id stays only if its group has no other.  Of rows
    repeated with their id exactly one stays.  `rid` is the row's
    monotonically_increasing_id in `docs`, which must be a table that reads
    the same twice (files, not an unordered shuffle).  An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    slim = written(with_digest(docs, id_col, text_col), "digests")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("rid").alias("row"))
    grouped = lambda rows: rows.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    suspects = written(frequent_digests(slim, counters), "suspects")
    winners = written(grouped(slim.join(F.broadcast(suspects), "digest", "left_semi")), "winners")
    drop(suspects)
    hot = slim.join(F.broadcast(winners), "digest")
    cold = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return hot.unionByName(cold.join(grouped(cold), "digest")).select(
        "doc_id", "rid", F.col("first.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("first.row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns, whatever their names; cases as in exact_dedup."""
    (rid,) = fresh(docs, "rid")
    stay = exact_dedup(docs, **options).filter("kept").select(F.col("rid").alias(rid))
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(stay, rid, "left_semi").drop(rid)
