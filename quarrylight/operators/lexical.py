"""BM25 over an inverted index in blocks with their maxima, and the fusion of ranked lists.

Documents are dealt into shards, a shard's documents into blocks.  For each term
the shard lists its postings by block and, with each block, the greatest weight
in it.  Their sums bound what a block's documents can score for a question, so that
blocks go from the greatest bound down and end where the k-th best so far is
out of reach.  A task keeps k documents a question; no row of a question and a
document exists beside those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.functions import text
from quarrylight.operators import rows

K1, B = 1.5, 0.75
SHARD_DOCS, SHARD_TERMS, BLOCK = 4_096, 1_000_000, 64
#: Questions that are broadcast at a time: so many, or so many bytes; each such group is one scan of the index.
GROUP, GROUP_BYTES = 10_000, 16 << 20
#: Scores are rounded to six places; a bound may be short by as much.
PLACES = 6
WORD = re.compile("[a-z]{3,}")
SHARD = "ids array<long>, terms array<string>, sizes array<int>, heads array<int>, blocks array<int>, tops array<double>, starts array<int>, places array<int>, weights array<double>"
COLUMNS = ("ids", "sizes", "heads", "blocks", "tops", "starts", "places", "weights")


def _words(said: str | None) -> list[str]:
    return WORD.findall((said or "").lower())


class Gathered:
    """The documents of a shard until it is closed."""

    def __init__(self):
        self.ids, self.lengths, self.places, self.parts, self.held = [], [], {}, [], 0

    def add(self, doc_id: int, words: list[str]) -> None:
        places = self.places
        self.parts.append(np.fromiter([places.setdefault(w, len(places)) for w in words], np.int64, len(words)))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.held += len(words)

    def closed(self, mean: float, k1: float, b: float) -> pa.RecordBatch:
        n = len(self.ids)
        lengths = np.array(self.lengths, np.int64)
        keys, tf = np.unique(np.concatenate(self.parts) * n + np.repeat(np.arange(n), lengths), return_counts=True)
        term, place = np.divmod(keys, n)
        weights = tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[place] / mean))
        block = place // BLOCK
        first = np.ones(len(keys), bool)
        first[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        starts = np.flatnonzero(first)
        every = np.arange(len(self.places) + 1)
        row = {
            "ids": np.array(self.ids, np.int64),
            "terms": list(self.places),
            "sizes": np.diff(np.searchsorted(term, every)).astype(np.int32),
            "heads": np.searchsorted(term[starts], every).astype(np.int32),
            "blocks": block[starts].astype(np.int32),
            "tops": np.maximum.reduceat(weights, starts),
            "starts": np.append(starts, len(keys)).astype(np.int32),
            "places": place.astype(np.int32),
            "weights": weights,
        }
        return pa.record_batch([pa.array([v]) for v in row.values()], list(row))


def _shards(mean: float, k1: float, b: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Gathered()
        for batch in batches:
            for doc_id, said in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if words := _words(said.as_py()):
                    shard.add(doc_id, words)
                if len(shard.ids) >= SHARD_DOCS or shard.held >= SHARD_TERMS:
                    yield shard.closed(mean, k1, b)
                    shard = Gathered()
        if shard.ids:
            yield shard.closed(mean, k1, b)

    return run


@dataclass
class Index:
    """Shards as a table, and the number of all documents."""

    shards: DataFrame
    n_docs: int


def index(docs: DataFrame, key: str = "doc_id", column: str = "text", k1: float = K1, b: float = B) -> Index:
    """The index of all rows and terms of `docs`, a table in the folder of spark.checkpoint.dir; the texts are read twice, nothing is shuffled. Null texts count as documents without terms."""
    said = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(column).alias("text"))
    n_docs, mean = said.agg(F.count("*"), F.avg(F.size(text.terms(F.coalesce("text", F.lit("")))))).first()
    # a row is a shard of some MB, and readers decode a row group at once
    small = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}
    return Index(rows.stored(said.mapInArrow(_shards(mean or 1.0, k1, b), SHARD), **small), n_docs)


def _holders(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        found = np.zeros(len(asked), np.int64)
        for batch in batches:
            for terms, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, n in zip(terms, sizes, strict=True):
                    if name in asked:
                        found[asked[name]] += n
        some = np.flatnonzero(found)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(found[some], pa.int64())], ["place", "df"])

    return run


class Shard:
    """A shard as arrays."""

    def __init__(self, ids, sizes, heads, blocks, tops, starts, places, weights):
        self.ids, self.heads, self.blocks, self.tops, self.starts, self.places, self.weights = ids, heads, blocks, tops, starts, places, weights
        self.n_blocks = -(-len(ids) // BLOCK)

    def bounds(self, asked: list[tuple[int, float]]) -> np.ndarray:
        """What a document of each block can score at most."""
        most = np.zeros(self.n_blocks)
        for t, w in asked:
            mine = slice(self.heads[t], self.heads[t + 1])
            most[self.blocks[mine]] += w * self.tops[mine]
        return most

    def scores(self, asked: list[tuple[int, float]], chosen: np.ndarray) -> np.ndarray:
        """The scores of documents in chosen blocks; 0 elsewhere."""
        totals = np.zeros(len(self.ids))
        for t, w in asked:
            at = np.flatnonzero(chosen[self.blocks[self.heads[t] : self.heads[t + 1]]]) + self.heads[t]
            sizes = self.starts[at + 1] - self.starts[at]
            mine = np.repeat(self.starts[at] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            totals[self.places[mine]] += w * self.weights[mine]
        return np.round(totals, PLACES)

    def best(self, asked: list[tuple[int, float]], best: Best) -> int:
        """Documents that can still be among the best go into `best`; how many blocks were read."""
        bounds = self.bounds(asked)
        order = np.argsort(-bounds, kind="stable")
        at, step, read = 0, 4, 0
        while at < len(order):
            take = order[at : at + step]
            take = take[(bounds[take] > 0) & (bounds[take] + 10.0**-PLACES >= best.least)]
            if not len(take):
                break
            chosen = np.zeros(self.n_blocks, bool)
            chosen[take] = True
            best.add(self.scores(asked, chosen), self.ids)
            at, step, read = at + step, 2 * step, read + len(take)
        return read


class Best:
    """The k best (score, smaller id) of one question."""

    def __init__(self, k: int):
        self.k, self.least = k, 0.0
        self.scores, self.ids = np.empty(0), np.empty(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        at = np.flatnonzero((scores > 0) & (scores >= self.least))
        scores, ids = np.concatenate((self.scores, scores[at])), np.concatenate((self.ids, ids[at]))
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least = self.scores[-1]


def _search(shipped, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions, asked, idf = shipped.value
        best = [Best(k) for _ in questions]
        for batch in batches:
            for r in range(batch.num_rows):
                shard = Shard(*(batch.column(batch.schema.get_field_index(c))[r].values.to_numpy() for c in COLUMNS))
                there = {asked[t]: i for i, t in enumerate(batch.column(1)[r].as_py()) if t in asked}
                for (_, places), mine in zip(questions, best, strict=True):
                    if found := [(there[p], idf[p]) for p in places if p in there]:
                        shard.best(found, mine)
        sizes = [len(b.ids) for b in best]
        if sum(sizes):
            numbers = np.repeat([q for q, _ in questions], sizes)
            yield pa.record_batch([pa.array(numbers, pa.int64()), pa.array(np.concatenate([b.ids for b in best])), pa.array(np.concatenate([b.scores for b in best]))], ["query_id", "doc_id", "score"])

    return run


def top_k(made: Index, questions: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of every question (query_id, query), with a score above 0; ties go to the smaller id."""
    spark, schema = made.shards.sparkSession, "query_id long, doc_id long, score double"
    said = questions.select(F.col("query_id").cast("long"), F.array_distinct(text.terms(F.coalesce("query", F.lit("")))).alias("terms"))
    n, size = said.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("terms", " "))), F.lit(0))).first()
    parts = []
    groups = max(-(-n // GROUP), -(-size // GROUP_BYTES))
    for g in range(groups):
        mine = said.filter(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g).toArrow()
        lists = mine["terms"].to_pylist()
        asked = {t: i for i, t in enumerate(sorted({t for x in lists for t in x}))}
        if not asked:
            continue
        held = made.shards.select("terms", "sizes").mapInArrow(_holders(spark.sparkContext.broadcast(asked)), "place long, df long")
        df = {r.place: r.df for r in held.groupBy("place").agg(F.sum("df").alias("df")).toLocalIterator()}
        idf = {p: float(np.log(1 + (made.n_docs - x + 0.5) / (x + 0.5))) for p, x in df.items()}
        asking = [(q, [asked[t] for t in x if asked[t] in idf]) for q, x in zip(mine["query_id"].to_pylist(), lists, strict=True)]
        parts.append(made.shards.mapInArrow(_search(spark.sparkContext.broadcast((asking, asked, idf)), k), schema))
    found = reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], schema)
    return rows.numbered(found, "rank", ["query_id"], F.desc("score"), "doc_id").filter(F.col("rank") <= k)


def fused(lists: list[tuple[DataFrame, float]], k: int, constant: int = 60) -> DataFrame:
    """(query_id, doc_id, score, rank): ranked lists (query_id, doc_id, rank) in one by the sums of weight / (constant + rank), to nine places; ties go to the smaller id."""
    marks = [d.select("query_id", "doc_id", (F.lit(float(w)) / (F.col("rank") + constant)).alias("mark")) for d, w in lists]
    every = reduce(lambda a, b: a.unionByName(b), marks)
    summed = every.groupBy("query_id", "doc_id").agg(F.round(F.sum("mark"), 9).alias("score"))
    return rows.numbered(summed, "rank", ["query_id"], F.desc("score"), "doc_id").filter(F.col("rank") <= k)
