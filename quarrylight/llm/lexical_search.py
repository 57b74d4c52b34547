"""Ranked lexical search over document shards in compressed sparse rows.

Documents are dealt into shards of two thousand.  A shard holds its terms in
order and, for each, the places of its documents with a precomputed integer
impact.  A search goes through a shard term at a time: a question's weight
times the impacts is added into a dense array over the shard's documents, whose
k greatest values, ties by id, are all that leaves it.  The shards' winners are
merged by question.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarrylight.llm.common import drop, text_of, written

#: A shard is closed at so many documents or tokens.
SHARD_DOCS, SHARD_TOKENS = 2_048, 1_000_000
#: Rows are shards of a few MB: readers decode a row group at once, so it is kept small, and its size looked at from row to row.
ROW_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4"}
#: Questions that are broadcast at a time: so many, or so many bytes of terms; each such block is one scan of the index.
BLOCK_ITEMS, BLOCK_BYTES = 10_000, 16 << 20
#: Each question's greatest so many documents.
K = 50
SHARD = "ids array<long>, terms array<binary>, bounds array<int>, docs array<int>, impacts array<int>, absent array<boolean>"

#: Bytes of UTF-8: A-Z in lower case, other ASCII but letters and digits a space, bytes of other characters themselves.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """A text's terms, with repeats."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs = total = 0
    for batch in batches:
        for text in batch.column(0):
            n = len(terms(text.as_py()))
            docs += n > 0
            total += n
    yield pa.record_batch({"docs": pa.array([docs], pa.int64()), "total": pa.array([total], pa.int64())})


class Shard:
    """Documents gathered until the shard is closed."""

    def __init__(self):
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.places: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        places = self.places
        self.parts.append(np.fromiter([places.setdefault(w, len(places)) for w in words], np.int64, len(words)))
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.tokens += len(words)

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.tokens >= SHARD_TOKENS

    def closed(self, n_docs: int, n_terms: int) -> pa.RecordBatch:
        """One row of SHARD: documents by id, null ids last, terms by their bytes."""
        names = list(self.places)
        by_name = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[by_name] = np.arange(len(names))
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        size = len(order)
        words = np.concatenate([rank[self.parts[i]] for i in order])
        keys, tf = np.unique(words * size + np.repeat(np.arange(size), [self.lengths[i] for i in order]), return_counts=True)
        term, doc = np.divmod(keys, size)
        # beyond 64 bits at very large counts: Python's whole numbers
        m = np.array([50 + 50 * self.lengths[i] * n_docs // n_terms for i in order], np.int64)
        impacts = 1_000_000_000 * tf // (1_000 * tf + 20 * m[doc])
        ids = [self.ids[i] for i in order]
        row = {
            "ids": [0 if i is None else i for i in ids],
            "terms": [names[i] for i in by_name],
            "bounds": np.searchsorted(term, np.arange(len(names) + 1)).astype(np.int32),
            "docs": doc.astype(np.int32),
            "impacts": impacts.astype(np.int32),
            "absent": [i is None for i in ids],
        }
        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_())
        return pa.record_batch([pa.array([v], pa.list_(k)) for v, k in zip(row.values(), kinds, strict=True)], list(row))


def _shards(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if words := terms(text.as_py()):
                    shard.add(doc_id.as_py(), words)
                    if shard.full:
                        yield shard.closed(n_docs, n_terms)
                        shard = Shard()
        if shard.ids:
            yield shard.closed(n_docs, n_terms)

    return run


@dataclass
class Index:
    """Shards as a table in the shared folder, one row each, with the counts that their impacts rest on."""

    shards: DataFrame
    n_docs: int
    n_terms: int

    def close(self) -> None:
        drop(self.shards)


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of every row of `docs` and all its terms.

    Null texts and texts without a term are in no list and not counted; a null id and
    repeated ids are documents like others; other columns are ignored; an empty
    table gives an index without shards.  The texts are read twice, once to count
    and once to write the shards; nothing is shuffled, and a task holds
    one open shard.  `close` deletes the table.
    """
    texts = docs.select(text_of(docs, text_col).alias("text"))
    counted = texts.mapInArrow(_count, "docs long, total long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)))
    n_docs, n_terms = counted.first()
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return Index(written(rows.mapInArrow(_shards(n_docs, n_terms), SHARD), "postings", **ROW_GROUPS), n_docs, n_terms)


def _holders(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        counts = np.zeros(len(asked), np.int64)
        for batch in batches:
            for names, bounds in zip(batch.column(0), batch.column(1), strict=True):
                sizes = np.diff(bounds.values.to_numpy())
                for i, name in enumerate(names.values.to_pylist()):
                    if (at := asked.get(name)) is not None:
                        counts[at] += sizes[i]
        some = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["place", "df"])

    return run


class Winners:
    """The k best (score, smaller id, null ids last) of one question over the shards of a task."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores = np.empty(0, np.int64)
        self.ids = np.empty(0, np.int64)
        self.absent = np.empty(0, bool)

    def add(self, totals: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        """`totals` over a shard's documents, which are by id: of those that tie for the last place the first are taken."""
        at = np.flatnonzero(totals >= self.least)
        if not len(at):
            return
        found = totals[at]
        if len(at) > self.k:
            cut = found[np.argpartition(found, len(at) - self.k)[len(at) - self.k]]
            above = found > cut
            ties = np.flatnonzero(found == cut)[: self.k - int(above.sum())]
            above[ties] = True
            at, found = at[above], found[above]
        scores, names, none = np.concatenate((self.scores, found)), np.concatenate((self.ids, ids[at])), np.concatenate((self.absent, absent[at]))
        order = np.lexsort((names, none, -scores))[: self.k]
        self.scores, self.ids, self.absent = scores[order], names[order], none[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def _search(shipped, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, asked, places, weights, bounds = shipped.value
        best = [Winners(k) for _ in items]
        for batch in batches:
            for r in range(batch.num_rows):
                ids, names, spans, docs, impacts, absent = (batch.column(c)[r].values for c in range(6))
                ids, spans, docs, impacts, absent = (x.to_numpy(zero_copy_only=False) for x in (ids, spans, docs, impacts, absent))
                there = np.full(len(asked), -1)
                for i, name in enumerate(names.to_pylist()):
                    if (at := asked.get(name)) is not None:
                        there[at] = i
                totals = np.empty(len(ids), np.int64)
                for q in range(len(items)):
                    mine = slice(bounds[q], bounds[q + 1])
                    found = there[places[mine]]
                    some = np.flatnonzero(found >= 0)
                    if not len(some):
                        continue
                    totals[:] = 0
                    for i, w in zip(found[some].tolist(), weights[mine][some].tolist(), strict=True):
                        lo, hi = spans[i], spans[i + 1]
                        totals[docs[lo:hi]] += w * impacts[lo:hi].astype(np.int64)
                    best[q].add(totals, ids, absent)
        sizes = [len(b.scores) for b in best]
        if sum(sizes):
            ids, absent, scores = (np.concatenate([getattr(b, name) for b in best]) for name in ("ids", "absent", "scores"))
            yield pa.record_batch([pa.array(np.repeat(items, sizes), pa.int64()), pa.array(ids, pa.int64(), mask=absent), pa.array(scores, pa.int64())], ["item", "doc_id", "score"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([sorted(set(terms(t.as_py()))) for t in batch.column(1)], pa.list_(pa.binary()))], ["item", "terms"])


def search(index: Index, questions: DataFrame, k: int = K, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents with a score above 0 of every row of `questions`.

    Equal scores go by doc_id, null ids last.  Null questions and those without
    a term that any document holds have no rows; repeated or null item ids are
    questions of their own, told apart by where they stand; other columns are ignored; an
    empty table or index gives no rows.  Questions are dealt into blocks by
    number and bytes, each of which is broadcast and meets every shard once; a
    task keeps k rows a question.
    """
    spark = index.shards.sparkSession
    kind = dict(questions.dtypes)[id_col]
    rows = questions.select(questions[id_col].alias("item_id"), F.monotonically_increasing_id().alias("item"), text_of(questions, text_col).alias("text"))
    asked = written(rows, "questions")
    sizes = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.max(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-sizes[0] // BLOCK_ITEMS), -(-sizes[1] // BLOCK_BYTES))
    schema = "item long, doc_id long, score long"
    found = None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).select("item", "text").mapInArrow(_asked, "item long, terms array<binary>").toArrow()
        lists = block["terms"].to_pylist()
        vocabulary = {t: i for i, t in enumerate(sorted({t for x in lists for t in x}))}
        if not vocabulary or not index.n_docs:
            continue
        shipped = spark.sparkContext.broadcast(vocabulary)
        counted = index.shards.select("terms", "bounds").mapInArrow(_holders(shipped), "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).toArrow()
        df = dict(zip(counted["place"].to_pylist(), counted["df"].to_pylist(), strict=True))
        weight = {i: math.floor(1_000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) for i, n in df.items()}
        # terms of no document, and those whose weight is 0, add nothing
        terms_of = [[i for t in x if weight.get(i := vocabulary[t])] for x in lists]
        places = np.array([i for x in terms_of for i in x], np.int64)
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in terms_of]))).astype(np.int64)
        weights = np.array([weight[i] for i in places.tolist()], np.int64)
        sent = spark.sparkContext.broadcast((block["item"].to_numpy(), vocabulary, places, weights, bounds))
        part = index.shards.mapInArrow(_search(sent, k), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], schema)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = asked.select("item", F.col("item_id").cast(kind).alias("item_id"))
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
