"""Toxicity by a factorization machine over hashed terms.

Beside a weight for each term the model has a short vector for each, whose
products weigh every pair of terms of a text: an insult beside a group counts
for more than either.  It is trained here, on a bounded sample of labelled
rows; scoring reads every whole text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bucket_of, text_of

BITS = 18
FACTORS = 8
#: The classifier is fitted on at most so many labelled rows, those with the smallest hash of their id.
SAMPLE_ROWS = 8_000
EPOCHS, BATCH, RATE, DECAY = 12, 256, 0.1, 2e-5
MIN_TEXTS = 3
#: Terms that are weighed, see informative: log-likelihood ratios alone and beside another, and the least number of terms.
TELLING, TELLING_PAIR, LEAST_TERMS = 15.0, 25.0, 256
#: Words longer than this are not kept in the tables of known words.
WORD_BYTES = 64
#: Beginnings of words count as terms too: stems of words that were never seen whole.
PREFIXES = (4, 6)


class Terms(dict):
    """Places of words and of word beginnings in the table of weights."""

    def __init__(self, mark: bytes, cached: int = 400_000):
        self.mark, self.cached = mark, cached

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=4, key=self.mark).digest(), "little") & ((1 << BITS) - 1)
        if len(word) <= WORD_BYTES:
            if len(self) > self.cached:
                self.clear()
            self[word] = value
        return value


_tables = {None: Terms(b"w"), **{k: Terms(b"p%d" % k) for k in PREFIXES}}
_edges = bytes.maketrans(b".,;:!?\"'()[]{}<>|*#%&$", b" " * 22)


def terms(text: str) -> np.ndarray:
    """Sorted distinct places of the text's terms."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_edges).split()
    found = [np.fromiter(map(table.__getitem__, words if k is None else [w[:k] for w in words]), np.int32, len(words)) for k, table in _tables.items()]
    return np.unique(np.concatenate(found))


class Machine:
    """score = sigmoid(bias + sum of w + half of (square of the sum - sum of squares) of v)."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        lengths = np.array([len(r) for r in rows])
        if not lengths.sum():
            return np.full(len(rows), self.bias)
        at = np.concatenate(rows)
        owner = np.repeat(np.arange(len(rows)), lengths)
        w = np.bincount(owner, self.w[at], len(rows))
        v = self.v[at]
        pairs = np.zeros(len(rows))
        for f in range(v.shape[1]):
            s = np.bincount(owner, v[:, f], len(rows))
            pairs += s * s - np.bincount(owner, v[:, f] ** 2, len(rows))
        return self.bias + w + 0.5 * pairs

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -30, 30)))


def ratios(ones: np.ndarray, zeros: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> np.ndarray:
    """The log-likelihood ratio by which presence tells of the label: seen in `ones` of n1 and in `zeros` of n0 texts."""
    total = np.zeros(len(ones))
    for seen, inside in ((ones, n1), (zeros, n0)):
        for part, whole in ((seen, ones + zeros), (inside - seen, n1 + n0 - ones - zeros)):
            expected = whole * inside / np.maximum(n1 + n0, 1)
            total += np.where(part > 0, part * np.log(np.where(part > 0, part, 1) / np.where(expected > 0, expected, 1)), 0)
    return total


def informative(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Which terms are weighed.

    Every term whose presence tells of the label by TELLING or more, every one that
    tells by TELLING_PAIR or more beside such a term, among the texts that have it (a
    group's name may say nothing by itself), and in any case the
    LEAST_TERMS that tell most.  Others are in fewer than MIN_TEXTS texts or would be fitted to chance.
    """
    size = 1 << BITS
    kept = np.zeros(size, bool)
    n1, n0 = float(labels.sum()), float(len(labels) - labels.sum())
    if not n1 or not n0:
        return kept
    at, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    ones = np.bincount(at, labels[owner], size)
    zeros = np.bincount(at, 1 - labels[owner], size)
    single = ratios(ones, zeros, np.full(size, n1), np.full(size, n0))
    enough = ones + zeros >= MIN_TEXTS
    single[~enough] = 0
    best = np.argsort(-single, kind="stable")[:LEAST_TERMS]
    kept[best[single[best] > 0]] = True
    telling = np.flatnonzero(single >= TELLING)
    kept[telling] = True
    has = np.zeros((len(telling), len(rows)), bool)
    place = np.full(size, -1)
    place[telling] = np.arange(len(telling))
    mine = place[at] >= 0
    has[place[at][mine], owner[mine]] = True
    for k in range(len(telling)):
        beside = has[k][owner]
        inside, y = at[beside], labels[owner[beside]]
        first, second = np.bincount(inside, y, size), np.bincount(inside, 1 - y, size)
        m1, m0 = labels[has[k]].sum(), has[k].sum() - labels[has[k]].sum()
        kept |= (ratios(first, second, np.full(size, m1), np.full(size, m0)) >= TELLING_PAIR) & (first + second >= MIN_TEXTS)
    return kept


def train(rows: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Machine:
    """Adagrad on the logistic loss; terms that aren't kept have weight 0."""
    size = 1 << BITS
    share = float(np.clip(labels.mean() if len(labels) else 0.5, 1e-3, 1 - 1e-3))
    rng = np.random.default_rng(seed)
    kept = informative(rows, labels)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.01, (size, FACTORS)))
    machine.v[~kept] = 0
    if not len(labels) or labels.min() == labels.max():
        return machine
    rows = [r[kept[r]] for r in rows]
    seen_w, seen_v = np.full(size, 1e-3), np.full((size, FACTORS), 1e-3)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), BATCH):
            part = order[lo : lo + BATCH]
            mine = [rows[i] for i in part]
            lengths = np.array([len(r) for r in mine])
            if not lengths.sum():
                continue
            at = np.concatenate(mine)
            owner = np.repeat(np.arange(len(mine)), lengths)
            error = (machine.scores(mine) - labels[part]) / len(part)
            machine.bias -= RATE * error.sum()
            used, back = np.unique(at, return_inverse=True)
            grad = np.bincount(back, error[owner], len(used)) + DECAY * machine.w[used]
            seen_w[used] += grad**2
            machine.w[used] -= RATE * grad / np.sqrt(seen_w[used])
            v = machine.v[at]
            for f in range(FACTORS):
                s = np.bincount(owner, v[:, f], len(mine))
                g = np.bincount(back, error[owner] * (s[owner] - v[:, f]), len(used)) + DECAY * machine.v[used, f]
                seen_v[used, f] += g**2
                machine.v[used, f] -= 0.2 * RATE * g / np.sqrt(seen_v[used, f])
    return machine


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([terms(t.as_py()) for t in batch.column(2)], pa.list_(pa.int32()))], ["h", "label", "terms"])


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE_ROWS) -> Machine:
    """The machine fitted on the labelled rows whose crc32(id) mod 5 is not 0, on `sample` of them at most.

    Null labels are no labels and null texts are empty; a null id joins no text; an id with
    several rows in either table gives every pair of them, within the sample; empty
    tables give the machine without evidence; other columns are ignored.
    """
    marked = labels.filter((bucket_of(labels[id_col], 5) != 0) & labels[label_col].isNotNull()).select(labels[id_col].alias("__id"), labels[label_col].cast("int").alias("label"))
    chosen = marked.select("__id", "label", F.xxhash64("__id").alias("h")).orderBy("h", "label").limit(sample)
    rows = docs.select(docs[id_col].alias("__id"), text_of(docs, text_col).alias("text")).join(F.broadcast(chosen), "__id").select("h", "label", "text")
    # an id may stand in many rows of docs: the driver gets `sample` rows at most all the same
    got = rows.mapInArrow(_features, "h long, label int, terms array<int>").orderBy("h", "label", F.xxhash64("terms")).limit(sample).toArrow()
    found = got["terms"].combine_chunks()
    values, bounds = found.values.to_numpy(), found.offsets.to_numpy()
    return train([values[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], got["label"].to_numpy().astype(float))


def _score(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(*shipped.value)
        for batch in batches:
            scores = machine.scores([terms(t.as_py()) for t in batch.column(2)]) if batch.num_rows else np.empty(0)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `docs`.

    Null and empty texts have the score of no terms; repeated rows and null ids
    are scored like others; an empty table gives no rows; other columns are
    ignored.  Without labels, or with one label only, every score is the share
    of that label.  The model has a fixed size and is broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w.astype(np.float32), machine.v.astype(np.float32)))
    rows = docs.select(docs[id_col].alias("doc_id"), (bucket_of(docs[id_col], 5) == 0).alias("held_out"), text_of(docs, text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_score(shipped), f"doc_id {kind}, held_out boolean, score double, predicted int")
