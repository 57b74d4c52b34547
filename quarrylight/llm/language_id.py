"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram's vector binds its
letters': each is permuted (rolled) by its place and all are multiplied.  A
text's vector is the sum of its n-grams' vectors, a language's that of its
texts' n-grams; the language whose profile has the greatest cosine with a text
is the text's.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bucket_of

DIM, GRAM, SEED = 1024, 3, 1
#: Texts that are bundled at once, and their code points (or one text); n-grams whose vectors are held at once.
CHUNK_TEXTS, CHUNK_CHARS, HELD = 64, 1 << 20, 4_096
#: Profiles come to the driver and are broadcast; more languages than this are refused.
MAX_LANGUAGES = 10_000
UNKNOWN = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Space:
    """The letters' vectors: drawn anew from the seed and the code point wherever they are needed, so that they agree everywhere."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED):
        if not 1 <= gram <= 3:
            raise ValueError("n-grams of one to three letters fit into 64 bits")
        self.dim, self.gram, self.seed = dim, gram, seed
        self.place = {}
        self.rolled = [np.empty((0, dim), np.int8) for _ in range(gram)]

    def _learn(self, points: np.ndarray) -> None:
        new = [p for p in points.tolist() if p not in self.place]
        if not new:
            return
        drawn = np.array([np.random.default_rng([self.seed, p]).integers(0, 2, self.dim, np.int8) * 2 - 1 for p in new], np.int8)
        for p in new:
            self.place[p] = len(self.place)
        self.rolled = [np.concatenate((old, np.roll(drawn, self.gram - 1 - j, axis=1))) for j, old in enumerate(self.rolled)]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of n-grams given as rows of code points."""
        self._learn(np.unique(grams))
        known = np.array(list(self.place), np.uint32)
        order = np.argsort(known)
        at = order[np.searchsorted(known[order], grams)]
        out = self.rolled[0][at[:, 0]]
        for j in range(1, self.gram):
            out *= self.rolled[j][at[:, j]]
        return out

    def grams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of code points, their texts' numbers, their counts): the n-grams of lower-cased letters; what stands between letters, and the ends, is one space."""
        low = [f" {t.lower()} " for t in texts]
        codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
        codes[~_letters()[codes]] = 32
        space = codes == 32
        again = np.zeros(len(codes), bool)
        again[1:] = space[1:] & space[:-1] & (owner[1:] == owner[:-1])
        codes, owner = codes[~again], owner[~again]
        windows = len(codes) - self.gram + 1
        if windows <= 0:
            return np.empty((0, self.gram), np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        points, small = np.unique(codes, return_inverse=True)
        base = len(points)
        key = owner[:windows].astype(np.int64)
        for j in range(self.gram):
            key = key * base + small[j : windows + j]
        keys, counts = np.unique(key[owner[:windows] == owner[self.gram - 1 :]], return_counts=True)
        out = np.empty((len(keys), self.gram), np.uint32)
        for j in reversed(range(self.gram)):
            keys, digit = np.divmod(keys, base)
            out[:, j] = points[digit]
        return out, keys, counts

    def bundled(self, texts: list[str], groups: np.ndarray | None = None) -> np.ndarray:
        """The texts' vectors as rows; with `groups` the sums over the texts of each group."""
        rows = np.arange(len(texts)) if groups is None else groups
        n = int(rows.max(initial=-1)) + 1
        out = np.zeros((n, self.dim))
        grams, owner, counts = self.grams(texts)
        if not len(grams):
            return out
        # a gram of several texts is bound once
        base = np.uint64(1 << 21)
        key = grams[:, 0].astype(np.uint64)
        for j in range(1, self.gram):
            key = key * base + grams[:, j]
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        row = rows[owner]
        for lo in range(0, len(first), HELD):
            held = first[lo : lo + HELD]
            mine = (place >= lo) & (place < lo + HELD)
            table = np.bincount(row[mine] * len(held) + place[mine] - lo, counts[mine], n * len(held)).reshape(n, len(held))
            # counts below 2**24 in float32 are exact, and so are the sums below
            exact = np.float64 if table.sum(axis=1).max() >= 1 << 24 else np.float32
            out += table.astype(exact) @ self.bound(grams[held]).astype(exact)
        return out


_spaces: dict[tuple[int, int, int], Space] = {}


def space(dim: int, gram: int, seed: int) -> Space:
    """One per worker process; a space that has met very many letters is begun anew."""
    key = dim, gram, seed
    if key not in _spaces or len(_spaces[key].place) > 20_000:
        _spaces[key] = Space(*key)
    return _spaces[key]


def _chunks(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pc.fill_null(pc.utf8_length(batch.column(column)), 0), np.int64)
    ends, lo = np.cumsum(sizes), 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK_CHARS, "right"))
        hi = max(lo + 1, min(hi, lo + CHUNK_TEXTS))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _profile(key: tuple[int, int, int]):
    """(lang, vector) batches, or sums of them, to one vector a language and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, sums = space(*key), {}
        for batch in batches:
            for part in _chunks(batch, 1):
                names, groups = np.unique(np.array(part.column(0).to_pylist(), object), return_inverse=True)
                for name, vector in zip(names, mine.bundled(part.column(1).to_pylist(), groups), strict=True):
                    sums[name] = sums.get(name, 0) + np.rint(vector).astype(np.int64)
            if len(sums) >= 1_000:
                yield _sums(sums)
                sums = {}
        yield _sums(sums)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = {}
    for batch in batches:
        for name, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            sums[name] = sums.get(name, 0) + vector.values.to_numpy()
        if len(sums) >= 1_000:
            yield _sums(sums)
            sums = {}
    yield _sums(sums)


def _sums(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "vector"])


class Profiles:
    """Languages and their vectors, to be broadcast."""

    def __init__(self, languages: list[str], vectors: np.ndarray, key: tuple[int, int, int]):
        self.languages, self.vectors, self.key = languages, vectors, key
        norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.unit = vectors / np.where(norm > 0, norm, 1)[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text and its cosine, 0 at least; the first by name of equal ones."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        found = space(*self.key).bundled([t or "" for t in texts])
        norm = np.sqrt((found * found).sum(axis=1))
        cosines = np.round(found @ self.unit.T / np.where(norm > 0, norm, 1)[:, None], 9)
        best = cosines.argmax(axis=1)
        letters = [any(map(str.isalpha, t or "")) for t in texts]
        names = [self.languages[b] if some else UNKNOWN for b, some in zip(best, letters, strict=True)]
        return names, np.where(letters, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dim: int = DIM, gram: int = GRAM, seed: int = SEED) -> Profiles:
    """The profiles of all languages that rows name whose crc32(id) mod 3 is not 1; every such row's whole text counts.

    Null languages and texts teach nothing, nor do texts without a letter; a
    null id counts as an empty one; repeated rows count each; an empty table
    gives no profiles; other columns are ignored.  Sums of whole numbers are
    made in each task, then in about as many tasks as the root of their number,
    then by language and place, so that no task gets all texts or vectors of a language.
    """
    key = dim, gram, seed
    taught = docs.filter((bucket_of(docs[id_col], 3) != 1) & docs[lang_col].isNotNull() & docs[text_col].isNotNull())
    parts = taught.select(docs[lang_col].alias("lang"), docs[text_col].alias("text")).mapInArrow(_profile(key), "lang string, vector array<long>")
    middle = parts.repartition(max(1, round(docs.rdd.getNumPartitions() ** 0.5))).mapInArrow(_added, "lang string, vector array<long>")
    placed = middle.select("lang", F.posexplode("vector")).groupBy("lang", "pos").agg(F.sum("col").alias("col"))
    whole = placed.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "col")))["col"].alias("vector"))
    got = whole.filter(F.exists("vector", lambda x: x != 0)).limit(MAX_LANGUAGES + 1).toArrow()
    if got.num_rows > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    rows = sorted(zip(got["lang"].to_pylist(), got["vector"].to_pylist(), strict=True))
    return Profiles([name for name, _ in rows], np.array([v for _, v in rows], np.float64).reshape(len(rows), dim), key)


def _predict(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(*shipped.value)
        for batch in batches:
            for part in _chunks(batch, 2):
                names, scores = profiles.predict(part.column(2).to_pylist())
                yield pa.record_batch([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (crc32(id) mod 3 is 1), lang_pred and score (the cosine, 0 at least) of every row of `docs`.

    Null texts and texts without a letter are `und` with score 0, and so is
    every text where nothing was learned; repeated rows and null ids are
    judged like others; of equal cosines (to nine places) the first language by name wins; an
    empty table gives no rows; other columns are ignored.  One pass, nothing is
    shuffled; a few KB a language are broadcast.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((profiles.languages, profiles.vectors, profiles.key))
    rows = docs.select(docs[id_col].alias("doc_id"), (bucket_of(docs[id_col], 3) == 1).alias("held_out"), docs[text_col].alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_predict(shipped), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
