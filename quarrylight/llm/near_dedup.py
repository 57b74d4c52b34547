"""Near-duplicate detection by MinHash with tensored banding.

Two collections of `bands` short tuples of `rows` min-hashes each are computed;
a table is a pair of one tuple from either, so 2 * bands tuples give
bands * bands tables (128 min-hashes serve 256 tables of 8 rows here).  Two
sets of similarity s meet in some table with probability
(1 - (1 - s^rows)^bands)^2: all but 2e-5 of the pairs at 0.85, 4e-4 at 0.80.

Equal sets are one node.  What is asked for are connected components, so a
bucket need not become pairs: its members are compared with its smallest and
its largest member, links are merged into components, and only members of
buckets that still hold several components are compared further, until no
bucket has two members of different components that have not been compared.
Buckets too large for that are split by what their members differ in from one
member (exact, see delta_buckets) and, if still large, compared with PIVOTS members a round.  Every link is confirmed on full
shingle sets.

Texts travel once a comparison: those of a centre's partners go to the centre,
in parts of at most PART partners with a copy of the centre's text each, so
that a centre with a third of all rows is many tasks' work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bucketed, drop, sieve, text_of, written

BANDS, ROWS = 16, 4
#: Buckets of up to this many members give their remaining pairs at once: a fixed number a bucket.
SMALL_BUCKET = 8
#: The same for buckets of rare elements, whose members hold one or few pairs of different components.
PREFIX_BUCKET = 512
#: Members of a large bucket that are compared with all others in a round, and partners that share a copy of a centre's text.
PIVOTS, PART = 64, 256
#: Edges that lie in one partition: some megabytes.
FEW = 200_000
#: Classes of members by their distance from the centre, see delta_buckets.
CLASSES = 32
#: Words that are kept with their hashes: so many, none longer than so many bytes.
WORDS_CACHED, WORD_BYTES = 100_000, 64


class WordHashes(dict):
    """64-bit hashes of words, computed once each unless they are long."""

    def __missing__(self, word: bytes) -> int:
        value = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= WORD_BYTES:
            if len(self) > WORDS_CACHED:
                self.clear()
            self[word] = value
        return value


_words = WordHashes()
_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S = np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _M1
    x = (x ^ (x >> _S)) * _M2
    return x ^ (x >> _S)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `width` words of the text with A-Z in lower case."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    k = min(width, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h * _M3 + w[i : i + n])
    return np.unique(h)


@lru_cache
def multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_117)
    return rng.integers(0, 2**64, n, np.uint64)[:, None] | np.uint64(1), rng.integers(0, 2**64, n, np.uint64)[:, None]


def tuples(found: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """2 * bands hashes, each of `rows` min-hashes and its place; the lowest bit tells the collection."""
    a, b = multipliers(2 * bands * rows)
    low = np.full(len(a), np.uint64(2**64 - 1))
    for at in range(0, len(found), 4096):
        low = np.minimum(low, (found[None, at : at + 4096] * a + b).min(axis=1))
    out = np.arange(2 * bands, dtype=np.uint64)
    for column in low.reshape(2 * bands, rows).T:
        out = _mixed(out * _M3 + column)
    return out & ~np.uint64(1) | (np.arange(2 * bands) >= bands).astype(np.uint64)


def _signatures(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 1_000) for b in batches for at in range(0, b.num_rows, 1_000)):
            sizes, digests, bandings = [], [], []
            for text in batch.column(1):
                found = shingles(text.as_py(), width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bandings.append(tuples(found, bands, rows).view(np.int64) if len(found) else np.empty(0, np.int64))
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bandings, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"]
            )

    return run


def _beside_centres(width: int, columns: list[str], types: list[pa.DataType], look):
    """Rows (x, part, y, text) in order, a centre's own (null y) first: `look(x, y, centre's set, own set)` gives a row or None for each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, centre = None, np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for x, y, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if y is None:
                    if known != x:
                        known, centre = x, shingles(text.as_py(), width)
                    continue
                row = look(x, y, centre, shingles(text.as_py(), width))
                if row is not None:
                    rows.append(row)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)], columns)

    return run


def _confirm(width: int, percent: int):
    def look(x: int, y: int, centre: np.ndarray, other: np.ndarray) -> tuple | None:
        both = len(np.intersect1d(centre, other, assume_unique=True))
        return (x, y) if 100 * both >= percent * (len(centre) + len(other) - both) else None

    return _beside_centres(width, ["x", "y"], [pa.int64(), pa.int64()], look)


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every id in `links` (x, y): alternating large and small stars until nothing changes.

    Each step is an aggregate with map-side combine and a join that adaptive
    execution can split; a step's edges are written to the shared folder.  FEW edges
    or less lie in one partition, where steps need no shuffle: the same steps, planned for their size.
    """
    edges = written(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "edges")
    state, now = None, (edges.count(), 0)
    while state != now:
        state = now
        few = edges.coalesce(1) if now[0] <= FEW else edges
        both = few.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        done = written(small, "edges")
        drop(edges)
        edges = done
        now = tuple(edges.agg(F.count("*"), F.expr("coalesce(bit_xor(xxhash64(u, v)), 0)")).first())
    few = edges.coalesce(1) if now[0] <= FEW else edges
    done = written(few.select(F.inline(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("comp")), F.struct(F.col("v").alias("id"), F.col("v").alias("comp"))))).distinct(), "comps")
    drop(edges)
    return done


class Clusters:
    """Components so far, the pairs already compared, and the texts to compare them on."""

    def __init__(self, texts: DataFrame, sizes: DataFrame, width: int, percent: int):
        self.texts, self.sizes, self.width, self.percent = texts, sizes, width, percent
        self.links: DataFrame | None = None
        self.comps: DataFrame | None = None
        self.tried: DataFrame | None = None
        self.held: list[DataFrame] = []

    def with_comp(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        if self.comps is None:
            return rows.withColumn(name, F.col(column))
        found = self.comps.select(F.col("id").alias(column), F.col("comp").alias("__c"))
        return rows.join(found, column, "left").withColumn(name, F.coalesce("__c", column)).drop("__c")

    def compare(self, pairs: DataFrame) -> None:
        """Confirm pairs (x, y) of different components that were not compared before, and merge what is linked."""
        pairs = pairs.select("x", "y")
        pairs = self.with_comp(self.with_comp(pairs, "x", "cx"), "y", "cy").filter("cx <> cy").select("x", "y").distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["x", "y"], "left_anti")
        size = lambda c: self.sizes.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"))
        sized = pairs.join(size("x"), "x").join(size("y"), "y")
        todo = written(sized.filter(100 * F.least("nx", "ny") >= self.percent * F.greatest("nx", "ny")).select("x", "y"), "pairs")
        self.tried = todo if self.tried is None else self.tried.unionByName(todo)
        links = written(self.beside_centres(todo).mapInArrow(_confirm(self.width, self.percent), "x long, y long"), "links")
        self.held += [todo, links]
        self.links = links if self.links is None else self.links.unionByName(links)
        self.merge(links)

    def merge(self, links: DataFrame) -> None:
        """Take new links into the components: they join components, whose names change where two become one."""
        if self.comps is None:
            self.comps = components(links)
            return
        if not links.head(1):
            return
        joined = self.with_comp(self.with_comp(links, "x", "cx"), "y", "cy").select(F.col("cx").alias("x"), F.col("cy").alias("y"))
        names = components(joined)
        renamed = self.comps.join(names.select(F.col("id").alias("comp"), F.col("comp").alias("name")), "comp", "left").select("id", F.coalesce("name", "comp").alias("comp"))
        fresh = names.join(self.comps.select("id"), "id", "left_anti").select("id", "comp")
        done = written(renamed.unionByName(fresh), "comps")
        drop(self.comps)
        drop(names)
        self.comps = done

    def beside_centres(self, pairs: DataFrame) -> DataFrame:
        """(x, part, y, text) for pairs (x, y): the texts of the ys beside their x, whose own row with a null y comes first in each part."""
        centres = pairs.groupBy("x").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        text = lambda c: self.texts.select(F.col("id").alias(c), "text")
        part = F.pmod(F.xxhash64("y"), F.col("parts")).cast("int")
        others = pairs.join(centres, "x").select("x", part.alias("part"), "y").join(text("y"), "y")
        own = centres.select("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("y")).join(text("x"), "x")
        rows = others.select("x", "part", "y", "text").unionByName(own.select("x", "part", "y", "text"))
        return rows.repartition("x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())

    def close(self) -> None:
        """Delete the tables that only comparisons read."""
        for table in [self.texts, *self.held]:
            drop(table)

    def open_buckets(self, buckets: DataFrame) -> DataFrame:
        """The rows (key, id) of buckets that hold more than one component, with comp and the bucket's size."""
        rows = self.with_comp(buckets, "id", "comp")
        mixed = rows.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("n")).filter("c0 < c1")
        return rows.join(mixed.select("key", "n"), "key")


def _cross(rows: DataFrame) -> DataFrame:
    """Pairs of members of one bucket in different components and on fitting sides; for small buckets.

    Of buckets with the same members one is enough; they are told by two sums of hashes and their size.
    """
    mark = lambda seed: F.sum(F.shiftright(F.xxhash64(F.lit(seed), "id", "side"), 12))
    marked = rows.groupBy("key").agg(mark(1).alias("a"), mark(2).alias("b"), F.count("*").alias("size"))
    rows = rows.join(marked.groupBy("a", "b", "size").agg(F.min("key").alias("key")).select("key"), "key")
    other = rows.select("key", F.col("id").alias("y"), F.col("comp").alias("cy"), F.col("side").alias("sy"))
    return rows.select("key", F.col("id").alias("x"), "comp", "side").join(other, "key").filter("x < y AND comp <> cy AND side + sy = 0").select("x", "y").distinct()


def _deltas(width: int):
    def look(c: int, x: int, centre: np.ndarray, own: np.ndarray) -> tuple:
        return c, x, len(own), np.setxor1d(centre, own, assume_unique=True).view(np.int64)

    return _beside_centres(width, ["c", "id", "n", "delta"], [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())], look)


def delta_buckets(found: Clusters, rows: DataFrame) -> DataFrame:
    """(key, id, side) buckets, small as a rule, that hold every pair still to be compared in large buckets (key, id).

    Members are described by their difference to one member c, well linked if
    possible.  With d = |x delta c| and G(x) = (100 + p) d(x) - (100 - p) |x|,
    x and y are linked exactly if their differences share at least
    (G(x) + G(y)) / 2 (100 + p) shingles.  Where that is not above 0 the member
    with the least G is linked with both; all other linked pairs share one of
    the rarest elements of their differences (prefix filtering), how many depending on
    both: members are classed by G and meet in buckets of two classes, where
    `side` tells them apart: pairs of one class are those of its own bucket (0 and 0), others those of -1 and 1.
    """
    p = found.percent
    degree = found.links.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("deg"))
    best = lambda rows, by: rows.groupBy(by).agg(F.max_by("id", F.struct(F.coalesce("deg", F.lit(0)), -F.col("id"))).alias("c"))
    known = found.with_comp(rows, "id", "comp").join(degree, "id", "left")
    heads = found.with_comp(best(known, "key"), "c", "comp").select("key", "comp")
    grouped = written(rows.join(heads.join(best(known, "comp"), "comp").select("key", "c"), "key").select(F.col("c").alias("x"), F.col("id").alias("y")).distinct(), "grouped")
    deltas = written(found.beside_centres(grouped).mapInArrow(_deltas(found.width), "c long, id long, n long, delta array<long>").withColumn("g", (100 + p) * F.size("delta") - (100 - p) * F.col("n")), "deltas")
    least = deltas.groupBy("c").agg(F.min("g").alias("g0"), F.min_by("id", "g").alias("y0"), F.expr(f"(max(g) - min(g)) div {CLASSES} + 1").alias("step"))
    measured = deltas.join(least, "c")
    found.compare(measured.filter("g + g0 <= 0 AND id <> y0").select(F.least("id", "y0").alias("x"), F.greatest("id", "y0").alias("y")))
    elements = measured.select("c", "id", "g", "g0", "step", F.size("delta").alias("d"), F.explode("delta").alias("e")).withColumn("key", F.xxhash64("c", "e"))
    common = found.with_comp(elements.select("key", "id"), "id", "comp").groupBy("key").agg(F.count("*").alias("df"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).filter("c0 < c1").select("key", "df")
    listed = elements.join(common, "key").groupBy("c", "id", "g", "g0", "step", "d").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("all"))
    classed = listed.withColumn("own", F.expr("(g - g0) div step")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(CLASSES - 1))))
    need = F.greatest(F.lit(1), F.ceil((F.col("g") + F.col("g0") + F.col("other") * F.col("step")) / (2 * (100 + p))))
    # elements of one component alone come first in the order and lead to no pair: they use up the prefix
    rest = F.col("d") - need + 1 - (F.col("d") - F.size("all"))
    picked = classed.withColumn("rest", rest.cast("int")).filter("rest > 0").withColumn("s", F.explode(F.slice("all", F.lit(1), F.col("rest"))))
    return picked.select("id", F.xxhash64("s.key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept.

    Null and texts without words have an empty set and are linked with
    nothing; texts of fewer words than `width` are one shingle.  Rows that
    share an id count as one document and are linked.  Rows without an id have no
    component (null), are linked with nothing and kept.  An empty table gives
    no rows; other columns are ignored.  `docs` is read three times.
    """
    plain = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    signed = written(plain.mapInArrow(_signatures(width, bands, rows), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signatures")
    usable = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # only sets that occur again are brought together: the others are nodes where they stand
    again = written(usable.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"), "copied")
    copied = sieve(usable, "digest", again).groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    alone = sieve(usable, "digest", again, inside=False).select("digest", F.col("doc_id").alias("id"), "n_shingles", "bands")
    nodes = alone.unionByName(written(copied, "nodes"))
    sizes = written(nodes.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")), "sizes")

    # tuples that no other node has can be in no shared table: they go before tables are formed
    parts = nodes.select("id", F.explode("bands").alias("part"))
    shared = written(parts.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1").select("part"), "shared")
    alive = sieve(parts, "part", shared).join(shared, "part").groupBy("id").agg(F.collect_set("part").alias("parts"))
    first = F.filter("parts", lambda p: p.bitwiseAND(F.lit(1)) == 0)
    second = F.filter("parts", lambda p: p.bitwiseAND(F.lit(1)) == 1)
    keys = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(a, b))))
    tables = written(alive.select("id", F.explode(keys).alias("key")), "tables")
    ends = written(tables.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi"), "ends")
    met = written(sieve(tables, "key", ends).join(ends, "key"), "met")
    drop(tables)
    drop(ends)
    stars = met.select("id", F.explode(F.array("lo", "hi")).alias("end")).filter("id <> end")
    pairs = written(stars.select(F.least("id", "end").alias("x"), F.greatest("id", "end").alias("y")).groupBy("x", "y").agg(F.count("*").alias("n")), "stars")

    drop(shared)
    members = written(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct(), "members")
    named = plain.select(F.col("doc_id").alias("id"), "text")
    texts = bucketed(sieve(named, "id", members).join(members, "id", "left_semi"), "id", "texts")
    drop(members)
    found = Clusters(texts, sizes, width, percent)
    found.compare(pairs.groupBy("y").agg(F.max_by("x", "n").alias("x")))
    found.compare(pairs)
    drop(pairs)

    left = met.filter("id <> lo AND id <> hi").select("key", "id")
    still = written(found.open_buckets(left.withColumn("side", F.lit(0))), "open")
    drop(met)
    found.compare(_cross(still.filter(F.col("n") <= SMALL_BUCKET)))
    large = written(found.open_buckets(still.filter(F.col("n") > SMALL_BUCKET).select("key", "id")).select("key", "id"), "large")
    drop(still)
    if large.head(1):
        buckets = written(delta_buckets(found, large), "prefixes")
        settle(found, buckets)
    drop(large)

    # ids that were minima of several sets, then the component's smallest id (a component's name is its smallest node)
    node_comp = found.with_comp(nodes.select("digest", "id"), "id", "comp").select("digest", "comp")
    labelled = usable.join(node_comp, "digest").select("doc_id", "n_shingles", "comp")
    split = labelled.groupBy("doc_id").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b")
    if split.head(1):
        final = components((found.links.select("x", "y")).unionByName(labelled.select(F.col("doc_id").alias("x"), F.col("comp").alias("y"))))
        labelled = labelled.join(final.select(F.col("id").alias("comp"), F.col("comp").alias("__c")), "comp", "left").select("doc_id", "n_shingles", F.coalesce("__c", "comp").alias("comp"))
    found.close()
    rest = signed.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("comp"))
    return labelled.unionByName(rest).select("doc_id", "n_shingles", F.col("comp").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("comp"), F.lit(True)).alias("kept"))


def settle(found: Clusters, buckets: DataFrame) -> None:
    """Compare all that is left to compare in `buckets` (key, id, side), which is dropped.

    Small buckets give their pairs at once.  Of others about PIVOTS members a
    round (those whose hash falls low, and the smallest) are compared with
    all and leave: a bucket of n members takes n / PIVOTS rounds, in which every pair is
    one that the prefix filter could not settle.
    """
    while True:
        rows = written(found.open_buckets(buckets).select("key", "id", "side", "comp", "n"), "round")
        drop(buckets)
        if rows.head(1):
            found.compare(_cross(rows.filter(F.col("n") <= PREFIX_BUCKET)))
        large = rows.filter(F.col("n") > PREFIX_BUCKET)
        first = large.groupBy("key").agg(F.min("id").alias("first"))
        marked = written(large.join(first, "key").withColumn("pivot", (F.col("id") == F.col("first")) | (F.pmod(F.xxhash64("id", "key"), F.col("n")) < PIVOTS)).drop("first"), "pivots")
        drop(rows)
        if not marked.head(1):
            drop(marked)
            return
        pivots = marked.filter("pivot").select("key", F.col("id").alias("p"), F.col("side").alias("ps"))
        met = marked.join(pivots, "key").filter("id <> p AND side + ps = 0")
        found.compare(met.select(F.least("id", "p").alias("x"), F.greatest("id", "p").alias("y")).distinct())
        buckets = written(marked.filter("NOT pivot").select("key", "id", "side"), "prefixes")
        drop(marked)
