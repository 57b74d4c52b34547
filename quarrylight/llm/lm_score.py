"""Language-model scores by online logistic context mixing.

A byte, or the end of the text, is coded as the binary decisions on its path
through a Huffman tree of what follows the byte before it in the training texts.  For each decision, predictors
keyed by hashes of the last 3 and 5 bytes and the tree's node give log odds
from counts over the whole training corpus.  A mixer adds them with weights
chosen by a gate (how much the two contexts have seen), and a last stage
corrects the sum by where it lies.  Weights and corrections are refined online
along each text, in steps that grow from 32 to 4,096 bytes: a step is predicted
with what the steps before it taught, so every probability depends on
earlier bytes alone.

Beside the bits stands a predictor of long contexts, whose memory grows with
the corpus: texts are cut into segments where a hash of four bytes says so, and of
every hash of 16 bytes before a segment the segments that followed it in the
training texts are counted, by shuffles.  A text's own occurrences are taken off,
so that what counts is what other texts say.  The probability of a segment is
l * share among those that followed + (1 - l) * that of its bits, with l
gated by how much was seen and whether the last one was known, and refined along the
text as well.

The tables of the bit predictors grow with the corpus up to 2^20 and 2^21
places, as they are broadcast; contexts that no place is left for share one, which
gates and weights make up for.  Words of the unigram base are counted exactly:
frequent ones are looked up in a broadcast table of bounded size, all others through a shuffle.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import bucket_of, drop, text_of, written

ORDERS = (3, 5)
#: Places of an order's table: a quarter of the training bytes, within these bounds; some 12 bytes each in a counting task.
LEAST_BITS, TABLE_BITS = 16, (20, 21)
SLICES = 16
END = 256
#: Bytes counted, bytes scored side by side, and bytes whose scores are held, at a time (a longer text is one by itself).
CHUNK, GROUP, BATCH = 1 << 21, 1 << 19, 1 << 23
#: Symbols of a step that are predicted at once, whole texts' shares, so that their arrays stay in a core's cache.
BLOCK = 1 << 15
#: Bytes predicted with what those before taught: the first steps, then twice as many up to the last.
STEPS, STEP = (32, 64, 128, 256, 512, 1024, 2048), 4096
#: As many gates as ranges, so that a text's begin at the same place.
GATES = RANGES = 16
UNIT = 512
START_WEIGHT, RATE, CORRECTION_RATE, FULL_STEP = 0.6, 0.02, 0.02, 512
#: A segment has 128 bytes on average and a context of 16.
ANCHOR_MASK, CONTEXT = 127, 16
#: Words of the broadcast table and their longest length in bytes: about 13 MB at most.
FREQUENT, FREQUENT_BYTES = 100_000, 64
#: Rows of words that are brought together at a time in a counting task.
WORD_ROWS = 1 << 20
HELD_OUT = 7, 2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_powers = [np.empty(0, np.uint64), np.empty(0, np.uint64)]
EVENT = pa.struct([("idx", pa.int32()), ("key", pa.int64()), ("next", pa.int64()), ("log", pa.float32())])


def paths(counts: list[int]) -> list[list[tuple[int, int]]]:
    """For each symbol its path of (node, bit) in a Huffman tree of the counts."""
    n = len(counts)
    ids = itertools.count(n)
    heap = [(c + 1, b, b) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    up: dict[int, tuple[int, int]] = {}
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        made = next(ids)
        up[x], up[y] = (made, 0), (made, 1)
        heapq.heappush(heap, (a + b, made, made))
    out = []
    for b in range(n):
        path, at = [], b
        while at in up:
            at, bit = up[at]
            path.append((at - n, bit))
        out.append(path[::-1])
    return out


class Code:
    """Binary codes of bytes and the end (256), one for each byte before; `counts` has 256 rows of 257."""

    def __init__(self, counts: np.ndarray):
        flat = [p for row in counts.tolist() for p in paths(row)]
        self.length = np.array([len(p) for p in flat])
        self.offset = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        node = np.array([n for p in flat for n, _ in p], np.int64)
        self.bit = np.array([b for p in flat for _, b in p], np.int8)
        #: what a node adds to the place of its context: the first nodes of the paths have places side by side
        self.step = node.astype(np.int16)
        self.turn = self.step << 1 | self.bit

    def decisions(self, before: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which symbol, twice the step and the bit) of every decision for the symbols after the bytes `before`, and where each symbol's decisions end."""
        code = before * 257 + symbol
        lengths = self.length[code]
        ends = np.cumsum(lengths)
        which = np.repeat(np.arange(len(code)), lengths)
        entry = (self.offset[code] - (ends - lengths))[which]
        entry += np.arange(len(which))
        return which, self.turn[entry], ends


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def contexts(back: list[np.ndarray]) -> list[np.ndarray]:
    """For each order the bytes before each place as a number, the last one lowest; back[k] are the bytes k + 1 before it."""
    out, h = [], np.zeros(back[0].shape, np.uint64)
    for k, b in enumerate(back, 1):
        one = b.astype(np.uint64)
        one <<= np.uint64(8 * k - 8)
        h |= one
        if k in ORDERS:
            out.append(h.copy())
    return out


def hashed(k: int, context: np.ndarray) -> np.ndarray:
    """32 bits of the k-th order's contexts, from which a node's step leads to a place."""
    return ((context * _MIX[k]) >> np.uint64(32)).view(np.int64)


def table_bits(n_bytes: int) -> list[int]:
    return [min(most, max(LEAST_BITS, (n_bytes >> 2).bit_length())) for most in TABLE_BITS]


def _groups(texts: Iterator[bytes], size: int) -> Iterator[list[bytes]]:
    group, total = [], 0
    for t in texts:
        if group and total + len(t) > size:
            yield group
            group, total = [], 0
        group.append(t)
        total += len(t) + 1
    if group:
        yield group


def keep_heap() -> None:
    """malloc gives freed memory back above twice the largest array that was ever freed (32 MB at most); without this it does so after every step, and asks again."""
    np.empty(31 << 20, np.uint8)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of the texts, and the text that each is from; cut as by `bytes.split()`."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = split.flatten().cast(pa.binary())
    some = pc.greater(pc.binary_length(words), 0)  # white space at a text's ends leaves empty ones
    return words.filter(some), owner[some.to_numpy(zero_copy_only=False)]


def _slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many bytes of the column's texts, one text at least."""
    lengths = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and held + n > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: list[pa.Table] = []
    n_texts = 0
    following = np.zeros(256 * 257, np.int64)

    def rows(kind: int, words: pa.Array, n: pa.Array) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(words), kind, np.int32)), words, n], ["kind", "word", "n"])

    def together() -> pa.Table:
        return pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("n", "sum")]).select(["word", "n_sum"]).rename_columns(["word", "n"])

    for part in (x for batch in batches for x in _slices(batch, 0, CHUNK)):
        counted = words_of(part.column(0))[0].value_counts()
        found.append(pa.table([counted.field("values"), counted.field("counts")], ["word", "n"]))
        if sum(map(len, found)) > WORD_ROWS:
            found[:] = [together()]
            if 2 * len(found[0]) > WORD_ROWS:
                for x in found.pop().to_batches():
                    yield rows(0, *x.columns)
        group = [lowered(t.as_py()) for t in part.column(0)]
        n_texts += len(group)
        x = np.frombuffer(b"\0" + b"\0".join(group) + b"\0", np.uint8).astype(np.int64)
        pair = x[:-1] * 257 + x[1:]
        last = np.cumsum([len(data) + 1 for data in group]) - 1
        pair[last] = x[last] * 257 + END
        following += np.bincount(pair, minlength=256 * 257)
    if n_texts:  # as many ends
        found.append(pa.table([pa.array([b""], pa.binary()), pa.array([n_texts], pa.int64())], ["word", "n"]))
        for x in together().to_batches():
            yield rows(0, *x.columns)
    used = np.flatnonzero(following)
    yield rows(1, pa.array([int(x).to_bytes(3, "big") for x in used], pa.binary()), pa.array(following[used], pa.int64()))


def symbols(texts: list[bytes], lo: int = 0, hi: int | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The symbols lo to hi of the texts, of which each has some, one text after another with its end; their contexts; and where each text's end. Before a text stand zeros."""
    top = ORDERS[-1]
    pad = bytes(max(0, top - lo))
    ended = np.array([hi is None or len(t) < hi for t in texts])
    flat = np.frombuffer(b"".join([x for t, e in zip(texts, ended.tolist(), strict=True) for x in (pad, t[max(0, lo - top) : hi], b"\0" if e else b"")]), np.uint8)
    width = np.array([len(t) + 1 if e else hi for t, e in zip(texts, ended.tolist(), strict=True)]) - lo
    ends = np.cumsum(width)
    place = np.arange(ends[-1])
    place += np.repeat(np.arange(len(texts)) * top, width)
    symbol = flat[top:].astype(np.int64)[place]
    symbol[ends[ended] - 1] = END
    return symbol, [c[place] for c in contexts([flat[top - k : len(flat) - k] for k in range(1, top + 1)])], ends


def count_into(counts: list[np.ndarray], code: Code, texts: list[bytes]) -> None:
    """Add the decisions of the texts to counts[order][place of the table, bit]; equal contexts with equal symbols are taken together."""
    data, found, _ = symbols(texts)
    data = data.view(np.uint64)
    for k, (count, context) in enumerate(zip(counts, found, strict=True)):
        for at in range(0, len(data), CHUNK):
            pair = context[at : at + CHUNK] << np.uint64(9) | data[at : at + CHUNK]
            pair.sort()
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
            times = np.diff(first, append=len(pair)).astype(np.int32)
            pair = pair[first]
            ending = pair.view(np.int64)
            which, turn, _ = code.decisions(ending >> 9 & 255, ending & 511)
            slot = (hashed(k, pair >> np.uint64(9)) << 1)[which]
            slot += turn
            slot &= len(count) - 1
            np.add.at(count, slot, times[which])


def _count_bits(code: Code, bits: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(2 << b, np.int32) for b in bits]
        some = False
        keep_heap()
        for group in _groups((lowered(t.as_py()) for batch in batches for t in batch.column(0)), CHUNK):
            count_into(counts, code, group)
            some = True
        if some:
            for k, c in enumerate(counts):
                for i, part in enumerate(np.split(c, SLICES)):
                    blob = pa.compress(np.ascontiguousarray(part.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)
                    yield pa.record_batch([pa.array([k * SLICES + i], pa.int32()), pa.array([blob], pa.binary())], ["slice", "counts"])

    return run


def _odds_of(bits: list[int]):
    def run(rows: pa.Table) -> pa.Table:
        n = (2 << bits[rows["slice"][0].as_py() // SLICES]) // SLICES
        total = np.zeros(n, np.int64)
        for blob in rows["counts"]:
            planes = np.frombuffer(pa.decompress(blob.as_py(), 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
            total += np.ascontiguousarray(planes.T).view(np.int32).ravel()
        return pa.table([rows["slice"].slice(0, 1), pa.array([odds(total).tobytes()], pa.binary())], ["slice", "odds"])

    return run


def odds(counts: np.ndarray) -> np.ndarray:
    """For pairs of counts: log odds in 1/512, and in the two low bits how much was seen."""
    zero, one = counts[0::2], counts[1::2]
    n = zero + one
    value = np.log((one + 0.4) / (zero + 0.4))
    seen = (n > 0).astype(np.int16) + (n > 3) + (n > 30)
    return (np.clip(np.rint(value * 512), -8190, 8190).astype(np.int16) << 2) | seen.astype(np.int16)


def log_probabilities(texts: list[bytes], code: Code, tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each text the natural log probability of each of its bytes and the end; what is read of a text depends on that text alone.

    Texts stand side by side, the longest first, and are stepped through
    together, some at a time: arrays have the size of a block or of one text's step, whatever the lengths.
    """
    rank = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    sizes = np.array([len(texts[i]) + 1 for i in rank])
    out = [np.zeros(len(t) + 1, np.float32) for t in texts]
    weights = [np.full(len(texts) * GATES, START_WEIGHT / UNIT, np.float32) for _ in ORDERS]
    shift = np.zeros(len(texts) * RANGES, np.float32)
    lo, steps = 0, iter(STEPS)
    while lo < sizes[0]:
        hi = lo + next(steps, STEP)
        alive = int(np.searchsorted(-sizes, -lo, side="left"))  # sizes above lo
        ends = np.cumsum(np.minimum(sizes[:alive], hi) - lo)
        first = 0
        while first < alive:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + BLOCK, side="right")))
            mine = slice(first * GATES, last * GATES)
            some = rank[first:last]
            parts = step_through([texts[i] for i in some], lo, hi, code, tables, [w[mine] for w in weights], shift[mine])
            for i, part in zip(some, parts, strict=True):
                out[i][lo : lo + len(part)] = part
            first = last
        lo = hi
    return out


def step_through(texts: list[bytes], lo: int, hi: int, code: Code, tables: list[np.ndarray], weights: list[np.ndarray], shift: np.ndarray) -> list[np.ndarray]:
    """The log probabilities of the symbols lo to hi of each text; `weights` and `shift` are the texts' own, and are refined."""
    symbol, before, ends = symbols(texts, lo, hi)
    which, turn, decided = code.decisions((before[0] & np.uint64(255)).view(np.int64), symbol)
    sign = ((turn & 1) * 2 - 1).astype(np.float32)
    step = (turn >> 1).astype(np.int64)
    found = []
    for k, (t, c) in enumerate(zip(tables, before, strict=True)):
        slot = hashed(k, c)[which]
        slot += step
        slot &= len(t) - 1
        found.append(t[slot])
    mine = np.repeat(np.arange(len(texts)) * GATES, np.diff(decided[ends - 1], prepend=0))
    chosen = mine + ((found[-1] & 3) << 2 | (found[-2] & 3))
    inputs = [(f >> 2).astype(np.float32) for f in found]  # in 1/512, as the weights know
    z = weights[0][chosen] * inputs[0]
    for k in range(1, len(ORDERS)):
        z += weights[k][chosen] * inputs[k]
    np.clip(z, -15.9, 15.9, out=z)
    where = ((z + 16) * (RANGES / 32)).astype(np.int64)
    where += mine
    z += shift[where]
    z *= sign
    refined = np.exp(-z)
    per = -np.bincount(which, np.log1p(refined), len(symbol))
    if max(map(len, texts)) >= hi:  # one of them goes on
        error = sign * (refined / (1 + refined))
        pace = RATE / 8 * min(1.0, FULL_STEP / (hi - lo))  # long steps teach by their average
        for w, x in zip(weights, inputs, strict=True):
            w += (pace / UNIT**2 * np.bincount(chosen, error * x, len(w))).astype(np.float32)
        usual = 4 * (hi - lo) / RANGES  # decisions of a text in a range, about
        shift += (CORRECTION_RATE / math.sqrt(usual + 1) * np.bincount(where, error, len(shift))).astype(np.float32)
        np.clip(shift, -3, 3, out=shift)
    return np.split(per, ends[:-1])


def powers_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse; those for texts of a megabyte are kept."""
    if n > len(_powers[0]):
        made = []
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            run = np.full(n, base, np.uint64)
            run[0] = 1
            made.append(np.multiply.accumulate(run))
        if n > 1 << 20:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def segments(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash of the CONTEXT bytes before, hash of the bytes up to the next start) of the segments from CONTEXT on."""
    return segments_of([data])[0]


def segments_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The `segments` of each text, found in all of them at once."""
    data = b"".join(texts)
    n = len(data)
    if n <= CONTEXT:
        return [(np.empty(0, np.int64),) * 3] * len(texts)
    b = np.frombuffer(data, np.uint8)
    four = b[:-3].astype(np.uint32)
    for k in (1, 2, 3):
        four <<= np.uint32(8)
        four |= b[k : n - 3 + k]
    anchor = ((four * np.uint32(0x9E3779B1)) >> np.uint32(20) & np.uint32(ANCHOR_MASK)) == 0
    anchor[1:] &= four[1:] != four[:-1]  # a long run of one byte is no row of anchors
    start = np.flatnonzero(anchor) + 4
    start = start[start < n]
    stops = np.cumsum([len(t) for t in texts])
    begins = np.append(0, stops[:-1])
    owner = np.searchsorted(stops, start, side="right")
    inside = start - begins[owner] >= CONTEXT  # the bytes before are the same text's
    start, owner = start[inside], owner[inside]
    stop = np.minimum(np.append(start[1:], n), stops[owner])
    powers, back = powers_of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * powers[:-1], out=sums[1:])

    def digest(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        # (sum over lo..hi of byte * base^place) / base^lo, then mixed with the length
        h = (sums[hi] - sums[lo]) * back[lo]
        h = (h ^ (h >> np.uint64(31))) * _MIX[1] + (hi - lo).astype(np.uint64) * _MIX[2]
        return (h ^ (h >> np.uint64(29))).view(np.int64)

    cuts = np.searchsorted(owner, np.arange(1, len(texts)))
    return list(zip(*(np.split(x, cuts) for x in (start - begins[owner], digest(start - CONTEXT, start), digest(start, stop))), strict=True))


def listed(lengths: list[int], values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), values)


def _score(shipped):
    def scored(part: pa.RecordBatch) -> pa.RecordBatch:
        code, tables, (frequent, frequent_logs) = shipped.value
        texts = [lowered(t.as_py()) for t in part.column(3)]
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        bits_log, events = np.zeros(len(texts)), [()] * len(texts)
        at = 0
        for group in _groups((texts[i] for i in order), GROUP):
            for i, log, (start, key, after) in zip(order[at:], log_probabilities(group, code, tables), segments_of(group), strict=False):
                total = np.concatenate([[0.0], np.cumsum(log, dtype=np.float64)])
                ends = np.append(start[1:], len(texts[i]))[: len(start)]
                bits_log[i] = total[-1]
                events[i] = np.arange(len(start), dtype=np.int32), key, after, (total[ends] - total[start]).astype(np.float32)
            at += len(group)

        words, owner = words_of(part.column(3))
        words = pa.concat_arrays([words, pa.array([b""] * len(texts), pa.binary())])  # the ends
        owner = np.concatenate([owner, np.arange(len(texts))])
        place = pc.index_in(words, frequent)
        rare = place.is_null().to_numpy(zero_copy_only=False)
        told = owner[~rare]
        logs = np.bincount(told, frequent_logs[place.drop_null().to_numpy()], len(texts))
        others: list[Counter] = [Counter() for _ in texts]
        for i, word in zip(owner[rare].tolist(), words.filter(pa.array(rare)).to_pylist(), strict=True):
            others[i][word] += 1
        rare = pa.StructArray.from_arrays([pa.array([w for c in others for w in c], pa.binary()), pa.array([n for c in others for n in c.values()], pa.int64())], names=["word", "n"])
        event = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in zip(*events, strict=True)], names=[f.name for f in EVENT])
        counts = [np.bincount(x, minlength=len(texts)).astype(np.int64) for x in (owner, told)]
        return pa.record_batch(
            [*(part.column(i) for i in range(3)), *map(pa.array, counts), pa.array(logs), listed([len(c) for c in others], rare), pa.array(bits_log), pa.array([len(t) for t in texts], pa.int64()), listed([len(e[0]) for e in events], event)],
            ["rid", "doc_id", "held_out", "n_tokens", "known", "logs", "rare", "bits_log", "n_bytes", "events"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_heap()
        for batch in batches:
            yield from map(scored, _slices(batch, 3, BATCH))

    return run


def segment_gain(rows: list[tuple], held_out: bool) -> float:
    """What the segments' natural log probabilities gain; rows of one text in order: (idx, key, next, log, total, n).

    A gate is how often the context was seen elsewhere and what became of the
    last segment; its share l moves with the part that the segments' memory had in the probability.
    """
    own = Counter() if held_out else Counter([r[1] for r in rows])
    same = Counter() if held_out else Counter([r[1:3] for r in rows])
    gates: dict[tuple[int, int], list[float]] = {}
    gain, last, before = 0.0, 0, None
    for idx, key, after, log, total, n in rows:
        others = total - own[key]
        if others <= 0:
            continue
        gate = gates.setdefault((min(others.bit_length(), 5), last if before == idx - 1 else 0), [1.0, 2.0])
        share = gate[0] / gate[1]
        gate[1] += 1
        n -= same[key, after]
        if n > 0:
            known, bits = share * n / others, (1 - share) * math.exp(log)
            gain += math.log(known + bits) - log
            gate[0] += known / (known + bits)
            last = 2
        else:
            gain += math.log1p(-share)
            last = 1
        before = idx
    return gain


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by text and in order; a text's rows may go on in the next batch."""

    def settled(rid: int, held_out: bool, rows: list[tuple]) -> None:
        rids.append(rid)
        gains.append(segment_gain(rows, held_out))

    def table() -> pa.RecordBatch:
        return pa.record_batch([pa.array(rids, pa.int64()), pa.array(gains, pa.float64())], ["rid", "gain"])

    open_rid, open_held, open_rows = None, False, []
    for batch in batches:
        rids: list[int] = []
        gains: list[float] = []
        every = batch.column(0).to_numpy()
        held = batch.column(1).to_pylist()
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(2, 8)), strict=True))
        starts = [0, *(np.flatnonzero(every[1:] != every[:-1]) + 1).tolist(), len(rows)]
        for lo, hi in itertools.pairwise(starts):
            if lo == hi:
                continue
            rid = int(every[lo])
            if rid != open_rid:
                if open_rid is not None:
                    settled(open_rid, open_held, open_rows)
                open_rid, open_held, open_rows = rid, held[lo], []
            open_rows += rows[lo:hi]
        yield table()
    rids, gains = [], []
    if open_rid is not None:
        settled(open_rid, open_held, open_rows)
    yield table()


def known_segments(scored: DataFrame) -> DataFrame:
    """(rid, gain) of the texts with a segment whose context stands in the training texts and at least twice in all."""
    events = scored.select("rid", "held_out", F.explode("events").alias("e")).select("rid", "held_out", "e.idx", "e.key", "e.next", "e.log")
    shared = events.groupBy("key").agg(F.count("*").alias("all"), F.count_if(~F.col("held_out")).alias("total")).filter("all > 1 AND total > 0").select("key", "total")
    live = written(events.join(shared, "key"), "segments")
    counts = live.filter(~F.col("held_out")).groupBy("key", "next").agg(F.count("*").alias("n"))
    told = live.join(counts, ["key", "next"], "left").select("rid", "held_out", "idx", "key", "next", "log", "total", F.coalesce("n", F.lit(0)).alias("n"))
    gains = written(told.repartition("rid").sortWithinPartitions("rid", "idx").mapInArrow(_gains, "rid long, gain double"), "gains")
    drop(live)
    return gains


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of `docs`.

    Trained on the rows whose crc32(id) mod 7 is not 2.  Null texts count as
    empty: their score is that of the end alone and their bits per byte null.
    Null ids train and are scored; repeated rows count each; without training rows
    every decision costs a bit; an empty table gives no rows; other
    columns are ignored, whatever their names.  Texts of any length are scored whole, in memory of some ten times their
    bytes.  `docs` must read the same three times.
    """
    spark = docs.sparkSession
    modulus, out = HELD_OUT
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].cast("long").alias("doc_id"), (bucket_of(docs[id_col], modulus) == out).alias("held_out"), text_of(docs, text_col).alias("text"))
    training = rows.filter(~F.col("held_out")).select("text")
    counts = training.mapInArrow(_count_words, "kind int, word binary, n long").groupBy("kind", "word").agg(F.sum("n").alias("c"))
    counts = written(counts, "counts")
    following = np.zeros(256 * 257, np.int64)
    for r in counts.filter("kind = 1").collect():  # pairs of bytes: 65,792 rows at most
        following[int.from_bytes(r.word, "big")] = r.c
    words = counts.filter("kind = 0").select("word", "c")
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = words.filter(F.octet_length("word") <= FREQUENT_BYTES).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    frequent = top["word"].combine_chunks().cast(pa.binary()), np.log10(top["c"].to_numpy() + 1.0)

    code, bits = Code(following.reshape(256, 257)), table_bits(int(following.sum()))
    parts = training.mapInArrow(_count_bits(code, bits), "slice int, counts binary").groupBy("slice").applyInArrow(_odds_of(bits), "slice int, odds binary")
    tables = [np.zeros(1 << b, np.int16) for b in bits]
    for r in parts.toArrow().to_pylist():  # 2 bytes a place: 6 MB at most
        k, i = divmod(r["slice"], SLICES)
        size = (1 << bits[k]) // SLICES
        tables[k][i * size : (i + 1) * size] = np.frombuffer(r["odds"], np.int16)
    shipped = spark.sparkContext.broadcast((code, tables, frequent))
    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rare array<struct<word:binary,n:long>>, bits_log double, n_bytes long, events array<struct<idx:int,key:long,next:long,log:float>>"
    scored = written(rows.mapInArrow(_score(shipped), schema), "scored")
    gains = known_segments(scored)
    rare = scored.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.n").join(words, "word")
    sums = rare.groupBy("rid").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("l"))
    full = scored.drop("rare", "events").join(sums, "rid", "left").join(gains, "rid", "left")
    base = F.col("logs") + F.coalesce("l", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))
    found = full.withColumn("score", (F.col("bits_log") + F.coalesce("gain", F.lit(0.0))) / F.lit(float(np.log(10))))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("n", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score",
        (-F.col("score") / F.log10(F.lit(2.0)) / F.nullif(F.col("n_bytes"), F.lit(0))).alias("bits_per_byte"),
    )
