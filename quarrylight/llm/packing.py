"""Packing token sequences by Karmarkar-Karp multiway differencing.

Documents become token ids; whole windows are cut off each document and what
remains is packed uncut, some hundred remainders at a time, by the largest
differencing method over k windows: partial partitions are merged, the largest
window of one with the smallest of the other, until one is left.  k starts at
the least possible number and rises when a window exceeds the capacity; what
still exceeds it after that, which differencing cannot place, is cut off and goes
to windows with room.  Everything happens where the documents are read, so no
key can be hot and nothing is shuffled.
"""

from __future__ import annotations

import heapq
import itertools
import json
import operator
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import text_of

#: The share by which the number of windows rises when one exceeds the capacity.
RISE = 0.005
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, piece_no long"


#: How byte-level BPE of these files cuts texts into pre-tokens, without back-tracking.
RANK_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class TextEncoder:
    """Token ids of a whole text as little-endian bytes."""

    def __init__(self, encode):
        self.encode = encode


_encoders: dict[int, TextEncoder] = {}


def byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes bytes as: printable ones are themselves, others follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\u00a1"), ord("\u00ac") + 1), *range(ord("\u00ae"), ord("\u00ff") + 1)]
    rest = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(rest)}


def ranks_of(file: bytes) -> dict[bytes, int] | None:
    """Tokens with their ids as merge ranks, or None where the file says more than ranks can (a normalizer, added words, another order of merges)."""
    said = json.loads(file)
    cut, model = said.get("pre_tokenizer") or {}, said["model"]
    if said.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout") or any(not x["special"] for x in said.get("added_tokens", [])):
        return None
    pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
    ids, letters = model["vocab"], byte_letters()
    merged = [ids["".join(x)] for x in pairs]
    if any(a >= b for a, b in itertools.pairwise(merged)) or not all(x in ids and ids[x] < (merged or [256])[0] for x in letters):
        return None
    return {bytes([letters[c] for c in w]): ids[w] for w in [*letters, *("".join(x) for x in pairs)]}


def library_encoder(file: bytes) -> TextEncoder:
    """An encoder for a file of the tokenizers library; one per worker process and file.

    Files that are plain ranks are encoded by the library of ranks, which takes a
    third of the time and gives the same ids; others by the tokenizers library.
    """
    key = zlib.crc32(file)
    if key not in _encoders:
        ranks = ranks_of(file)
        if ranks:
            from tiktoken import Encoding

            core = Encoding("packing", pat_str=RANK_PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
            nothing: set[str] = set()
            _encoders[key] = TextEncoder(lambda text: bytes(core.encode_to_tiktoken_buffer(text, nothing)))
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tok = Tokenizer.from_buffer(file)
            tok.encode_special_tokens = True
            _encoders[key] = TextEncoder(lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
    return _encoders[key]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of `sizes` in k windows, by the largest differencing method; ties go to what came first.

    A partial partition lists its windows that hold something, largest first, as
    (minus the sum above the smallest, what lies in it); empty ones are not kept.
    What lies in a window is an index or a pair of such, flattened at the end.
    """
    heap = [(-s, i, [(-s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    for n in itertools.count(len(sizes)):
        if len(heap) == 1:
            found = [flat(held) for _, held in heap[0][2]]
            return found + [[] for _ in range(k - len(found))]
        _, _, mine = heapq.heappop(heap)
        _, _, other = heapq.heappop(heap)
        alone, free = k - len(other), k - len(mine)
        if free >= len(other):
            merged = mine + other
        else:  # the largest of one meets the smallest of the other, empty windows included
            merged = mine[:alone] + other[:free]
            merged += [(x + y, (held, more)) for (x, held), (y, more) in zip(mine[alone:], reversed(other[free:]), strict=True)]
        merged.sort(key=operator.itemgetter(0))
        if len(merged) == k and merged[-1][0]:
            low = merged[-1][0]
            merged = [(x - low, held) for x, held in merged]
        heapq.heappush(heap, (merged[0][0], n, merged))


def flat(held) -> list[int]:
    out, left = [], [held]
    while left:
        x = left.pop()
        if isinstance(x, tuple):
            left += (x[1], x[0])
        else:
            out.append(x)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, from, to) by differencing; the count rises by RISE once if capacity is exceeded, then overhangs are cut off."""
    if not sizes:
        return []
    k = -(-sum(sizes) // capacity)
    load = lambda w: sum(sizes[i] for i in w)
    found = differencing(sizes, k)
    if max(map(load, found)) > capacity:
        found = differencing(sizes, k + max(1, int(k * RISE)))
    filled = [[(i, 0, sizes[i]) for i in w] for w in found]
    room = [capacity - load(w) for w in found]
    over: list[tuple[int, int, int]] = []
    for n, w in enumerate(filled):
        while room[n] < 0:
            i, lo, hi = w.pop()
            cut = max(lo, hi + room[n])
            room[n] += hi - cut
            over.append((i, cut, hi))
            if cut > lo:
                w.append((i, lo, cut))
    # the largest rooms take the overhangs: few cuts more
    for n in sorted(range(len(filled)), key=lambda n: -room[n]):
        while over and room[n]:
            i, lo, hi = over.pop()
            cut = min(hi, lo + room[n])
            filled[n].append((i, lo, cut))
            room[n] -= cut - lo
            if cut < hi:
                over.append((i, cut, hi))
    return [w for w in filled if w]


def _pack(encoder_of, capacity: int, group: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of()
        ids = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 40)
        numbers = itertools.count()
        waiting: list[tuple] = []

        def settle(rows: list[tuple]) -> list[tuple]:
            out = []
            for w in windows([len(r[2]) // 4 for r in rows], capacity):
                name, at = next(ids), 0
                for i, lo, hi in w:
                    doc_id, start, data, total = rows[i]
                    out.append((doc_id, start + lo, hi - lo, zlib.crc32(data[4 * lo : 4 * hi]), total, name, at, next(numbers)))
                    at += hi - lo
            return out

        def table(rows: list[tuple]) -> pa.RecordBatch:
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True) if rows else [[]] * len(names), strict=True)})

        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = encoder.encode(text.as_py()) + end
                total, whole = len(data) // 4, len(data) // 4 // capacity * capacity
                for lo in range(0, whole, capacity):
                    rows.append((doc_id, lo, capacity, zlib.crc32(data[4 * lo : 4 * (lo + capacity)]), total, next(ids), 0, next(numbers)))
                if whole < total:
                    waiting.append((doc_id, whole, data[4 * whole :], total))
                while len(waiting) >= group:
                    rows += settle(waiting[:group])
                    del waiting[:group]
                if len(rows) >= 20_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)
        if waiting:
            yield table(settle(waiting))

    return run


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, group: int = 512, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    The vocabulary file (a few MB at most) is sent to the executors, which need
    no copy.  Null texts count as empty and give their end id alone; null or
    repeated ids are packed like others; an empty table gives no rows; other
    columns are ignored, whatever their names.  A text of any length is cut into whole windows.
    Sequence ids are unique, made of the task's number and a count.
    """
    with open(tokenizer_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_pack(lambda: library_encoder(shipped.value), capacity, group, end_id), SCHEMA).drop("piece_no")
