"""Byte-level BPE by a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list.  Each adjacent pair that has a merge
rank lies in that rank's bucket; a bitmap of two levels over the ranks tells
by find-first-set which bucket is next, so that the next merge is found in
constant time however long the pre-token is.  Entries whose pair has changed
since are stale and skipped when they are met.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarrylight.llm.common import text_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """Encoder and decoder for a table of byte strings and their ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        self.vocabulary: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
        #: the queue: positions by rank, and a bitmap of the ranks there by their upper half; empty between pre-tokens
        self.shift = (len(self.vocabulary).bit_length() + 1) // 2
        self.buckets: dict[int, list[int]] = {}
        self.leaves = [0] * ((len(self.vocabulary) >> self.shift) + 1)
        #: ranks of all pairs of bytes
        self.two = [ranks.get(bytes(divmod(x, 256))) for x in range(1 << 16)]

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token. The queue's push and pop are written out, as they are most of the work."""
        ranks, n = self.ranks, len(piece)
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        get, two, buckets, leaves, shift, top = ranks.get, self.two, self.buckets, self.leaves, self.shift, 0
        low = (1 << shift) - 1
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pair = [two[a << 8 | b] for a, b in itertools.pairwise(piece)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)  # positions come in order: still a heap
                else:
                    buckets[rank] = [i]
                    leaf = rank >> shift
                    leaves[leaf] |= 1 << (rank & low)
                    top |= 1 << leaf
        while top:
            leaf = (top & -top).bit_length() - 1
            bits = leaves[leaf]
            one = bits & -bits
            rank = leaf << shift | one.bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                bits ^= one
                leaves[leaf] = bits
                if not bits:
                    top ^= 1 << leaf
            if pair[i] != rank:
                continue  # stale: the pair that began here has changed
            gone = after[i]
            end = after[i] = after[gone]
            pair[gone] = None
            left = before[i]
            if end < n:
                before[end] = i
                rank = pair[i] = get(piece[i : after[end]])
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], i)
                    else:
                        buckets[rank] = [i]
                        leaf = rank >> shift
                        leaves[leaf] |= 1 << (rank & low)
                        top |= 1 << leaf
            else:
                pair[i] = None
            if left >= 0:
                rank = pair[left] = get(piece[left:end])
                if rank is not None:
                    if rank in buckets:
                        heappush(buckets[rank], left)
                    else:
                        buckets[rank] = [left]
                        leaf = rank >> shift
                        leaves[leaf] |= 1 << (rank & low)
                        top |= 1 << leaf
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        return [i for piece in self.find(text) for i in self.merge(piece.encode())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def read_ranks(file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file.splitlines()) if token}


#: Cutting before a single space between two other characters never splits a pre-token, whatever stands around it.
SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
ODD_SPACE = re.compile(r"\s | \s|^ | $")
#: Entries of each table of pieces, some 200 bytes each; pieces of more characters are encoded anew each time.
CACHED, PIECE_CHARS = 700_000, 64


class PieceEncoder:
    """Token ids as little-endian bytes, by tables of pieces and pre-tokens seen before; encode_many gives the ids of new ones.

    A table of pieces that is full becomes the old one, from which what is
    still in use moves over to the new.  Pieces of Latin letters are cut into
    pre-tokens, which recur more often than pieces; others are encoded whole, as
    tables of letters may differ between libraries beyond them.
    """

    def __init__(self, encode_many, pattern: str, cached: int = CACHED):
        import regex

        self.encode_many, self.cached = encode_many, cached
        self.find = regex.compile(pattern).findall
        self.spaced: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        new = words.difference(self.spaced)
        if len(self.spaced) + len(new) > self.cached:
            self.old, self.spaced, new = self.spaced, {}, words
        if len(self.tokens) > self.cached:
            self.tokens = {}
        cut, unknown = [], {}
        for w in new:
            ids = self.old.get(w)
            if ids is not None:
                self.spaced[w] = ids
                continue
            piece = " " + w
            parts = self.find(piece) if max(piece) < "\u0250" else [piece]
            cut.append((w, parts))
            for p in parts:
                if p not in self.tokens:
                    unknown[p] = None
        names = list(unknown)
        self.tokens.update(zip(names, self.encode_many(names), strict=True))
        for w, parts in cut:
            self.spaced[w] = self.tokens[parts[0]] if len(parts) == 1 else b"".join([self.tokens[p] for p in parts])

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if ODD_SPACE.search(text):
            first, *rest = SAFE_CUT.split(text)
            rest = [x[1:] for x in rest]
        else:
            first, *rest = text.split(" ")
        words = set(rest)
        long = [w for w in words if len(w) > PIECE_CHARS]
        self._learn(words.difference(long))
        ids = self.spaced
        if long:
            ids = {w: ids[w] for w in words.difference(long)} | dict(zip(long, self.encode_many([" " + w for w in long]), strict=True))
        return b"".join([self.encode_many([first])[0], *map(ids.__getitem__, rest)])


_coders: dict[tuple[int, str], tuple[Bpe, PieceEncoder]] = {}


def coder(file: bytes, pattern: str) -> tuple[Bpe, PieceEncoder]:
    """The coder and its table of known pieces; one per worker process."""
    key = (zlib.crc32(file), pattern)
    if key not in _coders:
        bpe = Bpe(read_ranks(file), pattern)
        _coders[key] = bpe, PieceEncoder(lambda xs: [np.array(bpe.encode(x), "<u4").tobytes() for x in xs], pattern)
    return _coders[key]


def _encode(shipped, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encoder = coder(shipped.value, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                data = encoder.encode(text.as_py())
                ids = np.frombuffer(data, "<u4")
                rows.append((len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(bpe.decode(ids.tolist())).hexdigest()))
            n, ids_sha, text_sha = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())})

    return run


def encode_digests(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of `docs`.

    Null and empty texts have no tokens; null or repeated ids are kept as they
    are; an empty table gives no rows; other columns are ignored.  The file of
    ranks (a few MB at most) is sent to the executors.
    """
    with open(ranks_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_encode(shipped, pattern), SCHEMA)


def _ids(shipped, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encoder = coder(shipped.value, pattern)
        for batch in batches:
            ids = [np.frombuffer(encoder.encode(t.as_py()), "<u4").astype(np.int32) for t in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return run


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids themselves, for writing as a table; cases as in encode_digests."""
    with open(ranks_file, "rb") as f:
        shipped = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    return rows.mapInArrow(_ids(shipped, pattern), "doc_id long, ids array<int>")


def _texts(shipped, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(shipped.value, pattern)
        for batch in batches:
            texts = [bpe.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return run


def decode(encoded: DataFrame, ranks_file: str, pattern: str) -> DataFrame:
    """doc_id and text of a table made by `encode`; bytes that form no character become U+FFFD.

    Null ids of tokens are an empty text; repeated rows and null doc_ids are kept; an empty table
    gives no rows; other columns are ignored.
    """
    with open(ranks_file, "rb") as f:
        shipped = encoded.sparkSession.sparkContext.broadcast(f.read())
    return encoded.select("doc_id", "ids").mapInArrow(_texts(shipped, pattern), "doc_id long, text string")
