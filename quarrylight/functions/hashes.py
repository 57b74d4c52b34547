"""Hashes of the words of many texts at a time, in numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_START = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
_SPACE = np.isin(np.arange(256), [*b"\t\n\v\f\r "])
#: Words of at most so many bytes, with the byte that ends them four numbers of MD5's block, are hashed so many at a time; longer ones one by one.
SHORT, RUN = 15, 1 << 14


def _md5_starts(block: list[np.ndarray], bits: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of messages of SHORT bytes at most: their first four numbers, ended, and their lengths in bits."""
    a, b, c, d = (np.full(len(bits), x) for x in _START)
    f, low = np.empty_like(bits), np.empty_like(bits)
    for i in range(64):
        kind = i >> 4
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_not(d, out=f)
            f |= b
            f ^= c
        at = (i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] & 15
        f += a
        f += np.uint32(_SINES[i])
        if at < 4:
            f += block[at]
        elif at == 14:
            f += bits
        turn = _TURNS[kind][i & 3]
        np.right_shift(f, np.uint32(32 - turn), out=low)
        f <<= np.uint32(turn)
        f |= low
        f += b
        a, b, c, d, f = d, f, b, c, a
    a += _START[0]
    return a.byteswap()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(which text, first 32 bits of the MD5) of every word of the texts, words being what bytes.split() gives."""
    data = np.frombuffer(b"\n".join(texts) + b"\n" + bytes(SHORT + 1), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    gap = np.flatnonzero(_SPACE[data[: ends[-1]]])
    start = np.concatenate([[0], gap[:-1] + 1])
    size = gap - start
    start, size = start[size > 0], size[size > 0]
    fours = np.ndarray(len(data) - 3, "<u4", data, strides=(1,))
    hashes = np.empty(len(start), np.int64)
    short = np.flatnonzero(size <= SHORT)
    for i in range(0, len(short), RUN):
        mine = short[i : i + RUN]
        at, n = start[mine], size[mine]
        block = []
        for j in range(4):
            own = np.uint64(1) << (8 * np.clip(n - 4 * j, 0, 4)).astype(np.uint64)
            # the bytes of the word, and after its last one the byte that ends a message
            end = np.where(n >> 2 == j, own << np.uint64(7), np.uint64(0))
            block.append((fours[at + 4 * j] & (own - np.uint64(1)) | end).astype(np.uint32))
        hashes[mine] = _md5_starts(block, (8 * n).astype(np.uint32))
    for i in np.flatnonzero(size > SHORT).tolist():
        hashes[i] = int.from_bytes(hashlib.md5(data[start[i] : start[i] + size[i]]).digest()[:4], "big")
    return np.searchsorted(ends, start, side="right"), hashes
