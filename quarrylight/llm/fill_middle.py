"""Fill-in-the-middle transformation on succinct rank and select.

The bytes of a batch of texts get two packed bit vectors: one marks where a
token begins, one where a code point does.  A directory of popcounts by block
makes both answer rank (ones before a byte) and select (the byte of the k-th
one) without unpacking them.  A text's number of tokens is a difference of two
ranks, its two cuts are two selects, the code points of a part a difference of
ranks again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import text_of

#: Marks before the prefix, the suffix and the middle; none may begin as another one ends.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are transformed, and of 100 transformed ones so many begin with their suffix.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
#: Texts whose bit vectors are built at once hold so many bytes, or are one text.
CHUNK = 4 << 20
WORDS = 8  # of 64 bits, in a block of the directory


class Bits:
    """A packed bit vector with a directory of the ones before each block of 512 bits."""

    def __init__(self, flags: np.ndarray):
        self.size = len(flags)
        blocks = self.size // (64 * WORDS) + 1
        packed = np.zeros(blocks * WORDS * 8, np.uint8)
        packed[: -(-self.size // 8)] = np.packbits(flags, bitorder="little")
        self.words = packed.view("<u8").reshape(blocks, WORDS)
        self.directory = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).sum(axis=1, dtype=np.int64))))

    @property
    def total(self) -> int:
        return int(self.directory[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position; positions go from 0 to the size."""
        block, bit = at // (64 * WORDS), at % (64 * WORDS)
        word, rest = bit // 64, (bit % 64).astype(np.uint64)
        counts = np.bitwise_count(self.words[block]).astype(np.int64)
        counts[np.arange(WORDS) >= word[:, None]] = 0
        last = self.words[block, word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.directory[block] + counts.sum(axis=1) + np.bitwise_count(last)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of each k-th one, from 0; of a k that no one has, the size."""
        out = np.full(len(k), self.size, np.int64)
        some = k < self.total
        k = k[some]
        block = np.searchsorted(self.directory, k, "right") - 1
        sums = np.cumsum(np.bitwise_count(self.words[block]), axis=1, dtype=np.int64)
        left = k - self.directory[block]
        word = (sums <= left[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        left = left - np.where(word > 0, sums[rows, word - 1], 0)
        bits = np.unpackbits(np.ascontiguousarray(self.words[block, word]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) <= left[:, None]).sum(axis=1)
        out[some] = (block * WORDS + word) * 64 + bit
        return out


def token_starts(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of UTF-8 begin a token `[A-Za-z]+|[^A-Za-z]`, and which a code point; texts begin at `begins`."""
    lead = (data & 0xC0) != 0x80
    letter = ((data | 0x20) - np.uint8(97)) < 26
    starts = lead.copy()
    starts[1:] &= ~(letter[1:] & letter[:-1])
    starts[begins[begins < len(data)]] = True
    return starts, lead


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 in one array, and where each begins and the last ends."""
    wide = pa.types.is_large_string(column.type)
    _, bounds, data = column.buffers()
    ends = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def _parts(part: pa.RecordBatch, marks: tuple[bytes, bytes, bytes]) -> pa.RecordBatch:
    data, ends = _bytes_of(part.column(1))
    starts, lead = token_starts(data, ends[:-1])
    tokens, chars = Bits(starts), Bits(lead)
    first = tokens.rank(ends[:-1])
    n = tokens.rank(ends[1:]) - first
    h1, h2 = (part.column(i).to_numpy() % (n + 1) for i in (2, 3))
    one, two = tokens.select(first + np.minimum(h1, h2)), tokens.select(first + np.maximum(h1, h2))
    form = part.column(4).to_numpy(zero_copy_only=False)  # 0 plain, 1 prefix first, 2 suffix first
    at = [chars.rank(x) for x in (ends[:-1], one, two)]
    raw, p, s, m = data.tobytes(), *marks
    texts = []
    for lo, a, b, hi, f in zip(ends[:-1].tolist(), one.tolist(), two.tolist(), ends[1:].tolist(), form.tolist(), strict=True):
        if f == 0:
            texts.append(raw[lo:hi])
        elif f == 1:
            texts.append(b"".join((p, raw[lo:a], s, raw[b:hi], m, raw[a:b])))
        else:
            texts.append(b"".join((s, raw[b:hi], p, raw[lo:a], m, raw[a:b])))
    plain = form == 0
    return pa.record_batch(
        [
            part.column(0),
            pa.array(n, pa.int64()),
            pa.array(np.array(["plain", "psm", "spm"], object)[form], pa.string()),
            pa.array(at[1] - at[0], pa.int64(), mask=plain),
            pa.array(at[2] - at[1], pa.int64(), mask=plain),
            pa.array(texts, pa.binary()).cast(pa.string()),
        ],
        ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
    )


def chunks(batch: pa.RecordBatch, column: int, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold `size` bytes at most, or one row."""
    lengths = np.asarray(pc.binary_length(batch.column(column)), np.int64)
    ends, lo = np.cumsum(lengths), 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _transform(marks: tuple[bytes, bytes, bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, 1):
                yield _parts(part, marks)

    return run


def hashes(id_column: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of the seed, a colon and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def check_marks(marks: tuple[str, str, str]) -> None:
    """Marks that could be read in two ways are refused: no end of one begins one, and none holds another."""
    if len(set(marks)) < 3 or not all(marks):
        raise ValueError("three different marks that are not empty are needed")
    for a in marks:
        for b in marks:
            if any(a.endswith(b[:k]) for k in range(1, len(b) + (a != b))) or (a != b and b in a):
                raise ValueError(f"{a!r} holds {b!r} or ends as it begins: outputs could be read in two ways")


def fill_in_middle(docs: DataFrame, seed: int = 1, cut_percent: int = CUT_PERCENT, suffix_first_percent: int = SUFFIX_FIRST_PERCENT, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of every row of `docs`.

    A text is cut at two of its n + 1 places between tokens, which its id's hash
    chooses.  Null and empty texts and those that hold a mark stay plain, without
    numbers of characters; a null id is hashed as an empty one; repeated rows
    give the same output each; an empty table gives no rows; other columns
    are ignored.  One pass, nothing is shuffled.
    """
    check_marks(marks)
    text = text_of(docs, text_col)
    h1, h2, h3, h4 = hashes(docs[id_col], seed)
    held = F.lit(False)
    for mark in marks:
        held = held | F.contains(text, F.lit(mark))
    form = F.when((text == "") | held | (h3 % 100 >= cut_percent), 0).when(h4 % 100 < suffix_first_percent, 2).otherwise(1)
    rows = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), h1.alias("h1"), h2.alias("h2"), form.alias("form"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_transform(tuple(m.encode() for m in marks)), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(marks: tuple[str, str, str] = MARKS, form: str = "form", output: str = "output") -> Column:
    """The text that an output was made of, from the output and its form alone; null for null."""
    p, s, m = marks

    def split(first: str, second: str) -> tuple[Column, Column, Column]:
        body = F.substr(F.col(output), F.lit(len(first) + 1))
        one = F.substring_index(body, second, 1)
        rest = F.substr(body, F.length(one) + len(second) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = split(p, s)
    late_suffix, late_prefix, late_middle = split(s, p)
    psm, spm = F.concat(prefix, middle, suffix), F.concat(late_prefix, late_middle, late_suffix)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))
