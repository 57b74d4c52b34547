"""Chat formatting by incremental black-box rendering.

A template is any callable from a list of (role, text) turns to a string.
Nothing is assumed about its format: successive prefixes of a conversation are
rendered and each output is compared with the one before it.  What is new is
the turn's span; inside it the turn's own text is found by rendering the turn
with its text changed.  If an earlier output is not a prefix of the next, the
template rewrites history, which is reported.

Of a template nothing else is known, so it sees true prefixes: a conversation
of n turns is rendered from its start n times.  A template that declares
itself local (the attribute `local`: a turn's rendering depends on this turn
alone) is rendered in segments of `SEGMENT` turns, each opened by the turn before it,
so that the work grows with the length and not with the square, and a task holds one
segment; the repeated turn must come out as it stood in the segment before,
else the declaration is false and the conversation is flagged.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.common import text_of

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
SEGMENT = 32
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """No control string is left: between `<` and `|` there is one backslash more than there was."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def marked_turns(turns: list[Turn]) -> str:
    """The template of this module: every turn between start and end marks; a role takes one line."""
    return "".join(f"{START}{escape(one_line(role))}\n{escape(text)}{END}\n" for role, text in turns)


marked_turns.local = True


def one_line(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n")


def full_role(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line)


_TURN = re.compile(re.escape(START) + r"(.*?)" + re.escape(END) + "\n", re.S)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of an output of marked_turns."""
    out = []
    for m in _TURN.finditer(formatted):
        role, _, text = m[1].partition("\n")
        out.append((full_role(unescape(role)), unescape(text)))
    return out


class Span(tuple):
    """(start, end, text_start, text_end) of a turn in the output, in code points."""


def common_prefix(a: str, b: str) -> int:
    if a == b:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def spans(template: Template, turns: list[Turn], given: int = 0) -> tuple[str, list[Span], bool]:
    """The output for `turns`, the span of each turn from `given` on, and whether some prefix was rewritten.

    The text inside a span is located by two renderings of the last turn, with
    an empty text and with its own: what both begin and end with is not text.
    """
    before, found, rewritten = template(turns[:given]), [], False
    for k in range(given, len(turns)):
        now = template(turns[: k + 1])
        start = len(before)
        if not now.startswith(before):
            rewritten = True
            start = common_prefix(before, now)
        empty = template([*turns[:k], (turns[k][0], "")])
        head = common_prefix(empty, now)
        tail = min(common_prefix(empty[head:][::-1], now[head:][::-1]), len(empty) - head)
        # a text may begin or end as what surrounds it does: the length added by the text settles the rest
        size = len(now) - len(empty)
        mark = template([*turns[:k], (turns[k][0], "\x00")])
        text_start = min(head, common_prefix(empty, mark)) if size else head
        found.append(Span((start, len(now), text_start, max(text_start, text_start + size) if size else len(now) - tail)))
        before = now
    return before, found, rewritten


def rendered(turns: Iterable[Turn], template: Template = marked_turns) -> Iterator[tuple[str, list[tuple[Turn, Span]], bool]]:
    """Pieces of the conversation's output, in order: (piece, turns with spans in the piece, rewritten).

    One piece for a template that is not declared local.
    """
    turns = iter(turns)
    if not getattr(template, "local", False):
        every = list(turns)
        if every:
            text, found, rewritten = spans(template, every)
            yield text, list(zip(every, found, strict=True)), rewritten
        return
    last: list[Turn] = []
    shown = ""
    while part := list(itertools.islice(turns, SEGMENT)):
        text, found, rewritten = spans(template, [*last, *part], len(last))
        # the turn that opens the segment must look as it did at the end of the one before
        rewritten |= bool(last) and not text.startswith(shown)
        lead = len(template(last)) if last else 0
        yield text[lead:], [(t, Span(x - lead for x in s)) for t, s in zip(part, found, strict=True)], rewritten
        last = part[-1:]
        shown = text[found[-1][0] :]


class Digest:
    """What the query reports of one conversation, read back from its output piece by piece."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.rewritten = False

    def add(self, piece: str, found: list[tuple[Turn, Span]], rewritten: bool) -> None:
        self.rewritten |= rewritten
        self.chars += len(piece)
        for role, text in read_turns(piece):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n += 1
        for (role, _), (_, _, lo, hi) in found:
            if role == "assistant":
                text = unescape(piece[lo:hi])
                self.loss.update(text.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(text)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.rewritten


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Turn]]:
    for batch in batches:
        yield from ((c, (r, t)) for c, r, t in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))


def _digests(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], names)

    rows = []
    for conv_id, group in itertools.groupby(_turns(batches), key=lambda x: x[0]):
        digest = Digest()
        for piece in rendered((t for _, t in group), template):
            digest.add(*piece)
        rows.append((conv_id, *digest.row()))
        if len(rows) >= 5000:
            yield table(rows)
            rows = []
    yield table(rows)


def _pieces(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[pa.RecordBatch]:
    for conv_id, group in itertools.groupby(_turns(batches), key=lambda x: x[0]):
        for i, (piece, found, rewritten) in enumerate(rendered((t for _, t in group), template)):
            loss = [{"start": lo, "end": hi} for (role, _), (_, _, lo, hi) in found if role == "assistant"]
            yield pa.record_batch(
                [pa.array([conv_id], pa.int64()), pa.array([i], pa.int64()), pa.array([piece], pa.string()), pa.array([loss], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([rewritten], pa.bool_())],
                ["conv_id", "piece_no", "formatted", "loss", "rewrites_history"],
            )


def in_order(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text; a conversation's rows come together and by turn. The digests of a conversation run through all its text in order, so one task reads it, as a stream."""
    role = F.coalesce(conversations["role"], F.lit(""))
    rows = conversations.select(conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].alias("turn"), role.alias("role"), text_of(conversations).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select("conv_id", "role", "text")


def format_digests(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, rewrites_history.

    Null texts and roles count as empty, null turns come first and equal turns by role and text; rows without a
    conv_id form one conversation without one.  Repeated rows are turns like
    others; an empty table gives no rows; other columns are ignored.  Texts of any length are rendered
    whole.  n_turns and turns_sha256 are read back from outputs in the form of marked_turns; for other
    templates they are those of the turns that can be read so.
    """
    return in_order(conversations).mapInArrow(lambda batches: _digests(batches, template), DIGEST)


def format_conversations(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """The outputs: conv_id, piece_no, formatted, loss (spans of assistant texts in the piece), rewrites_history; cases as in format_digests."""
    return in_order(conversations).mapInArrow(lambda batches: _pieces(batches, template), "conv_id long, piece_no long, formatted string, loss array<struct<start:long,end:long>>, rewrites_history boolean")
