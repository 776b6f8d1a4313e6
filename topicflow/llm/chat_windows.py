"""Conversations as training windows of a bounded number of tokens.

A turn is written as ``<turn>role``, a new line, its text and ``</turn>``.  Where a text holds one of the
two marks, a backslash is put behind its ``<`` (one more if there are some already), which can be undone
and changes no other text.

Windows hold whole turns.  Prefix sums of the turns' tokens choose them: the first window takes turns as
long as they fit the budget; each later one begins with the system turn, if the conversation has one, and
with the last turns before its first new one, as many as fit ``history`` tokens, and goes on with new turns
as far as the budget allows.  The loss mask covers the texts of new assistant turns, so a repeated target
is never trained twice.  A turn that fits no window is kept whole in a window of its own, which is then
longer than the budget (column ``tokens``).

Tokens are counted row by row before the one shuffle; the windows of a conversation are made from its
sorted stream, which holds one window and its history at a time, so a very long conversation needs time
but no memory.

Null texts and roles are empty.  Turns with equal numbers are ordered by their written form, null numbers
come first; repeated rows are turns of their own, rows without a conversation id make one conversation.  An
empty table gives no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import BATCH_BYTES, column, require, small_batches
from .texts import chunks
from .tokens import load_encoder

OPEN, CLOSE = "<turn>", "</turn>\n"
BUDGET = 2048
HISTORY = 256
SYSTEM, TARGET = "system", "assistant"

_PLAIN = re.compile(r"<(\\*)(/?turn>)")
_ESCAPED = re.compile(r"<\\(\\*)(/?turn>)")


def escape(text: str) -> str:
    return _PLAIN.sub(r"<\\\1\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1\2", text)


def escape_role(role: str) -> str:
    """Roles are one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns of a window."""
    at = 0
    while at < len(text):
        head = text.index("\n", at + len(OPEN))
        end = text.index(CLOSE, head)
        yield unescape_role(text[at + len(OPEN) : head]), unescape(text[head + 1 : end])
        at = end + len(CLOSE)


@dataclass
class Turn:
    """A written turn; ``start`` and ``end`` are the conversation's tokens before and after it."""

    shown: str
    head: int
    tokens: int
    role: str
    start: int = 0
    index: int = 0

    @property
    def end(self) -> int:
        return self.start + self.tokens


@dataclass
class Window:
    number: int
    repeated: list[Turn]
    new: list[Turn] = field(default_factory=list)

    def row(self, conversation) -> tuple:
        """conv_id, window, first_turn, turns, repeated, tokens, text, loss."""
        turns = self.repeated + self.new
        spans, at = [], 0
        for i, turn in enumerate(turns):
            if i >= len(self.repeated) and turn.role == TARGET:
                spans.append({"start": at + turn.head, "stop": at + len(turn.shown) - len(CLOSE)})
            at += len(turn.shown)
        text = "".join(t.shown for t in turns)
        tokens = sum(t.tokens for t in turns)
        return conversation, self.number, self.new[0].index, len(turns), len(self.repeated), tokens, text, spans


class WindowMaker:
    """Takes the turns of one conversation, gives windows as they are full."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.total = self.turns = self.windows = 0
        self.system: Turn | None = None
        self.recent: deque[Turn] = deque()
        self.open: Window | None = None
        self.room = 0

    def _begin(self, turn: Turn) -> None:
        kept = [] if self.system is None else [self.system]
        room = self.budget - sum(t.tokens for t in kept)
        allowed = min(self.history, room - turn.tokens)
        past = [t for t in self.recent if t.start >= turn.start - allowed]
        self.room = room - (turn.start - past[0].start if past else 0)
        self.open = Window(self.windows, kept + past)
        self.windows += 1

    def add(self, turn: Turn) -> Window | None:
        """The window that is closed, if the turn begins another one."""
        turn.start, turn.index = self.total, self.turns
        closed = None
        if self.open is None:
            self._begin(turn)
        elif turn.end - self.open.new[0].start > self.room:
            closed = self.open
            self._begin(turn)
        self.open.new.append(turn)
        if turn.index == 0 and turn.role == SYSTEM:
            self.system = turn
        else:
            self.recent.append(turn)
        self.total, self.turns = turn.end, self.turns + 1
        while self.recent and self.recent[0].start < self.total - self.history:
            self.recent.popleft()
        return closed


_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_NAMES = ["conv_id", "window", "first_turn", "turns", "repeated", "tokens", "text", "loss"]
_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), _LOSS]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether another conversation begins, row); the first column is the conversation."""
    last, some = None, False
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield not some or row[0] != last, row
            last, some = row[0], True


def _batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names)

    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def written_turns(rows: DataFrame, tokenizer: str, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, shown, head, tokens): each turn as it is written, where its text begins in it,
    and its tokens."""

    def work(roles: pa.Array, texts: pa.Array) -> pa.Array:
        encoder = load_encoder(tokenizer)
        heads = [f"{OPEN}{escape_role(r)}\n" for r in roles.to_pylist()]
        shown = [f"{h}{escape(t)}{CLOSE}" for h, t in zip(heads, texts.to_pylist())]
        written = pa.array(shown, pa.string())
        counts = [np.diff(encoder.encode_chunk(c)[1]) for c in chunks(written)]
        tokens = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        columns = [written, pa.array(map(len, heads), pa.int32()), pa.array(tokens, pa.int64())]
        return pa.StructArray.from_arrays(columns, ["shown", "head", "tokens"])

    write = F.arrow_udf(work, "shown string, head int, tokens long")
    given = [F.coalesce(column(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    written = rows.select(column(conv_col).alias("conv"), column(turn_col).alias("turn"), given[0].alias("role"), write(*given).alias("w"))
    return written.select("conv", "turn", "role", "w.shown", "w.head", "w.tokens")


def chat_windows(
    rows: DataFrame,
    tokenizer: str,
    budget: int = BUDGET,
    history: int = HISTORY,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """conv_id, window, first_turn (place of the first new turn), turns, repeated (how many of them are
    repeated), tokens, text, loss (spans of code points).  The windows of a conversation follow each
    other in one partition."""
    require(rows, [conv_col, turn_col, role_col, text_col])
    small_batches(rows.sparkSession)
    turns = written_turns(rows, tokenizer, conv_col, turn_col, role_col, text_col)
    key = turns.schema["conv"].dataType

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        maker, conversation = None, None
        for begins, (conv, shown, head, tokens, role) in _runs(batches):
            if begins:
                if maker:
                    yield maker.open.row(conversation)
                maker, conversation = WindowMaker(budget, history), conv
            closed = maker.add(Turn(shown, head, tokens, role))
            if closed:
                yield closed.row(conversation)
        if maker:
            yield maker.open.row(conversation)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(key), *_TYPES]
        yield from _batched(windows(batches), types, _NAMES, lambda r: 4 * len(r[6]) + 64)

    span = T.StructType().add("start", "long").add("stop", "long")
    schema = T.StructType([T.StructField("conv_id", key)]).add("window", "integer").add("first_turn", "long").add("turns", "integer")
    schema = schema.add("repeated", "integer").add("tokens", "long").add("text", "string").add("loss", T.ArrayType(span))
    ordered = turns.repartition("conv").sortWithinPartitions("conv", "turn", "shown")
    return ordered.select("conv", "shown", "head", "tokens", "role").mapInArrow(work, schema)


class _Reader:
    """What the windows of one conversation say."""

    def __init__(self) -> None:
        self.turns = self.loss_chars = self.chars = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, repeated: int, text: str, spans: list[dict]) -> None:
        for i, (role, body) in enumerate(parse(text)):
            if i >= repeated:
                self.turns += 1
                self.said.update(f"{role}\n{body}\n".encode())
        for span in spans:
            body = unescape(text[span["start"] : span["stop"]])
            self.loss_chars += len(body)
            self.loss.update(body.encode())
        self.chars += len(text)

    def row(self, conversation) -> tuple:
        return conversation, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(windows: DataFrame, ordered: bool = False) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read
    from its windows alone.  ``ordered`` says that ``windows`` come as ``chat_windows`` returns them;
    windows read from a table are brought together again."""
    if not ordered:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    key = windows.schema["conv_id"].dataType
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader, conversation = None, None
        for begins, (conv, repeated, text, spans) in _runs(batches):
            if begins:
                if reader:
                    yield reader.row(conversation)
                reader, conversation = _Reader(), conv
            reader.add(repeated, text, spans)
        if reader:
            yield reader.row(conversation)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(key), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield from _batched(conversations(batches), types, names, lambda r: 256)

    schema = T.StructType([T.StructField("conv_id", key)])
    schema = schema.add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long")
    schema = schema.add("loss_sha256", "string").add("formatted_chars", "long")
    return windows.select("conv_id", "repeated", "text", "loss").mapInArrow(work, schema)
