"""Chat formatting: a finite-state machine over roles, a declarative template, and segments with loss flags.

``format_chats`` turns turns into text segments: markers and headers without loss, texts with the loss flag of their role.  Texts may hold
the template's control strings; they are escaped, so that ``read_back`` restores every text exactly.  Rows of a conversation are
sorted into one stream and pass through constant memory (a turn at a time); nothing is gathered per conversation, however
long it is.

Defined results: a null text is empty, a null role too; a null conversation id is a conversation of its own.  Turns are ordered by
``turn`` (null first), then role, then text, so ties and repeated rows have one order.  Every conversation is formatted; those whose
roles the machine refuses carry ``valid = false`` from the first refused turn on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import own_columns, ship

START = ""


@dataclass(frozen=True)
class ChatTemplate:
    """Markers, the roles whose texts are learned, and the machine: for each state (the last role) the roles that may follow."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after_turn: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    transitions: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        START: ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user", "tool"),
        "tool": ("assistant", "tool"),
    })


#: The start of every control string, with any backslashes that escaping has put into it.
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """One more backslash in each ``<|``, ``<\\|``, ...: no control string is left, and ``unescape`` takes it out again."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role is one line of its own."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment_no", pa.int32()), ("text", pa.string()),
                       ("loss", pa.bool_()), ("valid", pa.bool_())])


def _segments(template: ChatTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, state, valid = object(), 0, START, True
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                part = batch.slice(lo, 256)
                for conv, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                    if conv != now:
                        now, number, state, valid = conv, 0, START, True
                    valid = valid and role in template.transitions.get(state, ())
                    state = role
                    segments = ((template.open + escape_role(role) + template.after_role, False),
                                (escape(text), role in template.loss_roles), (template.close + template.after_turn, False))
                    out += [(conv, number, k, s, loss, valid) for k, (s, loss) in enumerate(segments)]
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SEGMENTS.types)], schema=_SEGMENTS)

    return run


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """(conv_id, turn_no, segment_no, text, loss, valid), in order within each partition; the texts in order are the formatted conversation.

    Reads the columns ``conv_id``, ``turn``, ``role`` and ``text``; ``turn_no`` counts from 0.
    """
    ship(turns.sparkSession)
    rows = own_columns(turns, conv_id="conv_id", turn="turn", role="role", text="text").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    laid = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return laid.mapInArrow(_segments(template), "conv_id long, turn_no long, segment_no int, text string, loss boolean, valid boolean")


@dataclass
class _Reader:
    """Reads one conversation's segments back: turns are found by the markers in the text alone."""

    template: ChatTemplate
    conv: int | None
    n_turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    valid: bool = True
    held: str = ""

    def __post_init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, loss: bool, valid: bool) -> None:
        t = self.template
        self.chars += len(text)
        self.valid = self.valid and valid
        if loss:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        self.held += text
        end = t.close + t.after_turn
        while (stop := self.held.find(end)) >= 0:
            role, _, said = self.held[len(t.open): stop].partition(t.after_role)
            self.turns.update(f"{unescape_role(role)}\n{unescape(said)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
            self.held = self.held[stop + len(end):]

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.valid)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])


def read_back(segments: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation, from the output of ``format_chats``: counts and digests of what it says and of what is learned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done = None, []
        for batch in batches:
            for conv, text, loss, valid in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "loss", "valid"))):
                if reader is None or conv != reader.conv:
                    done += [reader.row()] if reader else []
                    reader = _Reader(template, conv)
                reader.add(text, loss, valid)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _DIGEST.types)], schema=_DIGEST)
                done = []
        done += [reader.row()] if reader else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _DIGEST.types)], schema=_DIGEST)

    return segments.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
