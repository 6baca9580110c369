r"""Chat formatting with a grammar round trip.

A turn renders as `### Name: body </turn>\n`.  Known roles are written with a capital letter, any other
role as `=` and the escaped role.  A body is first written as it is; the rendered turn is parsed again and
compared with its source, and where they differ the body is escaped and the check repeated, so only texts
that clash with the grammar (its marks, or a backslash that would read as an escape) are changed.  Every
turn ends in its own mark, so a conversation parses exactly when its turns do, and a conversation of any
length is handled turn by turn in constant memory.

Defined results: null text and null role are empty; rows of one conversation are ordered by turn, then role,
then text (null first), and repeated rows are turns of their own; rows with a null conversation id form one
conversation; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

NAMES = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {v: k for k, v in NAMES.items()}
START, END = "### ", " </turn>\n"
_MARKS = re.compile(r"\\[\\#<]|### |</turn>")
_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.S)

TURN_SCHEMA = "conv_id long, turn long, role string, text string, formatted string, body_start int, body_end int, escaped boolean"
DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return re.sub(r"[\\#<]", lambda m: "\\" + m[0], text)


def unescape(body: str) -> str:
    return re.sub(r"\\([\\#<])", r"\1", body)


def _name(role: str) -> str:
    return NAMES.get(role) or "=" + re.sub(r"[\\:]", lambda m: "\\" + m[0], role)


def parse_turn(rendered: str, at: int = 0) -> tuple[str, int, int, int] | None:
    """Role, begin and end of the body, end of the turn; None where the grammar does not hold."""
    head = _HEAD.match(rendered, at)
    if not head:
        return None
    name = head[1]
    role = ROLES.get(name) if name[:1] != "=" else re.sub(r"\\([\\:])", r"\1", name[1:])
    if role is None:
        return None
    for mark in _MARKS.finditer(rendered, head.end()):
        if mark[0] == "### ":
            return None
        if mark[0] == "</turn>":
            end = mark.start() - 1
            return (role, head.end(), end, end + len(END)) if end >= head.end() and rendered.startswith(END, end) else None
    return None


def render_turn(role: str, text: str) -> tuple[str, int, int, bool]:
    """The rendered turn, where its body begins and ends, and whether it had to be escaped."""
    for escaped in (False, True):
        out = f"{START}{_name(role)}: {escape(text) if escaped else text}{END}"
        got = parse_turn(out)
        if got and got[3] == len(out) and got[0] == role and unescape(out[got[1] : got[2]]) == text:
            return out, got[1], got[2], escaped
    raise AssertionError("an escaped turn always parses")


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roles = [x or "" for x in batch.column("role").to_pylist()]
        texts = [x or "" for x in batch.column("text").to_pylist()]
        made = [render_turn(r, t) for r, t in zip(roles, texts, strict=True)]
        out, begin, end, escaped = zip(*made, strict=True) if made else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array(out, pa.string()), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(escaped, pa.bool_())], ["conv_id", "turn", "role", "text", "formatted", "body_start", "body_end", "escaped"])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One row a turn: its rendering, and the code points of the rendering that its text takes (the loss mask if it is the assistant's)."""
    return conversations.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "cast(role as string) role", "cast(text as string) text").mapInArrow(_render, TURN_SCHEMA)


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str) -> None:
        role, begin, end, after = parse_turn(formatted)
        assert after == len(formatted)
        text = unescape(formatted[begin:end])
        self.n += 1
        self.chars += len(formatted)
        self.turns.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            self.loss.update(text.encode())
            self.loss_chars += len(text)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    now: _Conversation | None = None
    for batch in batches:
        done = []
        for conv_id, formatted in zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True):
            if now is None or now.conv_id != conv_id:
                done += [now.row()] if now else []
                now = _Conversation(conv_id)
            now.add(formatted)
        if done:
            yield pack(done)
    if now:
        yield pack([now.row()])


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Reads every conversation back from its formatted turns: counts and digests."""
    ordered = turns.select("conv_id", "turn", "role", "text", "formatted").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "formatted").mapInArrow(_digest, DIGEST_SCHEMA)
