"""Chat formatting with a grammar round trip.

Template of a turn: ``<|im_start|>role NEWLINE text<|im_end|>NEWLINE``. A conversation is its turns
in order. In roles and texts, ``<`` + n backslashes + ``|`` is written with n + 1 backslashes when
escaping is on, and a newline in a role as ``<|nl|>``; reading takes one backslash off each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(role: str, text: str, level: int) -> str:
    """level 0: as it is; 1: the text escaped; 2: the role as well."""
    if level:
        text = escape(text)
    if level > 1:
        role = escape(role).replace("\n", NEWLINE)
    return f"{START}{role}\n{text}{END}\n"


class Parser:
    """Deterministic incremental parser: feed() takes pieces of formatted text and gives whole turns.

    A turn is (role, text, rendered text, its start); a text under no turn or a control string
    where the grammar has none raises ValueError.
    """

    def __init__(self) -> None:
        self.rest, self.at = "", 0

    def feed(self, piece: str) -> Iterator[tuple[str, str, str, int]]:
        self.rest += piece
        while (close := self.rest.find(END + "\n")) >= 0:
            turn, self.rest = self.rest[:close], self.rest[close + len(END) + 1 :]
            head, found, raw = turn.partition("\n")
            if not found or not head.startswith(START):
                raise ValueError("a turn must begin with its marker and role")
            role = head[len(START) :]
            if START in raw or END in raw or START in role or END in role:
                raise ValueError("a control string inside a turn")
            yield unescape(role.replace(NEWLINE, "\n")), unescape(raw), raw, self.at + len(head) + 1
            self.at += close + len(END) + 1

    def close(self) -> None:
        if self.rest:
            raise ValueError("text after the last turn")


def _reparse(text: str) -> list[tuple[str, str]] | None:
    parser = Parser()
    try:
        turns = [(role, said) for role, said, _, _ in parser.feed(text)]
        parser.close()
    except ValueError:
        return None
    return turns


def render_until_identical(role: str | None, text: str | None) -> str:
    """Render, read back, and escape more until the turn that is read back is the source."""
    role, text = role or "", text or ""
    for level in (0, 1, 2):
        if _reparse(done := render(role, text, level)) == [(role, text)]:
            return done
    raise AssertionError("escaping everything is always identical")


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, formatted: each row's turn as rendered text; a conversation's text is their concatenation by turn.

    Null roles and texts count as empty; each row is one turn, repeated rows and equal turn numbers
    included (ordered by turn, then rendered text); null ids and turns are kept and come first.
    Other columns are ignored.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = [render_until_identical(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string())], ["conv_id", "turn", "formatted"])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(batches, "conv_id long, turn long, formatted string")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_spans string"


def conversation_digests(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Read formatted turns back, conversation by conversation, and digest what the parser recovers.

    Rows are dealt by conv_id and sorted, and each conversation streams through one parser and two
    running hashes, which is what a SHA-256 of all its turns asks for: a task holds one turn and the
    ranges of loss_spans, about twenty bytes a turn, whatever the texts' length. loss_spans are the
    character ranges of the loss mask in the formatted text (start:end, comma-joined). Each
    conversation with at least one row gives one row, null ids together; an empty table none.
    """

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "loss_spans"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        now, out, state = object(), [], None

        def end():
            state["parser"].close()
            out.append((now, state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["parser"].at, ",".join(state["spans"])))

        for batch in it:
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        end()
                    now, state = conv, {"parser": Parser(), "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_n": 0, "spans": []}
                for role, text, raw, start in state["parser"].feed(piece):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{text}\n".encode())
                    if role == loss_role:
                        state["loss"].update(text.encode())
                        state["loss_n"] += len(text)
                        state["spans"].append(f"{start}:{start + len(raw)}")
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if state is not None:
            end()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted")
    return rows.mapInArrow(fold, _DIGEST)
