"""Chat formatting with a grammar round trip.

A turn is an opening mark, a space, the text, a space and a closing mark; the
marks name the role. A turn whose text holds a control string, or that the
deterministic parser doesn't give back as it was, gets its control strings
escaped by a backslash each (one more, if backslashes stand there already), until
the parsed turns equal the source's. Only assistants' texts lie under the loss
mask, as spans of code points.

Defined cases: turns are ordered by (turn, role, text), nulls first, and rows that
repeat are turns of their own; null texts and roles are empty; a null
conversation id is a conversation of its own; other columns are ignored. A
conversation is one row of output and is handled as one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_CONTROL = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE=|\[/ROLE\]"
CONTROL = re.compile(_CONTROL)
_ESCAPE, _UNESCAPE = re.compile(rf"(\\*(?:{_CONTROL}))"), re.compile(rf"\\(\\*(?:{_CONTROL}))")
_OPEN = re.compile(r"(<<SYS>>|\[INST\]|<s>|\[ROLE=[A-Za-z0-9%._~-]*\]) ")
_ROLE_OF = {mark[0]: role for role, mark in MARKS.items()}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _render(role: str, text: str) -> tuple[str, int]:
    """The turn, and where its text begins."""
    begin, end = MARKS.get(role) or (f"[ROLE={quote(role, safe='')}]", "[/ROLE]")
    return f"{begin} {text} {end}", len(begin) + 1


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The (role, text) turns of a formatted conversation; None if it doesn't follow the grammar."""
    out, at = [], 0
    while at < len(formatted):
        m = _OPEN.match(formatted, at)
        if not m:
            return None
        role = _ROLE_OF.get(m[1])
        close = MARKS[role][1] if role else "[/ROLE]"
        end = formatted.find(f" {close}", m.end())
        if end < 0:
            return None
        out.append((unquote(m[1][6:-1]) if role is None else role, unescape(formatted[m.end() : end])))
        at = end + 1 + len(close)
    return out


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask; parse() gives ``turns`` back."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = text
        rendered, inner = _render(role, body)
        if CONTROL.search(text) or parse(rendered) != [(role, text)]:
            body = escape(text)
            rendered, inner = _render(role, body)
        if role == "assistant":
            spans.append((at + inner, at + inner + len(body)))
        parts.append(rendered)
        at += len(rendered)
    formatted = "".join(parts)
    if parse(formatted) != turns:
        raise ValueError("a conversation doesn't survive its round trip")
    return formatted, spans


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<begin, end>>), one row per conversation."""
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for part in parts:
            for at in range(0, part.num_rows, 256):
                some = part.slice(at, 256)
                done = [format_turns([(t["role"], t["text"]) for t in x]) for x in some.column(1).to_pylist()]
                spans = [[{"begin": b, "end": e} for b, e in s] for _, s in done]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([f for f, _ in done], pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "loss_spans"])

    return chats.mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<begin: long, end: long>>")


def chat_digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and loss text, as counts and digests."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for part in parts:
            rows = []
            for conv, formatted, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                turns = parse(formatted)
                loss = "".join(unescape(formatted[s["begin"] : s["end"]]) for s in spans)
                rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
