r"""Conversations as training text with a loss mask, by a compiled template, and back.

A template (language in template.py) is compiled once a task into closures. Turns are dealt by conversation and sorted by
turn; a task streams its sorted rows through the closures, a turn at a time, and writes formatted text in parts, so a
conversation is never held whole, however long: its parts are cut between pieces of output once they have PART code points.
Spans of `{% generation %}` blocks are the loss mask.

Texts are escaped so that no control string of the template stands in them: a backslash is doubled, a control string of
several characters gets a backslash after its first one, and a control string of one character gets it in front. So the
first control string found in the output is always the template's own, and dropping the backslashes gives the text back.

Defined results. Null text and null role count as empty. Turns go by turn number, nulls last, then role and text; repeated
rows are turns of their own. Rows of a null conversation are one conversation. Any role is allowed; only 'assistant' is
under the mask. An empty table gives no rows. Extra columns are ignored. The order of turns is one of the contract's, so
one conversation is one task's work: time, not memory, grows with the longest.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import template as language
from .common import pick

#: The control strings of the default template, in the order in which they frame a turn.
OPEN, HEAD, CLOSE, END = "<turn ", ">", "</turn>", "\n"
MARKS = (OPEN, CLOSE)

TEMPLATE = """\
{%- for m in messages -%}
{{ open ~ (m.role | escape(head)) ~ head ~ "\\n" }}
{%- if m.role == "assistant" %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif -%}
{{ close ~ "\\n" }}
{%- if loop.last and add_prompt %}{{ open ~ "assistant" ~ head ~ "\\n" }}{% endif -%}
{%- endfor -%}
"""

#: Code points after which a part of a formatted conversation is cut; rows of a batch that a task writes.
PART, BATCH = 1 << 20, 1024

FORMATTED = "conv_id long, part long, text string, spans array<struct<start:int,end:int>>"
TURNS = "conv_id long, turn long, role string, text string, loss string"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@cache
def _pattern(marks: tuple[str, ...]) -> re.Pattern:
    if any("\\" in m or not m for m in marks):
        raise ValueError("control strings can't be empty or hold a backslash")
    return re.compile("|".join(re.escape(m) for m in ("\\", *sorted(marks, key=len, reverse=True))))


def _broken(m: re.Match) -> str:
    mark = m[0]
    return "\\" + mark if len(mark) == 1 else mark[0] + "\\" + mark[1:]


def escaper(marks: tuple[str, ...]):
    """(text, *more) -> text without any of marks and more; unescape() turns it back."""
    return lambda text, *more: _pattern(marks + more).sub(_broken, language.text_of(text))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def parts(pieces: Iterator, size: int) -> Iterator[tuple[int, str, list[dict]]]:
    """(part, text, spans) of a conversation's pieces; a generation that a cut goes through has a span in both parts."""
    number, held, length, spans, began = 0, [], 0, [], None
    for piece in pieces:
        if piece is language.BEGIN:
            began = length
        elif piece is language.END:
            if length > began:
                spans.append({"start": began, "end": length})
            began = None
        else:
            held.append(piece)
            length += len(piece)
            if length >= size:
                if began is not None and length > began:
                    spans.append({"start": began, "end": length})
                yield number, "".join(held), spans
                number, held, length, spans, began = number + 1, [], 0, [], None if began is None else 0
    if length or not number:
        yield number, "".join(held), spans


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*[b.column(n).to_pylist() for n in names], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of BATCH rows or, with the place of a text column, of about PART code points."""
    held: list[tuple] = []
    heavy = 0

    def flush() -> pa.RecordBatch:
        cols = zip(*held, strict=True) if held else [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    for r in rows:
        held.append(r)
        heavy += len(r[weight]) if weight is not None else 0
        if len(held) >= BATCH or heavy >= PART:
            yield flush()
            held, heavy = [], 0
    yield flush()


def _mapped(df: DataFrame, rows, schema: str, weight: int | None = None) -> DataFrame:
    out = StructType.fromDDL(schema)
    return df.mapInArrow(lambda batches: _batches(rows(batches), to_arrow_schema(out), weight), out)


def format_chats(chats: DataFrame, source: str = TEMPLATE, marks: tuple[str, ...] = MARKS, constants: dict[str, object] | None = None, part: int = PART) -> DataFrame:
    """chats (conv_id, turn, role, text; a row for each turn) as (conv_id, part, text, spans): the output of the template in
    parts of about `part` code points, spans of generation as code points of the part. constants: names with fixed values
    besides open, head and close (the control strings) and add_prompt (false)."""
    given = {"open": OPEN, "head": HEAD, "close": CLOSE, "add_prompt": False} | (constants or {})
    base = pick(chats, {"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long"), "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    ordered = base.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        render = language.compile_template(source, {"escape": escaper(marks)}, given)
        for conv, turns in groupby(_rows(batches, "conv_id", "role", "text"), key=lambda r: r[0]):
            messages = ({"role": role, "text": text} for _, role, text in turns)
            for found in parts(render({"messages": messages}), part):
                yield conv, *found

    return _mapped(ordered, rows, FORMATTED, weight=2)


def _turns(formatted: Iterator[tuple[str, list[dict]]], begin: str, head: str, close: str) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of each turn, read from the parts of one conversation. What is kept is the part
    that is read, and of the one before it the turn that it cut."""
    rest, at = "", 0
    spans: deque[tuple[int, int]] = deque()

    def find(wanted: str, place: int) -> int:
        """Where wanted stands at or behind place; reads on until it does. -1: nowhere."""
        nonlocal rest, at, spans
        found = rest.find(wanted, place)
        while found < 0 and (following := next(formatted, None)):
            kept = min(at, len(rest))
            rest, at, place = rest[kept:], 0, max(0, place - kept)
            spans = deque((a - kept, b - kept) for a, b in spans)
            spans.extend((len(rest) + x["start"], len(rest) + x["end"]) for x in following[1])
            rest += following[0]
            found = rest.find(wanted, place)
        return found

    while (end := find(close, at)) >= 0:
        masked = []
        while spans and spans[0][0] < end:
            first, last = spans.popleft()
            masked.append(rest[first : min(last, end)])
        yield *_turn(rest[at:end], begin, head), "".join(map(unescape, masked))
        at = end + len(close)
        following = find(begin, at)
        at = len(rest) if following < 0 else following
    if rest[at:].strip() and not re.fullmatch(_head(begin, head), rest[at:], re.S):
        raise ValueError(f"no turn: {rest[at : at + 80]!r}")


def _head(begin: str, head: str) -> str:
    """A pattern of what stands before a turn's text; a prompt for the next turn ends with one."""
    return re.escape(begin) + r"((?:[^\\]|\\.)*?)" + re.escape(head) + "\n"


def _turn(text: str, begin: str, head: str) -> tuple[str, str]:
    m = re.match(_head(begin, head), text, re.S)
    if not m:
        raise ValueError(f"no turn: {text[:80]!r}")
    return unescape(m[1]), unescape(text[m.end() :])


def read_back(formatted: DataFrame, begin: str = OPEN, head: str = HEAD, close: str = CLOSE, in_order: bool = False) -> DataFrame:
    """The output of format_chats as turns again: (conv_id, turn, role, text, loss), turns numbered from 0, loss the text
    under the mask. in_order: parts of a conversation stand together and in order already, as format_chats gives them;
    else they are dealt and sorted once more. begin, head (followed by a line feed) and close frame a turn."""
    return _mapped(_in_order(formatted, in_order), lambda batches: _read_turns(batches, begin, head, close), TURNS, weight=3)


def _in_order(formatted: DataFrame, in_order: bool) -> DataFrame:
    slim = formatted.select("conv_id", "part", "text", "spans")
    return slim if in_order else slim.repartition("conv_id").sortWithinPartitions("conv_id", "part")


def _read_turns(batches: Iterator[pa.RecordBatch], begin: str, head: str, close: str) -> Iterator[tuple]:
    for conv, found in groupby(_rows(batches, "conv_id", "text", "spans"), key=lambda r: r[0]):
        for k, turn in enumerate(_turns(((text, spans) for _, text, spans in found), begin, head, close)):
            yield conv, k, *turn


def digests(formatted: DataFrame, begin: str = OPEN, head: str = HEAD, close: str = CLOSE, in_order: bool = False) -> DataFrame:
    """A row for each conversation, from the formatted text alone: turns, their SHA-256 (role, line feed, text, line feed),
    code points and SHA-256 of the text under the mask, code points of the formatted text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for conv, found in groupby(_rows(batches, "conv_id", "text", "spans"), key=lambda r: r[0]):
            length = 0

            def read(found=found):
                nonlocal length
                for _, text, spans in found:
                    length += len(text)
                    yield text, spans

            turns, loss, n, n_loss = hashlib.sha256(), hashlib.sha256(), 0, 0
            for role, text, masked in _turns(read(), begin, head, close):
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(masked.encode())
                n, n_loss = n + 1, n_loss + len(masked)
            yield conv, n, turns.hexdigest(), n_loss, loss.hexdigest(), length

    return _mapped(_in_order(formatted, in_order), rows, DIGESTS)
