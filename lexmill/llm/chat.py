"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to one string. `spans` knows nothing of its inside: it
renders the first 1, 2, ... turns, and what a rendering adds to the one before is the new turn's span. A second
rendering with a marker as the newest text shows where inside its span the text begins and ends. A rendering that
does not begin with the one before rewrites history; such a conversation is flagged and gets no spans, because no
part of its output belongs to one turn for good.

`bracket_template` is the built-in template. It escapes its control characters inside texts and roles, so
`read_back` recovers the turns from the output alone.

Turns are ordered by turn, then role, then text, nulls first; null roles and texts are empty. Equal rows are turns of
their own, a null conv_id is a conversation like any other, columns other than the four are not read, and an empty table
gives an empty one. A conversation is one row of the result and is rendered in one task, of whose turns each prefix is
rendered: time is quadratic in the turns of one conversation (not in their number over all), memory linear in its text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
MARKER = ""
_CONTROL = re.compile(r"([\\<\[])")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def bracket_template(turns: Turns) -> str:
    parts = []
    for role, text in turns:
        said = escape(text)
        if role == "user":
            parts.append(f"<s>[INST] {said} [/INST]")
        elif role == "assistant":
            parts.append(f" {said} </s>")
        elif role == "system":
            parts.append(f"<<SYS>>\n{said}\n<</SYS>>\n")
        else:
            parts.append(f"[ROLE {escape(role).replace(']', chr(92) + ']')}]\n{said}\n[/ROLE]\n")
    return "".join(parts)


_BODY = r"((?:[^\\<\[]|\\.)*)"
_TURN = re.compile(
    rf"<s>\[INST\] {_BODY} \[/INST\]| {_BODY} </s>|<<SYS>>\n{_BODY}\n<</SYS>>\n|\[ROLE ((?:[^\\\]]|\\.)*)\]\n{_BODY}\n\[/ROLE\]\n",
    re.DOTALL,
)


def read_back(formatted: str) -> Turns:
    """The turns that bracket_template rendered."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at character {at}")
        user, assistant, system, role, other = m.groups()
        name, said = ("user", user) if user is not None else ("assistant", assistant) if assistant is not None else ("system", system) if system is not None else (unescape(role), other)
        turns.append((name, unescape(said)))
        at = m.end()
    return turns


def spans(turns: Turns, template: Template) -> tuple[str, list[tuple[int, int, int, int]] | None]:
    """(output, for each turn: start and end of its span, start and end of its text), code points, ends exclusive;
    None instead of the list if the template rewrites history."""
    out, before = [], template([])
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        marked = template([*turns[: k - 1], (turns[k - 1][0], MARKER)])
        if not (now.startswith(before) and marked.startswith(before)):
            return template(turns), None
        lead = marked.find(MARKER, len(before))
        tail = len(marked) - lead - len(MARKER)
        if lead < 0 or len(now) < lead + tail or now[:lead] != marked[:lead] or now[len(now) - tail :] != marked[len(marked) - tail :]:
            out.append((len(before), len(now), len(before), len(before)))
        else:
            out.append((len(before), len(now), lead, len(now) - tail))
        before = now
    return before, out


SCHEMA = "n_turns long, formatted string, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>, rewrites_history boolean"


def format_conversations(rows: DataFrame, template: Template = bracket_template) -> DataFrame:
    """rows (conv_id, turn, role, text) to one row for each conv_id: n_turns, formatted, spans, rewrites_history."""
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce("text", empty).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    span = pa.list_(pa.struct([("role", pa.string()), *[(n, pa.int64()) for n in ("start", "end", "text_start", "text_end")]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, texts, marks, rewrites = [], [], [], []
            for said in batch.column(1).to_pylist():
                turns = [(t["role"], t["text"]) for t in said]
                text, found = spans(turns, template)
                n.append(len(turns))
                texts.append(text)
                marks.append(None if found is None else [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d} for (r, _), (a, b, c, d) in zip(turns, found, strict=True)])
                rewrites.append(found is None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(marks, span), pa.array(rewrites)], names=["conv_id", "n_turns", "formatted", "spans", "rewrites_history"])

    ordered = grouped.select("conv_id", F.sort_array("turns").alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"conv_id {kind}, {SCHEMA}")


def digests(formatted: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """What can be read back from the formatted conversations: turns, and the text under the loss mask."""

    def one(text: str, marks) -> tuple:  # noqa: ANN001
        turns = read_back(text)
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(unescape(text[m["text_start"] : m["text_end"]]) for m in marks or () if m["role"] in loss_roles)
        return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        for batch in batches:
            rows = [one(t, m) for t, m in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(3)], names=["conv_id", *names, "rewrites_history"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "spans", "rewrites_history").mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
