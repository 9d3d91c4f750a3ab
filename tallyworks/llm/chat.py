"""Conversations as training text, with the spans that the model is to learn.

A turn reads ``### role: text</turn>`` and a line end. Texts and roles are escaped so that none of
the template's own strings can appear in them, and can be read back exactly:

    \\  as \\\\       #  as \\h where two more follow       <  as \\l before /turn>       :  in roles as \\c
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tallyworks.llm.template import Segment, compiled

TEMPLATE = """\
{%- for m in messages -%}
### {{ m.role|escape_role }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text|escape }}{% endgeneration %}{% else %}{{ m.text|escape }}{% endif %}</turn>
{% endfor -%}
"""

# Code points of output gathered before a row is emitted; a conversation of more becomes several rows.
PART_CHARS = 1 << 20

_ESCAPED = re.compile(r"\\|#(?=##)|<(?=/turn>)")
_CODES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_PLAIN = {"\\": "\\", "h": "#", "l": "<", "c": ":"}


def escape(text: str | None) -> str:
    return _ESCAPED.sub(lambda m: _CODES[m[0]], text or "")


def escape_role(role: str | None) -> str:
    return escape(role).replace(":", _CODES[":"])


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text)


FILTERS = {
    "escape": escape,
    "escape_role": escape_role,
    "trim": lambda v: (v or "").strip(),
    "upper": lambda v: (v or "").upper(),
    "lower": lambda v: (v or "").lower(),
}


def render(template: str, messages: Iterable[dict]) -> Iterator[Segment]:
    return compiled(template, FILTERS)(messages=messages)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def formatted(
    conversations: DataFrame,
    template: str = TEMPLATE,
    *,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conv_id, part, n_turns, text, spans): each conversation rendered, its turns in order.

    ``spans`` are the (start, end) code points in ``text`` inside generation blocks. A conversation of over
    ``PART_CHARS`` code points goes on in further parts, cut between segments; ``n_turns`` counts
    the turns whose end lies in the part. So no conversation is held whole, whatever its length.

    Turns are ordered by turn, then role and text, nulls first. A null text or role is empty; rows
    with a null ``conv_id`` are a conversation of their own; repeated rows are turns of their own; other
    columns are left out. An empty table gives no rows. A conversation's parts come in order in one
    partition.
    """
    names = [id_col, turn_col, role_col, text_col]
    turns = conversations.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(names, ["conv_id", "turn", "role", "text"])])
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    kind = turns.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, part long, n_turns long, text string, spans array<struct<start:long,end:long>>"

    def one(render_turns, rows: Iterator[dict]) -> Iterator[tuple]:
        ended, part, text, size, spans = 0, 0, [], 0, []

        def counted() -> Iterator[dict]:
            nonlocal ended
            for r in rows:
                yield {"role": r["role"] or "", "text": r["text"] or ""}
                ended += 1

        before = 0
        for segment, learnt in render_turns(messages=counted()):
            if size and size + len(segment) > PART_CHARS:
                yield part, ended - before, "".join(text), spans
                part, before, text, size, spans = part + 1, ended, [], 0, []
            if learnt and segment:
                spans.append({"start": size, "end": size + len(segment)})
            text.append(segment)
            size += len(segment)
        yield part, ended - before, "".join(text), spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render_turns = compiled(template, FILTERS)
        types = None
        out, held = [], 0
        for batch_schema, rows in _with_schema(batches):
            types = pa.schema(
                [
                    pa.field("conv_id", batch_schema.field("conv_id").type),
                    pa.field("part", pa.int64()),
                    pa.field("n_turns", pa.int64()),
                    pa.field("text", pa.string()),
                    pa.field("spans", pa.list_(pa.struct([pa.field("start", pa.int64()), pa.field("end", pa.int64())]))),
                ]
            )
            for conv_id, turns_of in groupby(rows, key=lambda r: r["conv_id"]):
                for part, n_turns, text, spans in one(render_turns, turns_of):
                    out.append({"conv_id": conv_id, "part": part, "n_turns": n_turns, "text": text, "spans": spans})
                    held += len(text)
                    if held > PART_CHARS:
                        yield pa.RecordBatch.from_pylist(out, schema=types)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return turns.mapInArrow(run, schema)


def _with_schema(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Schema, Iterator[dict]]]:
    """The schema of the batches with all their rows, once; nothing if there are no batches."""
    first = next(batches, None)
    if first is not None:

        def rows() -> Iterator[dict]:
            yield from first.to_pylist()
            yield from _rows(batches)

        yield first.schema, rows()


# --- reading back ---------------------------------------------------------------------

_TURN = re.compile(r"### (.*?): (.*?)</turn>\n", re.S)


def turns_of(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a text written by ``TEMPLATE``."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError("not a conversation of this template")
        yield unescape(m[1]), unescape(m[2])
        at = m.end()


def digests(parts: DataFrame) -> DataFrame:
    """Read formatted conversations back: one row per conversation with what its text says.

    conv_id, ``n_turns``, ``turns_sha256`` (of role, line end, text, line end per turn), ``loss_chars`` and
    ``loss_sha256`` (the text under the spans, unescaped) and ``formatted_chars``. ``parts`` must come as
    ``formatted`` gives them, parts of a conversation in order in one partition.
    """
    kind = parts.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def read(rows: Iterator[dict]) -> dict:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        rest = ""
        for row in rows:
            chars += len(row["text"])
            for span in row["spans"]:
                learnt = unescape(row["text"][span["start"] : span["end"]])
                loss_chars += len(learnt)
                loss.update(learnt.encode("utf-8", "surrogatepass"))
            rest += row["text"]
            end = rest.rfind("</turn>\n") + len("</turn>\n") if "</turn>\n" in rest else 0
            for role, text in turns_of(rest[:end]):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            rest = rest[end:]
        if rest:
            raise ValueError("a conversation ends inside a turn")
        return {
            "n_turns": n_turns,
            "turns_sha256": turns.hexdigest(),
            "loss_chars": loss_chars,
            "loss_sha256": loss.hexdigest(),
            "formatted_chars": chars,
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch_schema, rows in _with_schema(batches):
            longs, strings = pa.int64(), pa.string()
            types = pa.schema(
                [
                    pa.field("conv_id", batch_schema.field("conv_id").type),
                    *[pa.field(n, t) for n, t in zip(["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"], [longs, strings, longs, strings, longs])],
                ]
            )
            out = []
            for conv_id, of in groupby(rows, key=lambda r: r["conv_id"]):
                out.append({"conv_id": conv_id, **read(of)})
                if len(out) == 10_000:
                    yield pa.RecordBatch.from_pylist(out, schema=types)
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=types)

    return parts.mapInArrow(run, schema)
