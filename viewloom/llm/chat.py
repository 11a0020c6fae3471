"""Conversations through a compiled chat template, with marks on the text to learn from.

Rows of a conversation go in the order of turn, role and text (nulls first); repeated rows are separate turns.
Null roles and texts are empty. Null conv_id is one conversation. Extra columns are ignored.

The output has pieces: conv_id, seq, text, loss. The pieces of a conversation in the order of seq are its whole
formatted text, those with loss are what to learn from. Conversations are dealt by conv_id and sorted inside
each task, and the template pulls messages one at a time, so memory is bounded by one turn however long a
conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from viewloom.llm.template import compile_template, unescape, unheader

START, STOP = "<|im_start|>", "<|im_end|>\n"
CHATML = """
{%- for message in messages -%}
<|im_start|>{{ message.role | header }}{{ '\\n' }}
{%- if message.role == 'assistant' -%}
{% generation %}{{ message.content | escape }}{% endgeneration %}
{%- else -%}
{{ message.content | escape }}
{%- endif -%}
<|im_end|>{{ '\\n' }}
{%- endfor -%}
"""
PIECE = 1 << 16
BATCH_ROWS, BATCH_CHARS = 2000, 1 << 21


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    return chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)


def _batched(rows: Iterator[tuple], schema: pa.Schema, chars) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += chars(row)
        if len(held) >= BATCH_ROWS or size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _joined(pieces: Iterator[tuple[str, bool]]) -> Iterator[tuple[str, bool]]:
    """Neighbours with the same mark become one piece, up to PIECE characters or so."""
    held, size, mark = [], 0, False
    for text, marked in pieces:
        if held and (marked != mark or size >= PIECE):
            yield "".join(held), mark
            held, size = [], 0
        if text:
            mark = marked
            held.append(text)
            size += len(text)
    if held:
        yield "".join(held), mark


def format_conversations(turns: DataFrame, template: str = CHATML) -> DataFrame:
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("text", pa.string()), ("loss", pa.bool_())])
    compile_template(template)  # errors show here, not in a task

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = compile_template(template)

        def rows():
            for conv, group in groupby(_rows(batches), key=lambda r: r[0]):
                messages = ({"role": role or "", "content": text or ""} for _, _, role, text in group)
                for seq, (text, loss) in enumerate(_joined(run({"messages": messages}))):
                    yield conv, seq, text, loss

        return _batched(rows(), schema, lambda r: len(r[2]))

    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(render, "conv_id long, seq long, text string, loss boolean")


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of what format_conversations wrote with CHATML, a row per conversation, parsed from its pieces alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(conv, group):
        turns, learnt = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        held, marked, seen = "", [], 0  # no end of a turn begins before `seen`
        for _, _, text, loss in chain(group, [(conv, -1, "", False)]):
            chars += len(text)
            seen = max(seen, len(held) - len(STOP) + 1)
            held += text
            if loss:
                marked.append(text)
            elif marked:
                plain = unescape("".join(marked))
                loss_chars += len(plain)
                learnt.update(plain.encode())
                marked = []
            while (stop := held.find(STOP, seen)) >= 0:
                head, _, body = held[:stop].partition("\n")
                if not head.startswith(START):
                    raise ValueError(f"conversation {conv}: a turn does not start as one")
                turns.update(f"{unheader(head[len(START) :])}\n{unescape(body)}\n".encode())
                held, n, seen = held[stop + len(STOP) :], n + 1, 0
        if held:
            raise ValueError(f"conversation {conv}: text is left over")
        return conv, n, turns.hexdigest(), loss_chars, learnt.hexdigest(), chars

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (digest(conv, group) for conv, group in groupby(_rows(batches), key=lambda r: r[0]))
        return _batched(rows, pa.schema(list(zip(names, kinds, strict=True))), lambda r: 0)

    return pieces.select("conv_id", "seq", "text", "loss").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
