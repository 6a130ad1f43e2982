r"""Conversations rendered through a compiled template, with a loss mask, and read back.

Control strings are ``<turn ``, ``>`` and ``</turn>``.  Inside texts ``\`` becomes ``\\`` and ``<`` becomes ``\l``; in roles also ``>``
becomes ``\g`` and a line feed ``\n``: no control string can appear in a text, and the change can be undone.

Rows are shuffled by conversation, sorted by turn (then role and text), and rendered as a stream: a conversation that holds a third of
all rows needs the memory of one message.  Null roles and texts count as empty; null conversation ids form one conversation;
rows with the same turn all stay.  An empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echotrace.llm.common import read_table, save
from echotrace.llm.templates import compile_template

TEMPLATE = r"""{% for m in messages %}<turn {{ m.role | escape_role }}>
{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>
{% endfor %}"""
_BACK = {"\\\\": "\\", "\\l": "<", "\\g": ">", "\\n": "\n"}
_HEAD, _TAIL = "<turn ", "</turn>\n"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_role(text: str) -> str:
    return escape(text).replace(">", "\\g").replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\[\\lgn]", lambda m: _BACK[m[0]], text)


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns), strict=True)


def _tables(rows: Iterator[tuple], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size > limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The rendered conversations as (conv_id, part, text, loss): parts in order make up the text; ``loss`` marks what is to be learnt.
    Rows are dealt by conv_id and sorted by (conv_id, part) within partitions."""
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("loss", pa.bool_())])

    def parts(rows: Iterator[tuple]) -> Iterator[tuple]:
        render = compile_template(template, {"escape": escape, "escape_role": escape_role})
        for conv, own in groupby(rows, key=lambda r: r[0]):
            part, plain = 0, []
            for text, loss in render({"role": role or "", "text": text or ""} for _, role, text in own):
                if loss or sum(map(len, plain)) > 1 << 16:
                    if plain:
                        yield conv, part, "".join(plain), False
                        part += 1
                        plain = []
                if loss:
                    yield conv, part, text, True
                    part += 1
                else:
                    plain.append(text)
            if plain:
                yield conv, part, "".join(plain), False

    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return turns.mapInArrow(lambda batches: _tables(parts(_rows(batches, "conv_id", "role", "text")), schema), "conv_id long, part long, text string, loss boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its rendered text and loss mask.  ``formatted`` is as format_conversations returns it,
    in whatever order it was written and read."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv, own in groupby(rows, key=lambda r: r[0]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n = loss_chars = chars = 0
            held: list[str] = []
            for _, text, learnt in own:
                chars += len(text)
                if learnt:
                    plain = unescape(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                held.append(text)
                if _TAIL not in text:
                    continue
                *whole, rest = "".join(held).split(_TAIL)
                held = [rest] if rest else []
                for turn in whole:
                    role, body = turn.removeprefix(_HEAD).split(">\n", 1)
                    turns.update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    n += 1
            yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    dealt = formatted.select("conv_id", "part", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(lambda batches: _tables(digests(_rows(batches, "conv_id", "text", "loss")), schema), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


EXAMPLE = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXAMPLE), (-7, 1, "assistant", EXAMPLE)], "conv_id long, turn long, role string, text string")
    return read_back(save(format_conversations(turns.unionByName(extra)), "formatted"))


QUERIES = {"op5_chat_format": op5_chat_format}
SQL = {
    "op5_chat_format": r"""
with turns as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sizes as (select *, length(replace(replace(text, '\', '\\'), '<', '\l')) + length(replace(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g'), chr(10), '\n')) + 16 chars from turns)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) loss_sha256, sum(chars)::bigint formatted_chars
from sizes group by conv_id
"""
}
