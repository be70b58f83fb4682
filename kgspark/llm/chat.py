"""Chat formatting from event logs.

Events (conv_id, seq, message_id, op, role, text) are dealt to tasks by conversation, once, and sorted by message and
sequence there; one pass folds each message's events: ``delta`` appends, ``edit`` replaces, ``regenerate`` discards what
was streamed so far, ``delete`` empties the message and takes it out unless later events bring it back. The messages go
on in conversation order, are rendered row by row, and can be read back, all without another exchange. A task holds one
message at a time, and a conversation is a stream through it, so the length of a conversation costs time but no memory.

Messages stand in the order of their first event (ties: message_id, role, text). An event without a message_id is a
message of its own, and equal ones are messages each. Events of one message that are equal in every field are one event
that was sent again. Events of equal seq apply in the order edit, regenerate, delta, delete, then by role and text; an unknown
op counts as delta. The role is the first that is named. Nulls: text and role read as empty, a null conv_id is a
conversation of its own, null seq sorts first. An empty table gives an empty result; other columns are not read.

Template: ``<|turn|>role<|text|>text<|end|>``. In role and text, a backslash precedes every backslash and every
``<|``; taking away the first of each such pair gives the original back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
EDIT, REGENERATE, DELTA, DELETE = OPS = ("edit", "regenerate", "delta", "delete")
_BODY = r"((?:[^\\<]|\\[\s\S]|<(?!\|))*)"
_PARSE = re.compile(re.escape(TURN) + _BODY + re.escape(TEXT) + _BODY + re.escape(END))
_UNESCAPE = re.compile(r"\\([\s\S])")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("\\<|"))


def unescaped(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s) if "\\" in s else s


_MESSAGE = pa.schema(
    [("conv_id", pa.int64()), ("first", pa.int64()), ("message_id", pa.string()), ("role", pa.string()), ("text", pa.string())]
)
#: Characters of folded text that a task holds before it hands them on.
FLUSH = 4_000_000


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, first (seq of the first event), message_id, role, text; whole conversations in order."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, OPS)), F.col("op")), F.lit(0))
    e = events.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("message_id").cast("string").alias("message_id"),
        F.when(rank > 0, rank).otherwise(OPS.index(DELTA) + 1).cast("int").alias("rank"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    # Clustered by conversation already, so the window brings no exchange.
    lone = F.col("message_id").isNull()
    first = F.min("seq").over(W.partitionBy("conv_id", "message_id", F.when(lone, F.col("seq"))))
    ordered = e.withColumn("first", F.when(lone, F.col("seq")).otherwise(first)).sortWithinPartitions("conv_id", "first", "message_id", "seq", "rank", "role", "text")

    def run(batches):
        done: list[tuple] = []
        size = 0
        key = last = None
        role, parts, alive = "", [], False

        def close():
            nonlocal size
            if key is not None and alive:
                text = "".join(parts)
                size += len(text)
                done.append((*key, role, text))

        for batch in batches:
            for conv, first, message, seq, rank, who, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                event = (seq, rank, who, text)
                if message is None or key != (conv, first, message):
                    close()
                    key, role, parts, alive = (conv, first, message), "", [], False
                elif event == last:
                    continue
                last = event
                role = role or who
                op = OPS[rank - 1]
                if op != DELTA:
                    parts.clear()
                alive = op != DELETE
                if alive:
                    parts.append(text)
                if size > FLUSH or len(done) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)
                    done.clear()
                    size = 0
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*done, strict=True), _MESSAGE, strict=True)], schema=_MESSAGE)

    return ordered.select("conv_id", "first", "message_id", "seq", "rank", "role", "text").mapInArrow(
        run, "conv_id long, first long, message_id string, role string, text string"
    )


def render(messages: DataFrame) -> DataFrame:
    """One formatted chunk a message; a conversation's chunks in order are its formatted text.

    ``loss_start`` and ``loss_end`` bound the text under the loss mask within the chunk (null for other roles).
    """
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT))
    body = escaped(F.col("text"))
    loss = F.col("role") == "assistant"
    return messages.select(
        "conv_id", "first", "message_id",
        F.concat(head, body, F.lit(END)).alias("chunk"),
        F.when(loss, F.length(head)).alias("loss_start"),
        F.when(loss, F.length(head) + F.length(body)).alias("loss_end"),
    )


_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


def read_back(chunks: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted chunks; a stream, so memory follows one batch.

    The chunks stand as ``render`` gives them: whole conversations in a partition, in order. Chunks that were stored
    and read again go through ``in_order`` first.
    """

    def run(batches):
        now, state = None, None
        done: list[tuple] = []

        def close():
            if state is not None:
                done.append((now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            for conv, chunk, a, b in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "chunk", "loss_start", "loss_end")), strict=True):
                if now is None or now[0] != conv:
                    close()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for m in _PARSE.finditer(chunk):
                    state[0] += 1
                    state[1].update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                if a is not None:
                    text = unescaped(chunk[a:b])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(chunk)
            if len(done) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in done], schema=_READ)
                done.clear()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(_READ.names, r, strict=True)) for r in done], schema=_READ)

    return chunks.select("conv_id", "chunk", "loss_start", "loss_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def in_order(chunks: DataFrame) -> DataFrame:
    """Stored chunks as ``render`` gave them."""
    return chunks.repartition("conv_id").sortWithinPartitions("conv_id", "first", "message_id", "chunk")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as an event log: each row is a message of its own; rows of equal turn stand by role and text."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit(None).cast("string").alias("message_id"), F.lit(DELTA).alias("op"), "role", "text"
    )


#: Numbers that a turn has for its events in a made log.
STRIDE = 8


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log that would have led to it, for trying the fold on given tables.

    Turns are numbered in order (by turn, nulls first, then role and text), and each is a message of two to four events
    with numbers of their own. By a hash of its place, a text was streamed in three deltas, one of them sent twice; or a
    draft was streamed, regenerated and went on; or a draft was replaced by an edit; or a draft was deleted and the text
    came afterwards. The role is named by the first event only.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), role, text)
    rows = conversations.select("conv_id", role.alias("role"), text.alias("text"), F.row_number().over(order).cast("long").alias("n"))
    third = F.ceil(F.length("text") / 3).cast("int")
    part = lambda k: F.substring(F.col("text"), third * k + 1, third)
    rest = F.substring(F.col("text"), third + 1, F.length("text"))
    draft = F.concat(part(0), F.lit("..."))
    event = lambda k, op, said: F.struct(F.lit(k).cast("long").alias("k"), F.lit(op).alias("op"), said.alias("text"))
    kinds = (
        [event(0, DELTA, part(0)), event(1, DELTA, part(1)), event(1, DELTA, part(1)), event(2, DELTA, part(2))],
        [event(0, DELTA, draft), event(1, REGENERATE, part(0)), event(2, DELTA, rest)],
        [event(0, DELTA, draft), event(1, EDIT, F.col("text"))],
        [event(0, DELTA, draft), event(1, DELETE, F.lit("")), event(2, DELTA, F.col("text"))],
    )
    kind = F.pmod(F.xxhash64("conv_id", "n"), F.lit(len(kinds)))
    told = F.when(kind == 0, F.array(*kinds[0]))
    for k, events in enumerate(kinds[1:], 1):
        told = told.when(kind == k, F.array(*events))
    each = rows.select("conv_id", "n", "role", F.explode(told).alias("e"))
    return each.select(
        "conv_id", (F.col("n") * STRIDE + F.col("e.k")).alias("seq"), F.concat(F.lit("m"), F.col("n")).alias("message_id"), "e.op",
        F.when(F.col("e.k") == 0, F.col("role")).alias("role"), "e.text",
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|>' || replace(replace(role, '\', '\\'), '<|', '\<|') || '<|text|>'
    || replace(replace(text, '\', '\\'), '<|', '\<|') || '<|end|>'))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
