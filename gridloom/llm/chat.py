"""Chat formatting from an event log.

A log row is (conv_id, seq, kind, turn, role, text). Kinds: ``message`` sets a turn's role and text,
``delta`` appends streamed text to a turn, ``edit`` replaces its text, ``regenerate`` replaces it
and drops all later turns, ``delete`` removes it. The log is partitioned by conversation, sorted by
sequence and folded into final messages, which are then rendered.

Template: each message is ``### {role}:\\n{text}</turn>\\n``. In roles and texts a backslash is
doubled and a control string (``###``, ``</turn>``, in roles also ``:``) gets one backslash before
it, so the escape is reversible and control strings inside texts never end a turn.

Defined results: null text or role counts as empty; null kind as ``message``; null turn as the
row's sequence; rows of equal sequence are folded in the order of (turn, kind, role, text), the
last message of a turn wins unless ``distinct_turns`` keeps each row as a turn of its own; null
conversation ids form one conversation; an empty log gives no rows; other columns are ignored.
A conversation is one training example and is held in memory whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


OPEN, CLOSE = "### ", "</turn>\n"
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,stop:long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

_ESCAPE = re.compile(r"\\|###|</turn>")
_ESCAPE_ROLE = re.compile(r"\\|###|</turn>|:")
_UNESCAPE = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]++|\\\\|\\###|\\</turn>|\\:)*):\n((?:[^\\<]++|\\\\|\\###|\\</turn>|<(?!/turn>))*)</turn>\n")


def escape(text: str, role: bool = False) -> str:
    return (_ESCAPE_ROLE if role else _ESCAPE).sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def fold(events: Iterable[tuple]) -> list[tuple[str, str]]:
    """Final (role, text) messages, in the order of turns, of sorted (kind, turn, role, text) events."""
    turns: dict[int, list] = {}
    for kind, turn, role, text in events:
        at = turns.setdefault(turn, ["", []])
        if kind == "delta":
            at[1].append(text)
        elif kind == "delete":
            del turns[turn]
            continue
        else:
            at[1] = [text]
            if kind == "regenerate":
                for later in [t for t in turns if t > turn]:
                    del turns[later]
        if role:
            at[0] = role
    return [(role, "".join(parts)) for _, (role, parts) in sorted(turns.items())]


def render(messages: Iterable[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of it (code points) that the loss covers."""
    parts, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{escape(role, True)}:\n", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text; raises where it does not follow the template."""
    found, at = [], 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"not a turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def _fold_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted log rows to one row per conversation; a conversation may span batches."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
    now, events, done = object(), [], []

    def close() -> None:
        if events:
            messages = fold(events)
            text, spans = render(messages)
            done.append((now, len(messages), text, [{"start": a, "stop": b} for a, b in spans]))

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    for batch in batches:
        for conv, *event in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text"))):
            if conv != now:
                close()
                now, events = conv, []
            events.append(tuple(event))
        if done:
            yield out()
            done = []
    close()
    if done:
        yield out()


def format_log(log: DataFrame, distinct_turns: bool = False) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of an event log (conv_id, seq, kind, turn, role, text)."""
    empty = F.lit("")
    turn: Column = F.coalesce(F.col("turn"), F.col("seq"))
    rows = log.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), turn.alias("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    order = ["conv_id", "seq", "turn", "kind", "role", "text"]
    placed = rows.repartition("conv_id").sortWithinPartitions(*order)
    return placed.mapInArrow(_numbered_fold if distinct_turns else _fold_batches, FORMATTED)


def _numbered_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As _fold_batches, each row a turn of its own in the sorted order."""

    def numbered() -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            turns = pa.array(range(at, at + batch.num_rows), type=pa.int64())
            at += batch.num_rows
            yield batch.set_column(batch.schema.get_field_index("turn"), "turn", turns)

    return _fold_batches(numbered())


def message_log(conversations: DataFrame) -> DataFrame:
    """A table of whole messages (conv_id, turn, role, text) as a log of ``message`` events."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "turn", "role", "text")


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in READ.split(", ")]
    schema = pa.schema([(n, pa.string() if n.endswith("256") else pa.int64()) for n in names])
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            messages, chars = parse(text), 0
            for role, said in messages:
                turns.update(f"{role}\n{said}\n".encode())
            for span in spans:
                said = unescape(text[span["start"] : span["stop"]])
                loss.update(said.encode())
                chars += len(said)
            rows.append((conv, len(messages), turns.hexdigest(), chars, loss.hexdigest(), len(text)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted texts hold, parsed back from them."""
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_read_batches, READ)


#: The fixed extra conversation of the query op4_chat.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS body FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(role) + 2 + length(body) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
