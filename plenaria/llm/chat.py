"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation::

    conversation := turn*
    turn         := "### " role ":" NL body "</turn>" NL
    role, body   := characters; "\\" takes the next character literally

Inside a body an unescaped ``### `` or ``</turn>`` is a control string, wherever it stands: the parser
refuses the first and ends the turn at the second, behind which a line feed has to follow. A
conversation is first rendered without any escapes, then parsed back; every turn that does not come
back as it was (each one that holds a backslash or a control string) gets its backslashes and control
strings escaped, and the text is rendered and parsed again until the turns are identical to the source.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, LEARNED = "### ", "</turn>", "assistant"
_BODY = re.compile(r"\\.|### |</turn>", re.S)
_ROLE = re.compile(r"\\.|:\n", re.S)
_CONFLICT = re.compile(r"\\|### |</turn>")
_ROLE_CONFLICT = re.compile(r"[\\:\n]")
_UNESCAPE = re.compile(r"\\(.)", re.S)


def _escape(text: str, rule: re.Pattern) -> str:
    return rule.sub(lambda m: "\\" + m[0], text)


def _unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def _turn(role: str, text: str, escaped: bool) -> str:
    if escaped:
        role, text = _escape(role, _ROLE_CONFLICT), _escape(text, _CONFLICT)
    return f"{OPEN}{role}:\n{text}{CLOSE}\n"


def parse(formatted: str) -> list[tuple[str, int, int]] | None:
    """(role, start, end) of each turn, the body's bounds being code points of ``formatted``; None
    if the text is not of the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            return None
        start = at + len(OPEN)
        role_end = next((m.start() for m in _ROLE.finditer(formatted, start) if m[0] == ":\n"), -1)
        if role_end < 0:
            return None
        body = role_end + 2
        stop = next((m for m in _BODY.finditer(formatted, body) if m[0][0] != "\\"), None)
        if stop is None or stop[0] == OPEN or not formatted.startswith("\n", stop.end()):
            return None
        turns.append((_unescape(formatted[start:role_end]), body, stop.start()))
        at = stop.end() + 1
    return turns


def recover(formatted: str) -> list[tuple[str, str]] | None:
    """The turns that ``formatted`` says; None if it is not of the grammar."""
    turns = parse(formatted)
    return None if turns is None else [(role, _unescape(formatted[a:b])) for role, a, b in turns]


def format_turns(turns: list[tuple[str, str]]) -> str:
    """Render ``turns``, escaping those that do not survive the round trip."""
    escaped = [False] * len(turns)
    while True:
        formatted = "".join(_turn(r, t, e) for (r, t), e in zip(turns, escaped, strict=True))
        if recover(formatted) == turns:
            return formatted
        if all(escaped):
            raise AssertionError("an escaped conversation did not survive its round trip")
        alone = [e or recover(_turn(r, t, False)) != [(r, t)] for (r, t), e in zip(turns, escaped, strict=True)]
        escaped = alone if alone != escaped else [True] * len(turns)


FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        (
            "spans",
            pa.list_(pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("loss", pa.bool_())])),
        ),
    ]
)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = [], []
        for turns in batch.column("turns").to_pylist():
            formatted = format_turns([(t["role"] or "", t["text"] or "") for t in turns])
            texts.append(formatted)
            spans.append([{"role": r, "start": a, "end": b, "loss": r == LEARNED} for r, a, b in parse(formatted)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(texts, pa.string()), pa.array(spans, FORMATTED.field("spans").type)],
            schema=FORMATTED,
        )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and ``spans`` (role, start, end, loss).

    Turns stand in the order of (turn, role, text), nulls first; repeated rows are turns of their
    own. A null text or role is an empty one, a null conv_id is a conversation like others, an
    empty table gives no rows. Other columns of the input are not used.
    """
    return (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .mapInArrow(
            _format, "conv_id long, formatted string, spans array<struct<role:string,start:long,end:long,loss:boolean>>"
        )
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for formatted, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            turns = recover(formatted)
            learned = "".join(_unescape(formatted[s["start"] : s["end"]]) for s in spans if s["loss"])
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append(
                {
                    "n_turns": len(turns),
                    "turns_sha256": hashlib.sha256(said.encode()).hexdigest(),
                    "loss_chars": len(learned),
                    "loss_sha256": hashlib.sha256(learned.encode()).hexdigest(),
                    "formatted_chars": len(formatted),
                }
            )
        found = pa.RecordBatch.from_pylist(rows, DIGESTS)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *found.columns], ["conv_id", *DIGESTS.names])


DIGESTS = pa.schema(
    [
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)


ADVERSARIAL = r"\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, read back from their formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", ADVERSARIAL), (-7, 1, "assistant", ADVERSARIAL)],
        "conv_id long, turn long, role string, text string",
    )
    return format_conversations(rows.unionByName(extra)).mapInArrow(
        _digest,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
), sized AS (
  SELECT *, length(t) - length(replace(t, '\', '')) + (length(t) - length(replace(t, '### ', ''))) // 4
    + (length(t) - length(replace(t, '</turn>', ''))) // 7 AS marks FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN r = 'assistant' THEN t ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST), '')) AS loss_sha256,
  CAST(sum(14 + length(r) + length(t) + marks) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
