"""Operator 8: chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, its text alone under the loss
mask. Turns after the last assistant turn (or all, if there is none) make one more example without a target, so
nothing is lost. A turn is `<s>[INST] text [/INST]` for the user, `<s>text</s>` for the assistant, `<s>[SYS] text [/SYS]` for
the system, `<s>[TURN role] text [/TURN]` for any other role. Inside texts and roles `\\`, `<`, `[` and `]` are escaped as
`\\\\`, `\\l`, `\\b` and `\\e`, so no text can hold a control string, and unescaping gives it back.

An example's context is as long as the conversation before it: that is the method. It is streamed: a task holds the prefix
of one conversation, and conversations are sorted, not collected.

Defined cases: a null text is empty, a null role is the role ``; rows of a conversation are taken by turn (null
turns last), then role, then text, and repeated rows are repeated turns; a row without conv_id is a
conversation of one turn, so such rows never meet; a very long conversation is formatted like any other, its prefix held once; an empty table gives no
examples; further columns, of any name, are not read.
"""

from __future__ import annotations

import hashlib
import re
from itertools import count, groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import parts, small_batches

ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\e"}
BACK = {v: k for k, v in ESCAPES.items()}
_SPECIAL, _ESCAPED = re.compile(r"[\\<\[\]]"), re.compile(r"\\[\\lbe]")
_TURN = re.compile(r"<s>(?:\[INST\] (?P<user>[^<\[\]]*) \[/INST\]|\[SYS\] (?P<system>[^<\[\]]*) \[/SYS\]|\[TURN (?P<role>[^<\[\]]*)\] (?P<other>[^<\[\]]*) \[/TURN\]|(?P<assistant>[^<\[\]]*)</s>)")

EXAMPLE = "conv_id long, example int, text string, loss_start int, loss_end int"


def escape(text: str) -> str:
    return _SPECIAL.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: BACK[m[0]], text)


def marked(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text lies."""
    before, after = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<s>[SYS] ", " [/SYS]")}.get(role) or (f"<s>[TURN {escape(role)}] ", " [/TURN]")
    body = escape(text)
    return before + body + after, len(before), len(before) + len(body)


def expanded(turns):
    """Examples (text, loss_start, loss_end) of one conversation's (role, text) turns."""
    prefix, open_turns = "", False
    for role, text in turns:
        turn, a, b = marked(role, text)
        at, prefix, open_turns = len(prefix), prefix + turn, role != "assistant"
        if role == "assistant":
            yield prefix, at + a, at + b
    if open_turns:
        yield prefix, 0, 0


def turns_of(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted example."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        kind = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if kind == "other" else (kind, unescape(m[kind])))
        at = m.end()
    return out


def _by_conversation(conversations: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted within, rows without one spread; columns conv_id (as a string), role, text."""
    df = conversations.select("conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    small_batches(df.sparkSession)
    df = df.repartition(parts(df.sparkSession), F.coalesce(F.col("conv_id").cast("long"), F.xxhash64("turn", "role", "text")))
    df = df.sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_last(), "role", "text")
    return df.select(F.col("conv_id").cast("string").alias("conv_id"), "role", "text")


def _conversations(batches):
    """(conv_id, iterator of turns), across batches; a row without conv_id comes alone."""
    rows = (row for pdf in batches for row in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True))
    alone = count()
    return ((key[0], turns) for key, turns in groupby(rows, key=lambda r: (r[0], next(alone) if r[0] is None else None)))


def _frame(rows, columns):
    pdf = pd.DataFrame(rows, columns=columns)
    pdf["conv_id"] = pdf["conv_id"].astype("Int64")
    return pdf


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each example: conv_id, example, text, loss_start, loss_end (code points)."""

    def run(batches):
        columns = ["conv_id", "example", "text", "loss_start", "loss_end"]
        rows, size = [], 0
        for conv, turns in _conversations(batches):
            for i, (text, a, b) in enumerate(expanded((r, t) for _, r, t in turns)):
                rows.append((conv, i, text, a, b))
                size += len(text)
                if size > 4_000_000:
                    yield _frame(rows, columns)
                    rows, size = [], 0
        yield _frame(rows, columns)

    return _by_conversation(conversations).mapInPandas(run, EXAMPLE)


def digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the examples.

    The turns are those of the last example, which holds the whole conversation; formatted_chars sums all examples.
    """

    def run(batches):
        columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        rows = []
        for conv, turns in _conversations(batches):
            loss, loss_chars, chars, text = hashlib.sha256(), 0, 0, ""
            for text, a, b in expanded((r, t) for _, r, t in turns):
                part = unescape(text[a:b])
                loss.update(part.encode())
                loss_chars += len(part)
                chars += len(text)
            back = turns_of(text)
            every = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in back).encode()).hexdigest()
            rows.append((conv, len(back), every, loss_chars, loss.hexdigest(), chars))
            if len(rows) >= 5000:
                yield _frame(rows, columns)
                rows = []
        yield _frame(rows, columns)

    return _by_conversation(conversations).mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The same rows in DuckDB SQL, with the extra conversation -7.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
m AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<\[\]]', '', 'g')) + CASE role
    WHEN 'user' THEN 18 WHEN 'assistant' THEN 7 WHEN 'system' THEN 16
    ELSE 19 + length(role) + length(regexp_replace(role, '[^\\<\[\]]', '', 'g')) END AS chars
  FROM c),
p AS (
  SELECT *, sum(chars) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id, alone) AS n
  FROM m WINDOW w AS (PARTITION BY conv_id, alone ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id, alone
"""
