"""Operator 1: line dedup over three-line windows.

Texts are split at \\n. Every three consecutive lines make a window, known by a 128-bit hash of its text; of windows
equal across the corpus all but the first (smallest doc_id, then smallest line) are later occurrences, and the lines
they cover, merged, are removed. Windows without a word are no passages and are left alone.

A window that many rows share reaches the shuffle once a batch: later ones of a batch are settled there.

Defined cases: null and empty texts are one empty line and stay empty; an empty table gives no rows; texts of under three lines lose nothing; a very long text is
cut in lines and given on in pieces, and windows that repeat are found in any of them; rows without doc_id take no part and are kept whole; rows that share a
doc_id are ordered by a hash of their text; doc_ids may be negative or large; equal rows give equal results; further columns, of any name, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import lean, small_batches, table
from hearthline.llm.repeats import in_order, merged, numbered, sha, touched, with_results

WINDOW = 3
#: Windows that a task holds before it gives them on, and windows of a batch among which it looks for those that come again.
HELD_ROWS = 100_000
SEEN = 500_000


def windows(docs: DataFrame, window: int) -> DataFrame:
    """(h1, h2, doc_id, row, start) of each window that has a word; one that came before in its batch has no hashes."""

    def find(batches):
        for batch in batches:
            seen, rows = set(), []
            for doc, row, text in in_order(batch):
                lines = text.encode().split(b"\n")
                filled = [bool(x.split()) for x in lines]
                for i in range(len(lines) - window + 1):
                    if any(filled[i : i + window]):
                        h = xxhash.xxh3_128_digest(b"\n".join(lines[i : i + window]))
                        rows.append((None if h in seen else h, doc, row, i))
                        if len(seen) < SEEN:
                            seen.add(h)
                    if len(rows) >= HELD_ROWS:
                        yield made(rows)
                        rows = []
            yield made(rows)

    def made(rows):
        h = np.frombuffer(b"".join(r[0] or bytes(16) for r in rows), "<i8").reshape(-1, 2)
        none = np.array([r[0] is None for r in rows], bool)
        numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2)]
        return pa.RecordBatch.from_arrays([*(pa.array(h[:, i].copy(), mask=none) for i in (0, 1)), *numbers, pa.array([r[3] for r in rows], pa.int32())], names=["h1", "h2", "doc_id", "row", "start"])

    small_batches(docs.sparkSession)
    return docs.where("doc_id IS NOT NULL").select("doc_id", "row", "text").mapInArrow(lean(find), "h1 long, h2 long, doc_id long, row long, start int")


def removals(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Ranges of lines to remove, (doc_id, row, a, b). Hot windows come once a batch; the aggregate combines them before its shuffle."""
    each = table(windows(docs, window))
    open_windows = each.where("h1 IS NOT NULL")
    first = open_windows.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "start")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    again = open_windows.join(first, ["h1", "h2"]).where("first < struct(doc_id, row, start)")
    later = again.select("doc_id", "row", "start").union(each.where("h1 IS NULL").select("doc_id", "row", "start"))
    return later.selectExpr("doc_id", "row", "CAST(start AS LONG) AS a", f"CAST(start + {window} AS LONG) AS b")


def kept_lines(lines: list, ranges) -> tuple[list, int]:
    spans = merged(ranges, len(lines))
    edges = [0, *(x for s in spans for x in s), len(lines)]
    return [x for a, b in zip(edges[::2], edges[1::2], strict=True) for x in lines[a:b]], sum(b - a for a, b in spans)


def dedup(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """The texts that lose lines: doc_id, row, text, n_words (kept), n_removed."""
    docs = numbered(documents)

    def cut(batches):
        for pdf in batches:
            done = [kept_lines(t.split("\n"), r) for t, r in zip(pdf["text"], pdf["ranges"], strict=True)]
            texts = ["\n".join(x) for x, _ in done]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "text": texts, "n_words": [len(t.encode().split()) for t in texts], "n_removed": [n for _, n in done]})

    return touched(docs, lambda: removals(docs, window)).mapInPandas(lean(cut), "doc_id long, row long, text string, n_words long, n_removed long")


def digest(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (kept lines joined by \\n, UTF-8) of every row."""
    docs = numbered(documents)

    def cut(batches):
        for pdf in batches:
            done = [(n, sha("\n".join(x).encode())) for x, n in (kept_lines(t.split("\n"), r) for t, r in zip(pdf["text"], pdf["ranges"], strict=True))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "n_removed": [n for n, _ in done], "kept": [x for _, x in done]})

    lines = F.length("text") - F.length(F.translate("text", "\n", "")) + 1
    every = docs.select("doc_id", "row", lines.cast("long").alias("n_lines"), F.sha2("text", 256).alias("whole"))
    some = touched(docs, lambda: removals(docs, window)).mapInPandas(lean(cut), "doc_id long, row long, n_removed long, kept string")
    return with_results(every, some).select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))


#: The same rows in DuckDB SQL, for tables in which doc_id is unique.
ORACLE = r"""
WITH l AS (
  SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
w AS (SELECT doc_id, i, array_to_string(lines[i:i+2], chr(10)) AS win FROM l WHERE i + 2 <= len(lines)),
later AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(win, '[^\x20\x09-\x0D]')) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS i FROM later)
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(g.i) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(l.lines[l.i], chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
"""
