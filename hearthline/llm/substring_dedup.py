"""Operator 10: substring dedup by super-k-mers.

Consecutive 50-word windows that share a minimiser (the least hash of an 8-word gram) form a run, a super-k-mer, which travels as one packed string to
its minimiser's bucket, unless no document of another doc_id has that minimiser: minimisers travel first, as bare numbers. There the minimiser's strings are sorted, then the windows of those that differ, word by word; a window
goes if an equal one stands in a document with a smaller doc_id. A minimiser with too many different strings for one bucket has its windows sorted one
by one across the cluster.

Defined cases: null or empty texts have no words and stay empty; texts of under 50 words are kept whole; an empty table gives no rows; a very long text goes in
pieces of 2^20 words, and a window that repeats is found in any of them; rows without doc_id take no part and are kept whole; of rows that share a doc_id
none removes words of the other; doc_ids may be negative or large; equal rows give equal results; further columns, of any name, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import Powers, lean, maybe_in, parts, small_batches, table, word_hashes, word_spans
from hearthline.llm.repeats import Bucket, Words, in_buckets, in_order, merged, numbered, piecewise, ranges_of, repeated, sha, single_windows, touched, with_results

WINDOW = 50
GRAM = 8
#: Bytes of packed strings that a task holds and sorts before it gives them on.
HELD_BYTES = 8 << 20


def runs_of(text: str, window: int, gram: int, powers: Powers):
    """The text's words joined by one space, where words begin and end, and its runs: arrays (minimiser, first word, windows) a piece."""
    joined = b" ".join(text.encode().split())
    data = np.frombuffer(joined, np.uint8)
    begin, end = word_spans(data)
    hashes = lambda a, b: word_hashes(data, begin[a:b], end[a:b], powers)
    return joined, begin, end, ((mini.view(np.int64), start + at, n) for at, mini, start, n, _ in piecewise(len(begin), hashes, window, gram, powers))


def minimisers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """k1, doc_id, row of each text's minimisers."""

    def find(batches):
        powers = Powers()
        for batch in batches:
            for doc, row, text in in_order(batch):
                for mini, _, _ in runs_of(text, window, gram, powers)[3]:
                    k = np.unique(mini)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (k, np.full(len(k), doc), np.full(len(k), row))], names=["k1", "doc_id", "row"])

    return docs.mapInArrow(lean(find), "k1 long, doc_id long, row long")


def shared_minimisers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Rows (doc_id, row) with those of their minimisers, keys, that a document of another doc_id has too.

    Equal windows have one minimiser, so no window of another run can repeat. Keys are counted by an aggregate that combines before its shuffle; a hot
    one is a row a task there, and its rows in the join that follows are bare numbers, which skew splitting deals out.
    """
    each = table(minimisers(docs, window, gram))
    shared = each.groupBy("k1").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("k1")
    return each.join(shared, "k1", "left_semi").groupBy("doc_id", "row").agg(F.collect_set("k1").alias("keys"))


def super_kmers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Packed runs of docs (doc_id, row, text, keys) whose minimiser is among keys: k1 (minimiser), doc_id, row, a (first word), b (end of the last window), part.

    Those that equal an earlier one of their sort have no part.
    """

    def find(batches):
        powers = Powers()
        for batch in batches:
            rows, size = [], 0
            wanted = {(d, r): i for i, (d, r) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))}
            for doc, row, text in in_order(batch):
                keys = batch.column(3)[wanted[doc, row]].values.to_numpy()
                joined, begin, end, runs = runs_of(text, window, gram, powers)
                for mini, start, n in runs:
                    some = np.isin(mini, keys)
                    if not some.any():
                        continue
                    a, b = start[some], start[some] + n[some] + window - 1
                    lo, hi = begin[a], end[b - 1]
                    parts = [joined[lo:hi] for lo, hi in zip(lo.tolist(), hi.tolist(), strict=True)]
                    rows.append((mini[some], np.full(len(a), doc), np.full(len(a), row), a, b, parts))
                    size += int((hi - lo).sum())
                    if size > HELD_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
            if rows:
                yield packed(rows)

    def packed(rows):
        k, doc, row, a, b = (np.concatenate([r[i] for r in rows]) for i in range(5))
        part = [p for r in rows for p in r[5]]
        settled = repeated([k], doc, row, a, part.__getitem__, True)
        for i in np.flatnonzero(settled).tolist():
            part[i] = None
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (k, doc, row)), *(pa.array(x, pa.int32()) for x in (a, b)), pa.array(part, pa.binary())], names=["k1", "doc_id", "row", "a", "b", "part"])

    return docs.select("doc_id", "row", "text", "keys").mapInArrow(lean(find), "k1 long, doc_id long, row long, a int, b int, part binary")


def removals(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Ranges of words to remove, (doc_id, row, a, b), for docs (doc_id, row, text)."""
    n = parts(docs.sparkSession)
    small_batches(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "row", "text")
    some = table(shared_minimisers(docs, window, gram))
    meeting = maybe_in(docs, some, "row").join(some, ["doc_id", "row"])
    settled = F.when(F.col("part").isNull(), F.xxhash64("row", "a")).otherwise(F.col("k1"))
    dealt = super_kmers(meeting, window, gram).withColumn("k1", settled).repartition(n, "k1").sortWithinPartitions("k1")
    dealt = dealt.select("k1", F.lit(0).cast("long").alias("k2"), "doc_id", "row", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.lit(False).alias("alone"), "part")
    out = table(in_buckets(dealt, Bucket(Words, window, True)))
    return ranges_of(out).union(single_windows(out, True, n))


def kept_words(words: list[bytes], ranges) -> tuple[list[bytes], int]:
    out, at, gone = [], 0, 0
    for a, b in merged(ranges, len(words)):
        out += words[at:a]
        at = b
        gone += b - a
    return out + words[at:], gone


def dedup(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The texts that lose words: doc_id, row, text (kept words joined by one space), n_words (kept), n_removed."""
    docs = numbered(documents)

    def cut(batches):
        for pdf in batches:
            done = [kept_words(t.encode().split(), r) for t, r in zip(pdf["text"], pdf["ranges"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "text": [b" ".join(w).decode() for w, _ in done], "n_words": [len(w) for w, _ in done], "n_removed": [n for _, n in done]})

    return touched(docs, lambda: removals(docs, window, gram)).mapInPandas(lean(cut), "doc_id long, row long, text string, n_words long, n_removed long")


def digest(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    docs = numbered(documents)

    def base(batches):
        for pdf in batches:
            rows = [(len(w), sha(b" ".join(w))) for w in (t.encode().split() for t in pdf["text"])]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "row": pdf["row"], "n_words": [n for n, _ in rows], "whole": [x for _, x in rows]})

    def cut(batches):
        for pdf in batches:
            done = [(n, sha(b" ".join(w))) for w, n in (kept_words(t.encode().split(), r) for t, r in zip(pdf["text"], pdf["ranges"], strict=True))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "n_removed": [n for n, _ in done], "kept": [x for _, x in done]})

    every = docs.mapInPandas(lean(base), "doc_id long, row long, n_words long, whole string")
    some = touched(docs, lambda: removals(docs, window, gram)).mapInPandas(lean(cut), "doc_id long, row long, n_removed long, kept string")
    return with_results(every, some).select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept_sha256"))
