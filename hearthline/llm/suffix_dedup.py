"""Operator 9: suffix-array dedup of 100-byte strings.

A suffix for each byte cannot be dealt out within the disk that is allowed (a row of 20 bytes a byte of text is 20 times the input), so suffixes
travel in runs: consecutive start bytes whose first 100 bytes have one anchor (the place of the least hash of a 20-byte gram),
known by the suffix that starts at the anchor. Three passes sort them, deeper each time, and only what is still tied goes on:

1. Anchored suffixes are dealt by their leading 16 bytes, as two numbers, into ranges between sampled splitters, and sorted there. A suffix without a neighbour of the
   same 16 bytes is alone: none of its run's strings occurs elsewhere.
2. Runs that are tied travel with their bytes, range-partitioned by leading bytes and doc_id between splitters sampled from them. A bucket sorts
   whole runs and then all their suffixes, to a depth of 100 bytes, by multikey quicksort of eight-byte characters; equal neighbours
   are repeats. Splitters may fall among suffixes with equal leading bytes, so a very frequent one is shared by several buckets.
3. What is left of a bucket's first and last leading bytes, and of leading bytes with too many different runs for one task, goes on one suffix at
   a time and is sorted by its own 100 bytes across the cluster: this compares neighbours across the boundaries of buckets.

Defined cases: null texts are empty; an empty table gives no rows; texts of under 100 bytes lose nothing; a very long text goes in pieces of 2^20 suffixes, and
a string that repeats is found in any of them; rows without doc_id take no part and are kept whole; rows that share a doc_id are ordered by a hash of their text;
doc_ids may be negative or large; equal rows give equal results; further columns, of any name, are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import BYTES, Powers, lean, maybe_in, parts, small_batches, table
from hearthline.llm.repeats import Bucket, Bytes, groups, in_buckets, in_order, merged, numbered, piecewise, ranges_of, repeated, sha, single_windows, touched, with_results

LENGTH = 100
GRAM = 20
#: Documents and tied runs that are sampled for splitters, about. Only the balance of partitions depends on them.
SAMPLE = 4000
RUN_SAMPLE = 200_000
#: Rows that a task holds and sorts before it gives them on.
HELD_ROWS = 200_000

_SIGN = np.uint64(1 << 63)


def leading(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a signed number that sorts as they do."""
    return (data[at[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64) ^ _SIGN).view(np.int64)


def anchored(docs: DataFrame, length: int, gram: int, splitters: list[int] | None = None) -> DataFrame:
    """Runs of suffixes: range, k1 and k2 (leading bytes at the anchor), doc_id, row, a, b (end of the last string), alone.

    `alone` tells that the run's strings may repeat within it, as its anchor's gram occurs in it twice. A task sorts
    what it holds by leading bytes, then by all bytes; runs that equal an earlier one of the sort are settled and have no k2.
    """

    def find(batches):
        powers = Powers()
        for batch in batches:
            out, texts, size = [], [], 0
            for doc, row, text in in_order(batch):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                for at, mini, start, n, grams in piecewise(len(data), lambda a, b, data=data: BYTES[data[a:b]], length, gram, powers):
                    span = np.arange(length - gram + int(n.max()))
                    here = grams[np.minimum(start[:, None] + span, len(grams) - 1)] == mini[:, None]
                    here &= span < (n + length - gram)[:, None]
                    anchor = at + start + here.argmax(axis=1)
                    start = at + start
                    end = start + n + length - 1
                    k1, k2 = leading(data, anchor), leading(data, anchor + 8)
                    out.append((k1, k2, np.full(len(n), doc), np.full(len(n), row), start, end, here.sum(axis=1) > 1, np.full(len(n), len(texts))))
                    texts.append(raw)
                    size += len(n)
                    if size > HELD_ROWS:
                        yield rows(out, texts)
                        out, texts, size = [], [], 0
            if out:
                yield rows(out, texts)

    def rows(out, texts):
        k1, k2, doc, row, a, b, alone, of = (np.concatenate(x) for x in zip(*out, strict=True))
        settled = repeated([k1, k2], doc, row, a, lambda i: texts[of[i]][a[i] : b[i]], False)
        which = np.searchsorted(np.array(splitters or [], np.int64), k1, "right")
        columns = [pa.array(which, pa.int32()), pa.array(k1), pa.array(k2, mask=settled), pa.array(doc), pa.array(row), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(alone)]
        return pa.RecordBatch.from_arrays(columns, names=["range", "k1", "k2", "doc_id", "row", "a", "b", "alone"])

    small_batches(docs.sparkSession)
    return docs.where("doc_id IS NOT NULL").select("doc_id", "row", "text").mapInArrow(lean(find), "range int, k1 long, k2 long, doc_id long, row long, a int, b int, alone boolean")


def sampled_splitters(docs: DataFrame, length: int, gram: int, ranges: int) -> list[int]:
    """Leading bytes that cut the suffixes of a sample into ranges of like size."""
    rows = docs.count()
    some = docs.sample(min(1.0, SAMPLE / max(rows, 1)), seed=9) if rows > SAMPLE else docs
    cuts = anchored(some, length, gram).agg(F.percentile_approx("k1", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] if ranges > 1 else None
    return sorted(set(cuts or []))


def run_splitters(runs: DataFrame, ranges: int) -> list[tuple[int, int, int]]:
    """(k1, k2, doc_id) that cut a sample of the tied runs into ranges of like size."""
    rows = runs.count()
    some = runs.sample(min(1.0, RUN_SAMPLE / max(rows, 1)), seed=9) if rows > RUN_SAMPLE else runs
    order = sorted(map(tuple, some.select("k1", "k2", "doc_id").collect()))
    return sorted({order[len(order) * i // ranges] for i in range(1, ranges)}) if order else []


def tied(dealt: DataFrame) -> DataFrame:
    """Of rows sorted by k1 and k2 within their partition, those with an equal neighbour, those that may repeat within themselves and the settled ones."""

    def run(batches):
        names = ["k1", "k2", "doc_id", "row", "a", "b", "alone"]
        settled = []

        def open_rows():
            for batch in batches:
                mask = batch.column("k2").is_null()
                settled.append(batch.filter(mask))
                batch = batch.filter(pc.invert(mask))
                if batch.num_rows:
                    yield batch

        def flush():
            while settled:
                yield settled.pop().select(names)

        for t, _ in groups(open_rows(), 1 << 20):
            yield from flush()
            yield from t.select(names).to_batches()
        yield from flush()

    return dealt.mapInArrow(lean(run), "k1 long, k2 long, doc_id long, row long, a int, b int, alone boolean")


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Ranges of bytes to remove, (doc_id, row, a, b), for docs (doc_id, row, text)."""
    n = parts(docs.sparkSession)
    splitters = sampled_splitters(docs, length, gram, n)
    ranges = F.when(F.col("k2").isNull(), F.pmod(F.xxhash64("row", "a"), F.lit(n)).cast("int")).otherwise(F.col("range"))
    dealt = anchored(docs, length, gram, splitters).withColumn("range", ranges).repartitionById(n, "range").sortWithinPartitions("k1", "k2").drop("range")
    left = table(tied(dealt))

    open_runs = left.where("k2 IS NOT NULL")
    cuts = run_splitters(open_runs, n)
    wanted = open_runs.groupBy("doc_id", "row").agg(F.collect_set(F.struct("k1", "k2", "a", "b", "alone")).alias("runs"))
    texts = maybe_in(docs.where("doc_id IS NOT NULL").select("doc_id", "row", "text"), open_runs, "row").join(wanted, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])

    def packed(batches):
        for pdf in batches:
            rows = []
            for doc, row, text, runs in zip(pdf["doc_id"], pdf["row"], pdf["text"], pdf["runs"], strict=True):
                data = text.encode()
                rows += [(bisect_right(cuts, (r["k1"], r["k2"], doc)), r["k1"], r["k2"], doc, row, r["a"], r["b"], r["alone"], data[r["a"] : r["b"]]) for r in runs]
                if len(rows) >= HELD_ROWS // 4:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    def frame(rows):
        return pd.DataFrame(rows, columns=["range", "k1", "k2", "doc_id", "row", "a", "b", "alone", "part"])

    sent = texts.mapInPandas(lean(packed), "range int, k1 long, k2 long, doc_id long, row long, a long, b long, alone boolean, part binary")
    buckets = sent.repartitionById(n, "range").sortWithinPartitions("k1", "k2")
    out = table(in_buckets(buckets, Bucket(Bytes, length, False), edges=True))
    settled = left.where("k2 IS NULL").select("doc_id", "row", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return ranges_of(out).union(single_windows(out, False, n)).union(settled)


def kept_bytes(data: bytes, ranges) -> tuple[bytes, int, int]:
    spans = merged(ranges, len(data))
    edges = [0, *(x for s in spans for x in s), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)), sum(b - a for a, b in spans), len(spans)


def dedup(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The texts that lose bytes: doc_id, row, kept (bytes; a character may be cut), n_removed, n_spans."""
    docs = numbered(documents)

    def cut(batches):
        for pdf in batches:
            done = [kept_bytes(t.encode(), r) for t, r in zip(pdf["text"], pdf["ranges"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "kept": [x[0] for x in done], "n_removed": [x[1] for x in done], "n_spans": [x[2] for x in done]})

    return touched(docs, lambda: removals(docs, length, gram)).mapInPandas(lean(cut), "doc_id long, row long, kept binary, n_removed long, n_spans long")


def digest(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    docs = numbered(documents)

    def cut(batches):
        for pdf in batches:
            done = [(n, spans, sha(kept)) for kept, n, spans in (kept_bytes(t.encode(), r) for t, r in zip(pdf["text"], pdf["ranges"], strict=True))]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "row": pdf["row"], "n_removed": [x[0] for x in done], "n_spans": [x[1] for x in done], "kept": [x[2] for x in done]})

    every = docs.select("doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    some = touched(docs, lambda: removals(docs, length, gram)).mapInPandas(lean(cut), "doc_id long, row long, n_removed long, n_spans long, kept string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return with_results(every, some).select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
