"""Operator 7: minimax contiguous partition into shards of near equal bytes.

Equal texts are one atomic group; groups stand in the order of their smallest doc_id. The smallest
capacity with which a greedy pass needs no more than `shards` shards is found by binary search. The pass needs
only to know where groups end, so the driver holds a coarse list of ends: exact near the cuts, elsewhere ranges
with several groups in them, whose bounds tell whether a capacity is feasible, infeasible or still open. Open
ranges are split by one job each round, SLICES ways, until the answer is exact. The driver never holds over
about shards * SLICES * rounds numbers.

Defined cases: null texts are empty (size 1) and equal to empty ones; equal rows keep a slot each; rows without
doc_id belong to their text's group, and come last if it has no doc_id; groups that tie are ordered by a digest of their text; a very long text is a group that no
cut divides, so the least capacity is its size at least; an empty table gives no rows; further columns, of any name, are not read.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import parts, table

SHARDS = 8
SLICES = 256
BUCKETS = 64
BUCKET_ROWS = 1 << 18


class Ends:
    """Known ends of groups as running sums; open[i]: whether more ends lie between edges[i] and edges[i + 1]."""

    def __init__(self, total: int):
        self.edges, self.open = [0, total], [True]

    def fits(self, capacity: int, shards: int, touched: set[int] | None = None) -> bool | None:
        """Whether a greedy pass is sure to do (True), sure not to (False), or may do (None)."""
        total = self.edges[-1]
        low = high = 0  # the least and the most that the pass can have dealt out
        for _ in range(shards):
            for p, best in ((low, False), (high, True)):
                i = bisect_right(self.edges, p + capacity) - 1
                if i < len(self.open) and self.open[i] and p + capacity < self.edges[i + 1]:
                    if touched is not None:
                        touched.add(i)
                    q = p + capacity if best else self.edges[i]
                else:
                    q = self.edges[min(i, len(self.open))]
                if best:
                    high = q
                else:
                    low = q
            if low >= total:
                return True
        return False if high < total else None

    def cuts(self, capacity: int, shards: int) -> list[int]:
        p, out = 0, []
        for _ in range(shards - 1):
            p = self.edges[bisect_right(self.edges, p + capacity) - 1]
            out.append(p)
        return out


def capacity_cuts(ends: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """Smallest feasible capacity and the cuts of its greedy pass; ends has a row `upto` for each group."""
    known = Ends(total)
    low, high, wanted = max(largest, -(-total // shards)), total, {0}
    while True:
        refine(known, ends, wanted)
        lo, hi = low, high  # bounds by what is known now
        while lo < hi:
            mid = (lo + hi) // 2
            if known.fits(mid, shards) is True:
                hi = mid
            else:
                lo = mid + 1
        high, lo, hi = lo, low, lo
        while lo < hi:
            mid = (lo + hi) // 2
            if known.fits(mid, shards) is False:
                lo = mid + 1
            else:
                hi = mid
        low = lo
        if low == high:
            wanted = set()
            known.fits(low, shards, wanted)
            if not wanted:
                return low, known.cuts(low, shards)
        else:
            wanted = between(known, low, high, shards)


def between(known: Ends, low: int, high: int, shards: int) -> set[int]:
    """Open ranges in which a cut can lie for any capacity from low to high."""
    out: set[int] = set()
    p = q = 0
    for _ in range(shards):
        i, j = bisect_right(known.edges, p + low) - 1, bisect_right(known.edges, q + high) - 1
        out |= {k for k in range(i, min(j + 1, len(known.open))) if known.open[k]}
        p, q = known.edges[min(i, len(known.open))], min(q + high, known.edges[-1])
    return out


def refine(known: Ends, ends: DataFrame, wanted: set[int]) -> None:
    """Splits the wanted ranges by one job; of each slice it learns the first and the last end."""
    ranges = sorted((known.edges[i], known.edges[i + 1]) for i in wanted)
    spark = ends.sparkSession
    small = spark.createDataFrame([(a, b, max(1, -(-(b - a) // SLICES))) for a, b in ranges], "a long, b long, w long")
    slices = (
        ends.join(F.broadcast(small), (F.col("upto") > F.col("a")) & (F.col("upto") <= F.col("b")))
        .groupBy("a", F.expr("(upto - a - 1) div w").alias("slice"))
        .agg(F.min("upto").alias("lo"), F.max("upto").alias("hi"), F.count(F.lit(1)).alias("c"))
    )
    inside: dict[int, list] = {}
    for r in slices.collect():
        inside.setdefault(r["a"], []).append((r["slice"], r["lo"], r["hi"], r["c"]))
    edges, opened = [known.edges[0]], []
    for i, is_open in enumerate(known.open):
        if i in wanted:
            for _, lo, hi, c in sorted(inside.get(known.edges[i], [])):
                edges.append(lo)
                opened.append(False)
                if hi > lo:
                    edges.append(hi)
                    opened.append(c > 2)
        else:
            edges.append(known.edges[i + 1])
            opened.append(is_open)
    known.edges, known.open = edges, opened


def running(groups: DataFrame) -> tuple[DataFrame, int, int]:
    """groups (gid, first, bytes) in order, with `upto`, the bytes up to each group's end; their sum and the largest."""

    def add(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for pdf in batches:
            upto = pdf["bytes"].cumsum() + total
            total = int(upto.iloc[-1]) if len(pdf) else total
            yield pd.DataFrame({"gid": pdf["gid"], "part": part, "bytes": pdf["bytes"], "upto": upto})

    spark = groups.sparkSession
    order = [F.col("first").asc_nulls_last(), F.col("gid")]
    local = groups.repartitionByRange(parts(spark), *order).sortWithinPartitions(*order)
    local = table(local.select("gid", "bytes").mapInPandas(add, "gid binary, part int, bytes long, upto long"))
    sums = {r["part"]: (r["s"], r["m"]) for r in local.groupBy("part").agg(F.sum("bytes").alias("s"), F.max("bytes").alias("m")).collect()}
    before, total = [], 0
    for p in sorted(sums):  # one number for each partition
        before.append((p, total))
        total += sums[p][0]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    return local.join(offsets, "part").select("gid", (F.col("upto") + F.col("before")).alias("upto")), total, max((m for _, m in sums.values()), default=0)


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce("text", F.lit(""))
    each = table(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("gid"),
    ))
    groups = each.groupBy("gid").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    ends, total, largest = running(groups)
    cuts = capacity_cuts(ends, total, largest, shards)[1] if total else []
    which = sum(((F.col("upto") > c).cast("int") for c in cuts), F.lit(0))
    placed = each.join(ends.select("gid", which.alias("shard")), "gid").drop("gid")
    buckets = max(BUCKETS, each.count() // BUCKET_ROWS)
    placed = table(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))))
    return slotted(placed)


def slotted(placed: DataFrame) -> DataFrame:
    """Adds gapless slots: a row number within a shard's hash bucket, plus the sizes of the buckets before."""
    sizes = placed.groupBy("shard", "bucket").count()
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    out = placed.withColumn("number", number).join(sizes, ["shard", "bucket"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("number") - 1 + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
