"""Functions of two builds matched where names are gone: colour refinement on call graphs."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.operators.graph import checkpoints


#: Edges for each shuffle partition, about, which bounds what a task sorts or sums up whatever the graph's size.
EDGES_A_TASK = 100_000


@contextmanager
def dealt(spark, edges: int):
    """Shuffles that are run inside have a partition for each EDGES_A_TASK edges, if that is more than there would be; adaptive execution joins small ones."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(int(before), -(-edges // EDGES_A_TASK))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _sums(side: str) -> list:
    """Sums of two hashes of the neighbours' colours, in halves of 32 bits so that no sum overflows: the same for every order of neighbours."""
    out = []
    for i in (1, 2):
        h = F.xxhash64(F.lit(i), F.col("colour"))
        out += [F.sum(F.when(F.col("side") == side, F.shiftrightunsigned(h, 32))).alias(f"{side}{i}a"), F.sum(F.when(F.col("side") == side, h.bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"{side}{i}b")]
    return out


def refined(nodes: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(build, id, colour): nodes (build, id, label) get one colour where labels and, step by step, the colours of callers and callees agree.

    Labels are null where names are gone. Edges (build, src, dst) count once, those with an end that is no node not at all. Colours are 128-bit
    digests; neighbours are summed up before the shuffle, so a function that all others call costs a row a task. Ends when a round tells
    no more colours apart, or after `rounds`, after which nodes of one colour look alike up to that distance.
    """
    with dealt(nodes.sparkSession, edges.count()):
        return _refined(nodes, edges, rounds)


def _refined(nodes: DataFrame, edges: DataFrame, rounds: int | None) -> DataFrame:
    checkpoints(nodes.sparkSession)
    nodes = nodes.dropDuplicates(["build", "id"])
    start = F.md5(F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("?")))
    colours = nodes.select("build", "id", start.alias("colour")).checkpoint()
    edges = edges.select("build", "src", "dst").distinct().checkpoint()
    known, done = colours.select("colour").distinct().count(), 0
    while rounds is None or done < rounds:
        callees = edges.join(colours.withColumnRenamed("id", "dst"), ["build", "dst"]).select("build", F.col("src").alias("id"), "colour", F.lit("out").alias("side"))
        callers = edges.join(colours.withColumnRenamed("id", "src"), ["build", "src"]).select("build", F.col("dst").alias("id"), "colour", F.lit("in").alias("side"))
        sums = [*_sums("out"), *_sums("in")]
        near = callees.union(callers).groupBy("build", "id").agg(*sums)
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in near.columns[2:]]
        new = colours.join(near, ["build", "id"], "left").select("build", "id", F.md5(F.concat_ws(",", "colour", *parts)).alias("colour")).checkpoint()
        colours, done, before = new, done + 1, known
        known = colours.select("colour").distinct().count()
        if known == before:
            break
    return colours


def matched(colours: DataFrame, a: str, b: str) -> DataFrame:
    """(id, n_a, n_b, match) for each node of build a: how many nodes of both builds have its colour, and the other build's node where
    both numbers are one. Ties stay ties (match is null, both numbers are there); n_b is 0 for functions without a counterpart."""
    sides = colours.groupBy("colour").agg(
        F.count_if(F.col("build") == a).alias("n_a"), F.count_if(F.col("build") == b).alias("n_b"), F.min(F.when(F.col("build") == b, F.col("id"))).alias("other"),
    )
    match = F.when((F.col("n_a") == 1) & (F.col("n_b") == 1), F.col("other")).alias("match")
    return colours.where(F.col("build") == a).join(sides, "colour").select("id", "n_a", "n_b", match)
