"""Operator 13: hard negatives by vantage-point trees over norm-augmented vectors.

A router, the top of the tree, is made of a bounded sample (SAMPLE vectors) and files every row under a leaf. Leaves over BLOCK rows are dealt into blocks by a hash of
the row, and each block is a vantage-point tree of its own, built once and written. Anchors then visit the leaves in three steps: the leaf that they lie in,
which gives a bound for their positives; all other leaves that can beat it; and, with the positives known, the leaves that meet an annulus of a window of scores.
In a tree the windows are searched nearest first, until k different-label rows are found or the annulus is left.

A step's work is a grid of cells, a block by some of the anchors that visit its leaf; trees and anchors are dealt to cells by a shuffle, no task holds more than one
tree, and a cell gives k rows a window. Of rows with one label and one vector a block keeps those of the k + 1 least ids, k of each: no others can be among
the first k, so a hot vector costs each block a few rows.

Defined cases: rows whose id, label or vector is null, and vectors that hold null or non-finite components take no part; an anchor meets vectors of its own
length only; rows with the anchor's own id are no candidates; of several anchors with one id the one of the least label and vector counts;
repeated rows each take a rank, as positives with windows of their own; components beyond 64 bits are taken as the nearest 64-bit integer, scores are compared exactly
whatever their size and shown as the nearest 64-bit integer; an empty table gives no rows; further columns, of any name, are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import parts, small_batches, table
from hearthline.llm.vantage import Router, VpTree

K = 5
SCALE = 256
#: Vectors that the router is fitted on, its leaves at most, rows of a block about, and anchors of a cell about.
SAMPLE = 4096
LEAVES = 1024
BLOCK = 1 << 14
ASKS = 1 << 11
LONG = (1 << 63) - 1
#: Score windows: from LOW to HIGH hundredths of the positive's score.
LOW, HIGH = 80, 100


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (array of longs) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale))
    some = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & fine)
    return some.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))


def relabelled(vectors: DataFrame) -> DataFrame:
    """The task's noise: every seventh row has the next label."""
    return vectors.withColumn("label", F.when(F.expr("vec_id % 7 = 0"), F.expr("(label + 1) % 10")).otherwise(F.col("label")))


def routers(vectors: DataFrame) -> tuple[dict[int, Router], int]:
    """A router for each length of vectors in the sample, and how many leaves it may have."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    n, m = vectors.agg(F.count(F.lit(1)), F.max(norm)).first()
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "v").limit(SAMPLE).select("v").collect() if n else []
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r.v), []).append(r.v)
    leaves = min(LEAVES, max(1, n // BLOCK))
    return {d: Router(np.array(v, np.int64).reshape(len(v), d), leaves, m) for d, v in by.items()}, leaves


def filed(vectors: DataFrame, shared) -> DataFrame:
    """vectors with dims and the leaf; v as little-endian 64-bit integers."""

    def run(batches):
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy(np.int32)
            leaf = np.zeros(len(pdf), np.int32)
            for d in np.unique(dims).tolist():
                if d in shared.value:
                    at = np.flatnonzero(dims == d)
                    leaf[at] = shared.value[d].leaf_of(np.stack([np.asarray(x, float) for x in pdf["v"].iloc[at]]).reshape(len(at), d))
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "dims": dims, "leaf": leaf, "v": [np.asarray(x, "<i8").tobytes() for x in pdf["v"]]})

    return vectors.mapInPandas(run, "vec_id long, label long, dims int, leaf int, v binary")


def trees(rows: DataFrame, k: int) -> DataFrame:
    """dims, leaf, salt, salts (how many blocks the leaf has), tree."""
    sizes = rows.groupBy("dims", "leaf").count().select("dims", "leaf", F.ceil(F.col("count") / BLOCK).cast("int").alias("salts"))
    salted = rows.join(sizes, ["dims", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        once = pdf[pdf.groupby(["label", "v", "vec_id"], sort=False).cumcount() < k]
        nth = once.drop_duplicates(["label", "v", "vec_id"])
        nth = nth.assign(nth=nth.groupby(["label", "v"], sort=False).cumcount())
        once = once.merge(nth.loc[nth["nth"] <= k, ["label", "v", "vec_id"]], on=["label", "v", "vec_id"])
        d = int(pdf["dims"].iloc[0])
        x = np.frombuffer(b"".join(once["v"]), "<i8").reshape(len(once), d)
        made = VpTree.build(once["vec_id"].to_numpy(np.int64), once["label"].to_numpy(np.int64), x).packed()
        return pd.DataFrame({"dims": [d], "leaf": [int(pdf["leaf"].iloc[0])], "salt": [int(pdf["salt"].iloc[0])], "salts": [int(pdf["salts"].iloc[0])], "tree": [made]})

    return salted.groupBy("dims", "leaf", "salt").applyInPandas(build, "dims int, leaf int, salt int, salts int, tree binary")


def visits(asks: DataFrame, index: DataFrame, search, schema: str) -> DataFrame:
    """Runs search(tree, id, label, v, extra) for asks (dims, leaf, id, label, v, extra) at every tree of their leaves."""
    salts = index.select("dims", "leaf", "salts").distinct()
    many = asks.groupBy("dims", "leaf").count().select("dims", "leaf", F.ceil(F.col("count") / ASKS).cast("int").alias("of"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a table of leaves joined with its asks: `of` is spread by a hash of the anchor
    there = index.join(many, ["dims", "leaf"]).select("dims", "leaf", "salt", each("of").alias("part"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("label"), F.lit(None).cast("binary").alias("v"), F.lit(None).cast("binary").alias("extra"), "tree")
    here = asks.join(many, ["dims", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")).join(salts, ["dims", "leaf"])
    here = here.select("dims", "leaf", each("salts").alias("salt"), "part", F.lit(1).alias("kind"), "id", "label", "v", "extra", F.lit(None).cast("binary").alias("tree"))
    cell = ["dims", "leaf", "salt", "part"]
    dealt = there.union(here).repartition(parts(asks.sparkSession), *cell).sortWithinPartitions(*cell, "kind", "id")

    def run(batches):
        tree = None
        for pdf in batches:
            rows: list = []
            for r in pdf.itertuples(index=False):
                if r.kind == 0:
                    tree = VpTree.unpacked(r.tree)
                else:
                    rows += search(tree, int(r.id), int(r.label), np.frombuffer(r.v, "<i8"), pickle.loads(r.extra) if r.extra is not None else None)
            if rows:
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return dealt.mapInPandas(run, schema)


def exact(score: int) -> bytes:
    """Bytes that sort as the scores do."""
    return (score + (1 << 191)).to_bytes(24, "big")


def score_of(data: bytes) -> int:
    return int.from_bytes(data, "big") - (1 << 191)


def shown(score: int) -> int:
    return min(max(score, -LONG - 1), LONG)


def first(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.col("exact").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def mine(vectors: DataFrame, every: int = 100, k: int = K, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. vectors: vec_id, label, v.

    Anchors are the rows whose id is divisible by `every`; each has the k best rows of its label as positives, and each of
    these the k best rows of other labels whose score lies between low and high hundredths of the positive's.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    made, _ = routers(vectors)
    shared = spark.sparkContext.broadcast(made)
    rows = table(filed(vectors, shared))
    index = table(trees(rows, k))
    anchors = rows.where(F.expr(f"vec_id % {every} = 0")).groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("label", "dims", "v", "leaf")).alias("a"))
    anchors = table(anchors.select("id", "a.label", "a.dims", "a.leaf", "a.v"))

    found = "id long, vec_id long, exact binary"
    home = anchors.select("dims", "leaf", "id", "label", "v", F.lit(None).cast("binary").alias("extra"))
    own = table(first(visits(home, index, positives(k), found), k, "id").select("id", "vec_id", "exact"))
    floors = own.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.min("exact")).alias("floor"))
    wide = anchors.join(floors, "id", "left")
    more = visits(routed(wide, shared, beyond), index, positives(k), found)
    best = table(first(own.union(more), k, "id"))

    # k positives at most, so the list is bounded; the floor of the search is all that it carries
    windows = best.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "exact"))).alias("windows"))
    asked = routed(anchors.join(windows, "id"), shared, within(low, high))
    rows = visits(asked, index, different(k, low, high), "id long, positive int, positive_id long, positive_score long, vec_id long, exact binary, score long")
    out = first(rows, k, "id", "positive")
    return out.select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def positives(k: int):
    def search(tree: VpTree, id_: int, label: int, v: np.ndarray, floor):
        wanted = (tree.labels == label) & (tree.ids != id_)
        return [(id_, i, exact(int(s))) for s, i in tree.asked(v).nearest(k, wanted, floor)]

    return search


def different(k: int, low: int, high: int):
    def search(tree: VpTree, id_: int, label: int, v: np.ndarray, windows):
        wanted, ask, out = (tree.labels != label) & (tree.ids != id_), tree.asked(v), []
        for rank, pid, s in windows:
            lo, hi = -(-low * s // 100), high * s // 100
            if lo <= hi:
                out += [(id_, rank, pid, shown(s), i, exact(int(n)), shown(int(n))) for n, i in ask.nearest(k, wanted, lo, hi)]
        return out

    return search


def beyond(row, annuli):
    """Leaves other than the anchor's own that can beat its floor."""
    floor = None if row.floor is None else score_of(row.floor)
    extra = pickle.dumps(floor)
    return [(leaf, extra) for leaf, up, _ in annuli if leaf != row.leaf and (floor is None or up >= floor)]


def within(low: int, high: int):
    def choose(row, annuli):
        """Leaves that meet the annulus of a window, with the windows that they meet."""
        windows = [(int(w["rank"]), int(w["vec_id"]), score_of(w["exact"])) for w in row.windows]
        out = []
        for leaf, up, down in annuli:
            some = [w for w in windows if low * w[2] <= high * w[2] and 100 * up >= low * w[2] and 100 * down <= high * w[2]]
            if some:
                out.append((leaf, pickle.dumps(some)))
        return out

    return choose


def routed(anchors: DataFrame, shared, choose) -> DataFrame:
    """asks: a row for each anchor and leaf that `choose` names."""
    everywhere = [(0, float("inf"), float("-inf"))]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                router = shared.value.get(r.dims)
                annuli = router.annuli(np.frombuffer(r.v, "<i8").astype(float)) if router else everywhere
                rows += [(r.dims, leaf, r.id, r.label, r.v, extra) for leaf, extra in choose(r, annuli)]
                if len(rows) > 5000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["dims", "leaf", "id", "label", "v", "extra"]
    return table(anchors.mapInPandas(run, "dims int, leaf int, id long, label long, v binary, extra binary"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    return mine(relabelled(quantised(embeddings)))


#: The same rows in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.v, c.v)]) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND c.vec_id <> a.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM s WHERE same) WHERE place <= 5),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
