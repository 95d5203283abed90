"""Vectors: nearest centres of labelled ones, and an inverted-file index for the nearest rows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.graph import checkpoints

#: Most labels whose centres travel in one row, and most numbers in it.
LABELS = 4096
NUMBERS = 4 << 20
#: Defaults of the index: cells, rows that its centres are fitted on at most, and cells that a query probes first.
CELLS, SAMPLE, PROBES = 64, 8192, 8
#: Rows and queries of a block, which is what one task compares at once.
BLOCK_ROWS, BLOCK_QUERIES = 16384, 4096
#: Components lie within this, so that squared distances and places of a block fit in 63 bits.
LARGEST = 1 << 18


def labels_by_nearest(rows: DataFrame) -> DataFrame:
    """label, nearest, n: how many vectors of each label lie nearest to which label's centre; rows has label and v (array of longs).

    All centres stand in one row, which is broadcast: labels times dimensions, both of which are checked.
    """
    labels, dims = rows.agg(F.countDistinct("label"), F.max(F.size("v"))).first()
    if labels > LABELS or labels * (dims or 0) > NUMBERS:
        raise ValueError(f"{labels} labels of {dims} dimensions are too many for one row of centres")
    sums = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x"), F.count(F.lit(1)).alias("n"))
    each = sums.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("s"), F.max("n").alias("n"))
    centres = each.agg(F.array_sort(F.collect_list(F.struct("label", "s", "n"))).alias("centres"))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda t, x: t + x).cast("double")
    scored = F.transform("centres", lambda c: F.struct((-total(F.col("v"), c["s"]) / c["n"]).alias("far"), c["label"].alias("label")))
    near = rows.crossJoin(F.broadcast(centres)).select("label", F.array_min(scored)["label"].alias("nearest"))
    return near.groupBy("label", "nearest").agg(F.count(F.lit(1)).alias("n"))


class Index(NamedTuple):
    """rows: id, v, cell, far (distance to the cell's centre), every usable row once; sizes: cell, n, radius; centres by cell."""

    rows: DataFrame
    sizes: DataFrame
    centres: np.ndarray


def usable(rows: DataFrame) -> DataFrame:
    """(id, v) of rows with an id and a vector of longs without nulls, of the length that most rows have (of two, the smaller)."""
    whole = rows.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<long>").alias("v")).where("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")
    common = whole.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dims").first()
    return whole.where(F.size("v") == (common.dims if common else 0))


def indexed(rows: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> Index:
    """Files all usable rows (id, v) under the nearest of `cells` centres.

    Centres are fitted by k-means on the `sample` rows with the least hashes of their ids, which bounds the fit whatever the table; no
    result of an exact search depends on them. Components beyond LARGEST raise an error.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    checkpoints(spark)
    rows = usable(rows)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(F.col("v").cast("array<double>")).alias("features")).checkpoint()
    centres = np.array(KMeans(k=cells, seed=1, maxIter=10).fit(some).clusterCenters()) if not some.isEmpty() else np.zeros((0, 0))

    def file(batches):
        for b in batches:
            if len(b):
                far = _distances(b["v"], centres)
                cell = far.argmin(1)
                yield b.assign(cell=cell.astype("int32"), far=far[np.arange(len(b)), cell])

    filed = rows.mapInPandas(file, "id long, v array<long>, cell int, far double").checkpoint()
    sizes = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).checkpoint()
    return Index(filed, sizes, centres)


def nearest(index: Index, queries: DataFrame, k: int, probes: int = PROBES, exact: bool = True) -> DataFrame:
    """(query, rank, id, far): the k rows with the least squared distances to each query (id, v), ties to the smaller id.

    A query's `probes` nearest cells are searched first. Where exact, cells that may still hold a better row by the triangle inequality (distance
    to the centre less the cell's radius) come after, so results are those of a search of all rows; else they are left out, and recall is what the
    probes give. Rows of the query's own id are no answers. Queries and rows of a cell meet in blocks of bounded size, of which each gives k rows
    a query at most, so neither a hot cell nor repeated vectors fill a task. Queries without an id or with a vector of another length find nothing.
    """
    centres = index.centres
    if not len(centres):
        return queries.sparkSession.createDataFrame([], "query long, rank int, id long, far long")
    queries = queries.select(F.col("id").cast("long").alias("query"), F.col("v").cast("array<long>").alias("v"))
    queries = queries.where((F.size("v") == centres.shape[1]) & F.expr("query IS NOT NULL AND NOT exists(v, x -> x IS NULL)")).dropDuplicates(["query", "v"])

    def reach(batches):
        for b in batches:
            if len(b):
                yield b.assign(reach=list(_distances(b["v"], centres)))

    cells = F.posexplode("reach").alias("cell", "reach")
    routed = queries.mapInPandas(reach, "query long, v array<long>, reach array<double>")
    routed = routed.withColumn("first", F.slice(F.array_sort(F.transform("reach", lambda d, i: F.struct(d.alias("d"), i.alias("cell")))), 1, probes)["cell"]).checkpoint()
    best = _searched(index, routed.select("query", "v", F.explode("first").alias("cell")), k)
    if exact:
        best = best.checkpoint()
        found = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.max("far"))).alias("bound"))
        left = routed.join(found, "query", "left").select("query", "v", "first", "bound", cells).where(~F.array_contains("first", F.col("cell")))
        left = left.join(F.broadcast(index.sizes), "cell").where("bound IS NULL OR (reach - radius) * (1 - 1e-9) <= bound * (1 + 1e-9) + 1e-6")
        best = _least(best.union(_searched(index, left.select("query", "v", "cell"), k)), k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("far", "id"))
    return best.select("query", rank.alias("rank"), "id", "far")


def _distances(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    v = np.stack(vectors.to_numpy())
    if np.abs(v).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST} are not indexed; scale them first")
    return np.stack([np.linalg.norm(v - c, axis=1) for c in centres], axis=1)


def _least(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; rows beyond them are dropped before the shuffle too."""
    rank = F.row_number().over(Window.partitionBy("query").orderBy("far", "id"))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _searched(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    """(query, id, far): the k best rows of the wanted cells (query, v, cell) for each query."""
    wanted = wanted.checkpoint()
    slots = lambda n, most: F.ceil(n / most).cast("int")
    grid = index.sizes.join(wanted.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    grid = F.broadcast(grid.select("cell", slots(F.col("n"), BLOCK_ROWS).alias("down"), slots(F.col("m"), BLOCK_QUERIES).alias("across")))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = index.rows.join(grid, "cell").select("cell", dealt("id", "down").alias("i"), all_of("across").alias("j"), "id", "v")
    asked = wanted.join(grid, "cell").select("cell", all_of("down").alias("i"), dealt("query", "across").alias("j"), "query", "v")

    def block(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("id")
            ids, x = rows["id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(float)
            norms = (x * x).sum(1)
            for at in range(0, len(asked), 256):
                some = asked.iloc[at : at + 256]
                own, q = some["query"].to_numpy(), np.stack(some["v"].to_numpy()).astype(float)
                far = ((q * q).sum(1)[:, None] - 2 * (q @ x.T) + norms).astype("int64")  # whole numbers below 2**53 throughout
                far = np.where(own[:, None] == ids, np.iinfo("int64").max, far * len(ids) + np.arange(len(ids)) if far.max() < (1 << 62) // len(ids) else -1)
                if (far < 0).any():
                    raise ValueError("distances are too large for a block")
                top = np.argpartition(far, k - 1, axis=1)[:, :k] if k < len(ids) else np.broadcast_to(np.arange(len(ids)), far.shape)
                key = np.take_along_axis(far, top, axis=1)
                keep = key < np.iinfo("int64").max
                out.append(pd.DataFrame({"query": np.repeat(own, keep.sum(1)), "id": ids[top[keep]], "far": key[keep] // len(ids)}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "far": []}, dtype="int64")

    place = ["cell", "i", "j"]
    return _least(rows.groupBy(*place).cogroup(asked.groupBy(*place)).applyInPandas(block, "query long, id long, far long"), k)
