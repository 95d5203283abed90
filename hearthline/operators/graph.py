"""Property graphs as two tables: nodes (id, label) and edges (src, dst, type)."""

from __future__ import annotations

import tempfile
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges_of(df: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
    return df.select(F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), F.lit(kind).alias("type")).dropDuplicates()


def degrees(edges: DataFrame) -> DataFrame:
    """In- and out-degree; two counts combined by a union, so no side needs a join."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def checkpoints(spark) -> None:
    """Lineage ends in spark.checkpoint.dir; only a local session may go without."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())


def reachable(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(id, depth) of nodes within `depth` steps of roots (id), at their least depth.

    Only nodes that were reached by the last step for the first time go on; each frontier is checkpointed, so no plan grows
    with the depth and a cycle costs nothing.
    """
    checkpoints(edges.sparkSession)
    steps = edges.select("src", F.col("dst").alias("id"))
    frontier = roots.select("id").distinct().checkpoint()
    every = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        found = frontier.withColumnRenamed("id", "src").join(steps, "src").select("id").distinct()
        frontier = found.join(every, "id", "left_anti").checkpoint()
        if frontier.isEmpty():
            break
        every = every.union(frontier.withColumn("depth", F.lit(d)))
    return every


def topological_depth(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, depth): length of the longest path that ends in each node of an acyclic graph; raises where there is a cycle.

    Nodes whose predecessors are all done are done with the greatest of their depths plus one.
    """
    checkpoints(edges.sparkSession)
    rest = edges.select("src", "dst").distinct().checkpoint()
    nodes = rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct()
    level = nodes.join(rest.select(F.col("dst").alias("id")), "id", "left_anti").checkpoint()
    every = level.withColumn("depth", F.lit(0))
    for d in count(1):
        if rest.isEmpty():
            return every
        if level.isEmpty() or d == rounds:
            raise RuntimeError("the graph has a cycle" if level.isEmpty() else f"nodes are left after {d} rounds")
        gone = rest.join(level.withColumnRenamed("id", "src"), "src")
        rest = rest.join(level.withColumnRenamed("id", "src"), "src", "left_anti").checkpoint()
        level = gone.select(F.col("dst").alias("id")).distinct().join(rest.select(F.col("dst").alias("id")), "id", "left_anti").checkpoint()
        every = every.union(level.withColumn("depth", F.lit(d)))


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component): least id among the nodes that reach each other.

    Nodes take the least id that reaches them; those of a colour that reach its namesake back are its component and leave. Every
    round settles a component for each colour, so rounds follow the depth of the graph of components.
    """
    checkpoints(edges.sparkSession)
    rest = edges.select("src", "dst").distinct().checkpoint()
    nodes = rest.select(F.col("src").alias("id")).union(rest.select("dst")).distinct().checkpoint()
    done = None
    while not nodes.isEmpty():
        colour = _spread(nodes.withColumn("colour", F.col("id")), rest)
        c = colour.withColumnRenamed("id", "src").withColumnRenamed("colour", "cs")
        e = colour.withColumnRenamed("id", "dst").withColumnRenamed("colour", "cd")
        inner = rest.join(c, "src").join(e, "dst").where("cs = cd").select("src", "dst").checkpoint()
        found = reachable(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colour.where("id = colour").select("id"), 1 << 30)
        found = found.select("id").join(colour, "id").select("id", F.col("colour").alias("component")).checkpoint()
        done = found if done is None else done.union(found)
        nodes = nodes.join(found, "id", "left_anti").checkpoint()
        rest = rest.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").checkpoint()
    return done if done is not None else nodes.withColumn("component", F.col("id"))


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, colour): the least colour that reaches each node along edges."""
    while True:
        near = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy("dst").agg(F.min("colour").alias("near"))
        step = colour.join(near, colour.id == near.dst, "left").select("id", F.least("colour", F.coalesce("near", "colour")).alias("colour"), F.col("colour").alias("was")).checkpoint()
        colour = step.select("id", "colour")
        if step.where("colour <> was").isEmpty():
            return colour


def two_hops(edges: DataFrame) -> DataFrame:
    e, f = edges.alias("e"), edges.alias("f")
    return e.join(f, F.col("e.dst") == F.col("f.src")).select(F.col("e.src").alias("src"), F.col("e.dst").alias("via"), F.col("f.dst").alias("dst"))


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, component): least id that is connected, by min labels and pointer jumping; reads spark.checkpoint.dir.

    Labels are cut from their lineage every round. Ends as soon as a round changes nothing, and raises where that takes
    more than `rounds`, if given.
    """
    checkpoints(edges.sparkSession)
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct().checkpoint()
    labels = both.select(F.col("src").alias("id")).distinct().withColumn("component", F.col("id"))
    for done in count(1):
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.id == near.src, "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("was"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("far"))
        step = step.join(jump, "component").select("id", F.col("far").alias("component"), "was").checkpoint()
        labels = step.select("id", "component")
        if step.where("component <> was").isEmpty():
            return labels
        if done == rounds:
            raise RuntimeError(f"components have not settled after {rounds} rounds")


def pinned(functions: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Functions whose name is a known import."""
    return functions.join(known.select(name).distinct(), name, "left_semi")


def layouts(accesses: DataFrame) -> DataFrame:
    """Field layout of each base pointer from its accesses (base, at, width)."""
    return accesses.groupBy("base").agg(F.array_sort(F.collect_set(F.struct("at", "width"))).alias("fields"))
