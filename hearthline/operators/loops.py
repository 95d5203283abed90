"""Loops of an actor: stretches of its ordered events that repeat one block several times over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthline.operators.graph import checkpoints


def _ended(z: Column, start: Column, p: Column) -> Column:
    """Whether a run of period p after place `start` has a shorter period that divides p, by the last misses z at its end."""
    return F.exists(F.sequence(F.lit(1), p), lambda q: (q < p) & (p % q == 0) & (F.get(z, q - 1) <= start - p + q))


def loops(events: DataFrame, key: str, order: list[str], kind: str, longest: int = 8, times: int = 3) -> DataFrame:
    """Maximal stretches of a key's events in which a block of at most `longest` kinds comes `times` times or more.

    Gives key, period (the shortest that the stretch has), repeats (whole blocks), first (place of its first event, from 1), length (its events) and alarm, the
    order columns of the event that completes the `times`th block. `order` is total within a key. Kinds that are null equal each other; a null key is a key.

    An event matches at lag p if the p-th event before it has its kind; a stretch is a run of matches. Rows are dealt into slices of (key, order) by range, so a
    key with all rows lies in all slices; each slice takes over the last kinds, the number of events and the last misses of the key's earlier slices, a row a key and slice.
    """
    spark = events.sparkSession
    checkpoints(spark)
    lags = range(1, longest + 1)
    rows = events.select(F.col(key).alias("_k"), F.struct(*order).alias("_o"), F.struct(F.col(kind).alias("c")).alias("_c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a slice's number holds when a task runs again
    sliced = rows.repartitionByRange(parts, "_k", "_o").withColumn("_s", F.spark_partition_id()).checkpoint()
    inside = Window.partitionBy("_s", "_k").orderBy("_o")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = sliced.select("*", F.row_number().over(inside).alias("_i"), *[F.lag("_c", p).over(inside).alias(f"_l{p}") for p in lags])

    slices = Window.partitionBy("_k").orderBy("_s")
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    newest = F.array("_c", *[f"_l{p}" for p in lags[:-1]])
    tails = near.groupBy("_s", "_k").agg(F.count(F.lit(1)).alias("_n"), F.max_by(newest, "_o").alias("_tail"))
    # a slice has an event of the key at least, so that many slices hold enough of them
    past = F.flatten(F.reverse(F.collect_list("_tail").over(slices.rowsBetween(-longest, -1))))
    taken = tails.select("_s", "_k", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.filter(past, lambda x: x.isNotNull()).alias("_past"))

    def with_slices(left: DataFrame, right: DataFrame) -> DataFrame:
        r = right.withColumnsRenamed({"_s": "_s2", "_k": "_k2"})
        return left.join(r, (left["_s"] == r["_s2"]) & left["_k"].eqNullSafe(r["_k2"])).drop("_s2", "_k2")

    at = lambda p: F.when(F.col("_i") > p, F.col(f"_l{p}")).otherwise(F.get("_past", F.lit(p) - F.col("_i")))
    n = F.col("_before") + F.col("_i")
    miss = lambda p: F.when(~(at(p).isNotNull() & at(p).eqNullSafe(F.col("_c"))), n).alias(f"_m{p}")
    placed = with_slices(near, taken).select("_s", "_k", "_o", n.alias("n"), *[miss(p) for p in lags])
    own = placed.select("_s", "_k", "_o", "n", *[F.max(f"_m{p}").over(running).alias(f"_m{p}") for p in lags])
    last = placed.groupBy("_s", "_k").agg(*[F.max(f"_m{p}").alias(f"_m{p}") for p in lags])
    carried = last.select("_s", "_k", *[F.max(f"_m{p}").over(before).alias(f"_b{p}") for p in lags])
    z = F.array(*[F.coalesce(f"_m{p}", f"_b{p}") for p in lags]).alias("z")
    each = with_slices(own, carried).select("_k", "_o", "n", z)

    matched = F.filter(F.sequence(F.lit(1), F.lit(longest)), lambda p: F.get("z", p - 1) < F.col("n"))
    each = each.select("*", F.explode(matched).alias("p")).withColumn("start", F.get("z", F.col("p") - 1))
    enough = (times - 1) * F.col("p")
    runs = each.groupBy("_k", "p", "start").agg(F.count(F.lit(1)).alias("m"), F.max_by("z", "n").alias("z"), F.min(F.when(F.col("n") - F.col("start") == enough, F.col("_o"))).alias("alarm"))
    runs = runs.where((F.col("m") >= enough) & ~_ended(F.col("z"), F.col("start"), F.col("p")))
    long = lambda e: F.expr(f"CAST({e} AS BIGINT)")
    return runs.select(F.col("_k").alias(key), long("p").alias("period"), long("(m + p) div p").alias("repeats"), long("start + 1 - p").alias("first"), long("m + p").alias("length"), "alarm")
