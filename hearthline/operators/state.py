"""State views over an append-only log: latest row per key, keyset pages, counters, feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. max_by combines before the shuffle, so a hot key costs one row a task."""
    rest = [c for c in log.columns if c not in key]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return log.groupBy(*key).agg(last).select(*key, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*log.columns)


def after(log: DataFrame, key: str, last_seen: int, limit: int) -> DataFrame:
    """The next page of a log: a pushed-down filter and a top-n, never a full sort."""
    return log.where(F.col(key) > last_seen).orderBy(key).limit(limit)


def feed(log: DataFrame, predicate: Column, order: list[Column], limit: int) -> DataFrame:
    return log.where(predicate).orderBy(*order).limit(limit)


def over_limit(log: DataFrame, key: str, counted: Column, limit: int) -> DataFrame:
    """Keys whose counted rows exceed a limit."""
    return log.groupBy(key).agg(F.count_if(counted).alias("n")).where(F.col("n") > limit)


def ranked_within(df: DataFrame, group: list[str], order: list[Column], k: int, how: str = "rank") -> DataFrame:
    """The first k ranks of each group; how is rank, dense_rank or row_number."""
    f = {"rank": F.rank, "dense_rank": F.dense_rank, "row_number": F.row_number}[how]
    return df.withColumn("rank", f().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col("rank") <= k)


def merged(sides: list[DataFrame], key: list[str], prefer: str) -> DataFrame:
    """Key-wise union of several sides; of rows with one key, that with the greatest `prefer`."""
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return latest(out, key, [prefer])
