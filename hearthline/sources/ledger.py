"""A keyed ledger in a folder: upserts by batch, compaction, reads as of a version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.operators.state import latest


def _written(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers of the finished folders name=N below path; one that a lost job has left half-written does not count."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}=*/_SUCCESS")
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found)


def upsert(batch: DataFrame, batch_id: int, path: str, key: list[str], order: list[str]) -> None:
    """Writes the last row of each key of a batch to the change log; fits foreachBatch.

    A batch has its own folder, named by its id and replaced whole, so a batch that is delivered again changes nothing. Earlier rows that
    come late lose to later ones by `order`, whatever batch they come in. Ids grow, and rows without a key are a key of their own.
    """
    latest(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Batches that a reader can see; those before the last compaction are read through it."""
    return sorted(set(_written(spark, path, "batch")) | set(_written(spark, path, "upto")))


def as_of(spark: SparkSession, path: str, key: list[str], order: list[str], version: int | None = None) -> DataFrame:
    """The last row of each key, from all batches up to `version` (the newest, if none is named); raises where there is no batch.

    Reads the last compaction up to it and the changes after that, whose number is what compaction keeps small.
    """
    every = versions(spark, path)
    upto = max((v for v in every if version is None or v <= version), default=None)
    if upto is None:
        raise ValueError(f"no batch up to {version} in {path}")
    base = max((v for v in _written(spark, path, "upto") if v <= upto), default=None)
    folders = [f"{path}/upto={base}"] if base is not None else []
    folders += [f"{path}/batch={v}" for v in _written(spark, path, "batch") if v <= upto and (base is None or v > base)]
    return latest(spark.read.parquet(*folders), key, order)


def compact(spark: SparkSession, path: str, key: list[str], order: list[str], version: int | None = None) -> int:
    """Writes the state as of a version as one table, so that later reads need no older change; changes stay, so older versions can still be read."""
    upto = max(v for v in versions(spark, path) if version is None or v <= version)
    if upto not in _written(spark, path, "upto"):
        as_of(spark, path, key, order, upto).write.mode("overwrite").parquet(f"{path}/upto={upto}")
    return upto


def changes(spark: SparkSession, path: str, after: int) -> DataFrame:
    """Rows of batches after a version, with their batch: what a reader of that version has not seen."""
    some = [v for v in _written(spark, path, "batch") if v > after]
    if not some:
        raise ValueError(f"no batch after {after} in {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={v}" for v in some]).withColumn("batch", F.col("batch").cast("long"))
