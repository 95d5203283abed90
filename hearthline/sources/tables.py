"""Readers and writers: parquet tables, JSON-lines logs, text corpora, binaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of one trace event in a JSON-lines log; what does not parse lands in _corrupt.
EVENT_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING, _corrupt STRING"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_log(spark: SparkSession, path: str, schema: str | StructType = EVENT_SCHEMA) -> DataFrame:
    """An append-only JSON-lines log with a fixed schema: no inference pass, bad lines kept aside."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def write_event_log(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def source_files(spark: SparkSession, root: str, pattern: str = "*.{c,cpp,h}") -> DataFrame:
    """(path, text) of every matching file at any depth below root."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def two_levels(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, text) of files called name one and two folders below root."""
    reads = [spark.read.text(f"{root}/{g}/{name}", wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")) for g in ("*", "*/s*")]
    return reads[0].unionByName(reads[1])


def binaries(spark: SparkSession, root: str) -> DataFrame:
    """Compiled files without their content: path, stem, stripped or with symbols."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select("path", "length", F.regexp_replace(name, "_symbols$", "").alias("stem"), name.endswith("_symbols").alias("has_symbols"))


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of every matching file at any depth below root; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", "length")


#: One binary's ground truth: its functions with their types, as extracted from debug information.
TRUTH_SCHEMA = "binary STRING, functions ARRAY<STRUCT<name: STRING, address: BIGINT, type: STRING>>, _corrupt STRING"


def ground_truth(spark: SparkSession, path: str, schema: str | StructType = TRUTH_SCHEMA) -> DataFrame:
    """(binary, name, address, type) of each function in JSON files, a document a file; files that do not parse come with corrupt set."""
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return truth_rows(docs)


def truth_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("binary", F.col("_corrupt").alias("corrupt"), F.explode_outer("functions").alias("f"))
    return rows.select("binary", "f.name", "f.address", "f.type", "corrupt").where("name IS NOT NULL OR corrupt IS NOT NULL")


def missing(wanted: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Wanted rows that are not there yet: what a cache would have to fetch."""
    return wanted.join(present, key, "left_anti")


def write_once(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Idempotent install: a second run leaves the table as it is."""
    w = df.write.mode("ignore")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    """Recomputes a derived table in place of its last version."""
    df.write.mode("overwrite").parquet(path)
