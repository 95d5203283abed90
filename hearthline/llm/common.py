"""Shared pieces: shared-folder tables, hashes from prefix sums, a size-bounded membership filter."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the membership filter that `maybe_in` broadcasts: 1 MB, whatever the input.
FILTER_BITS = 1 << 23
#: Encodings that one Python worker keeps before it starts over, and the longest key that it keeps.
CACHE_WORDS = 200_000
CACHE_KEY = 64
#: Most bytes of rows that a Python worker gets at once.
BATCH_BYTES = 8 << 20

_written: list[tuple[SparkSession, str]] = []
#: Tables of the innermost `finished` that is at work.
_own: ContextVar[list | None] = ContextVar("own", default=None)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set and the session is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="hearthline-"))
    return sc.getCheckpointDir()


def release() -> None:
    """Deletes all intermediate tables. Results that have not been written by then can't be read any more."""
    while _written:
        drop(*_written.pop())


@atexit.register
def _clean() -> None:
    try:
        release()
    except Exception:  # noqa: BLE001 - the session has ended
        return


def drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds what Python workers hold, however long texts are. Results do not depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/t-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    if (own := _own.get()) is not None:
        own.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, as a table; the tables that it made on its way are deleted."""
    own: list[tuple[SparkSession, str]] = []
    token = _own.set(own)
    try:
        df = make()
    finally:
        _own.reset(token)
    out = table(df)
    for made in own:
        _written.remove(made)
        drop(*made)
    return out


def spare() -> None:
    """Gives a worker's unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(f):
    """f, a function from batches to batches, which gives unused memory back when it ends: the worker stays, idle or for other stages."""

    def run(batches):
        yield from f(batches)
        spare()

    return run


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Cached(dict):
    """Maps a key by `make`, keeping the results of the latest `limit` to 2 * `limit` different keys.

    Keys of over `longest` bytes or characters are made anew each time, so what is kept is bounded in bytes too, also in texts without spaces.
    """

    def __init__(self, make, limit: int = CACHE_WORDS, longest: int = CACHE_KEY):
        super().__init__()
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) > self.longest:
            return
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value

    def fill(self, keys: set, make_many) -> None:
        """Makes what is not kept of `keys`, and can be, by one call."""
        new = [k for k in keys if len(k) <= self.longest and k not in self and k not in self.old]
        for k, v in zip(new, make_many(new), strict=True):
            self.put(k, v)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit reaches each output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_C = 0x9E3779B97F4A7C15
_CINV = pow(_C, -1, 1 << 64)


class Powers:
    """Powers of the hash multiplier and of its inverse, modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(2 * len(self.up), n, 4096)
            up, down = np.full(size, _C, np.uint64), np.full(size, _CINV, np.uint64)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


def prefix_sums(t: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(t * powers.get(len(t))[0], out=out[1:])
    return out


#: A random odd number for each byte, and which bytes are white space.
BYTES = np.random.Generator(np.random.PCG64(9)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: Bytes that are hashed at once, so that what a very long text or word takes is bounded.
SOME_BYTES = 4 << 20


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text's bytes start and end: what bytes.split() would give."""
    outside = np.ones(len(data) + 2, bool)
    outside[1:-1] = _SPACE[data]
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of the words that lie at these places, from prefix sums over the bytes: no word is looked at by itself."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(end, start[i] + SOME_BYTES, "right"))
        if j <= i:  # one word of more than that
            out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
            i += 1
            continue
        a, b = start[i:j], end[i:j]
        sums = prefix_sums(BYTES[data[a[0] : b[-1]]], powers)
        out[i:j] = mix((sums[b - a[0]] - sums[a - a[0]]) * powers.get(len(sums))[1][a - a[0]] + (b - a).astype(np.uint64))
        i = j
    return out


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, with underscores before those that a column has already (names differ in more than case)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def _marked(df: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, str]:
    """df with a flag: whether its `column` may be among ids' values; the flag's name."""
    slot, word, bits, maybe = fresh(df.columns, "_slot", "_word", "_bits", "_maybe")
    at = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST(`{c}` % 64 AS INT))")
    words = (
        ids.where(F.col(column).isNotNull()).select(at(F.col(column)).alias(slot))
        .groupBy(F.expr(f"`{slot}` div 64").alias(word)).agg(F.bit_or(bit(slot)).alias(bits))
    )
    out = (
        df.withColumn(slot, at(F.col(column))).withColumn(word, F.expr(f"`{slot}` div 64"))
        .join(F.broadcast(words), word, "left")
        .withColumn(maybe, F.col(column).isNotNull() & F.coalesce(F.col(bits).bitwiseAND(bit(slot)) != 0, F.lit(False)))
        .drop(word, slot, bits)
    )
    return out, maybe


def maybe_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose `column` may be among ids' values: every match and a few others.

    A bitmap of FILTER_BITS bits is broadcast, so its size does not depend on the data; when it
    fills up it only stops sparing work. An exact join must follow. `column` is a long in both.
    """
    out, flag = _marked(df, ids, column)
    return out.where(F.col(flag)).select(*[f"`{c}`" for c in df.columns])


def surely_not_in(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The other rows of df: those of which `maybe_in` is sure, and those with a null."""
    out, flag = _marked(df, ids, column)
    return out.where(~F.col(flag)).select(*[f"`{c}`" for c in df.columns])


def row_hash() -> F.Column:
    """Tells rows of one doc_id apart; with doc_id it names a row, up to equal ones."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame, rows: DataFrame, *more: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """docs with its row hash; rows (doc_id, row, *more) under names that docs does not have; these names, the row hash's first."""
    names = fresh(docs.columns, "_row", "_d", "_r", *(f"_{m}" for m in more))
    own = [F.col("doc_id").cast("long").alias(names[1]), F.col("row").alias(names[2]), *(F.col(m).alias(n) for m, n in zip(more, names[3:], strict=True))]
    return docs.withColumn(names[0], row_hash()), table(rows.select(own).dropDuplicates(names[1:3])), names


def _same(names: list[str]):
    return (F.col(names[0]) == F.col(names[2])) & F.col("doc_id").cast("long").eqNullSafe(F.col(names[1]))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs without the rows (doc_id, row); only those that may be meant are shuffled. Columns of any name pass unchanged."""
    keyed, ids, names = _keyed(docs, rows)
    hashes = ids.select(F.col(names[2]).alias(names[0]))
    kept = maybe_in(keyed, hashes, names[0]).join(ids, _same(names), "left_anti")
    return surely_not_in(keyed, hashes, names[0]).union(kept).drop(names[0])


def replaced(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with the texts of edits (doc_id, row, text) put in; n_chars follows if docs has it. Other columns pass unchanged."""
    keyed, edits, names = _keyed(docs, edits, "text")
    hashes, new = edits.select(F.col(names[2]).alias(names[0])), F.col(names[3])
    both = maybe_in(keyed, hashes, names[0]).join(edits, _same(names), "left").withColumn("text", F.coalesce(new, F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(new.isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return surely_not_in(keyed, hashes, names[0]).union(both.select(*[f"`{c}`" for c in keyed.columns])).drop(names[0])
