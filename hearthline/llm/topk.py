"""Operator 2: exact top-k inner products with multi-resolution segment statistics.

For vectors cut into segments of length L with means m and deviations s, the squared distance is at least
sum L * ((m_q - m_c)^2 + (s_q - s_c)^2); with the norms known this is the same as an upper bound on the inner product,
sum L * (m_q * m_c + s_q * s_c). Levels go from one segment to many; a candidate whose bound at a level is below the query's
k-th score so far is out, and survivors get exact integer products.

Bounds are computed in floating point; a candidate goes only if its bound is below by more than the rounding of both vectors' norms can
explain, so none is lost whatever the magnitudes.

Rows travel as packed blocks of integers as wide as their values need. Every pair of a group and a slot is a cell: candidate blocks have
one slot each and go to its cell in each group, query blocks have one group each and go to its cell in each slot (a stated query set
against all rows, in blocks). Cells are shuffled, never joined, so nothing is broadcast; in a cell the queries come first and stay, and each candidate
block is read once. A task holds the queries of a group, of GROUP rows and VALUES components about, with k rows for each; the last step ranks those.
Slots are a fixed number, so what is sent for a query does not grow with the table or the cluster.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without id; vectors of
another length than the query's are no candidates; rows with the query's own id are no candidates; of several query rows
with one id the least vector is the query; repeated candidate rows each take a rank; components beyond 64 bits are taken as the nearest
64-bit integer; scores are compared exactly whatever their size, and those beyond 64 bits are shown as the nearest 64-bit integer; an
empty table gives no rows; further columns, of any name, are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import small_batches, table

K = 10
SCALE = 1024
#: Segments of the levels of bounds, coarse to fine.
LEVELS = (1, 4, 16)
#: Vectors in a block of candidates or queries, at most.
BLOCK = 2048
#: Slots that candidate blocks are dealt into.
SLOTS = 64
#: Queries in a group, about, and their components.
GROUP, VALUES = 1 << 15, 1 << 21
#: Integers that blocks are packed in.
WIDTHS = ("<i2", "<i4", "<i8")
#: Rounding of a bound, in units of the last place for each component: several times what its sums and roots can lose.
ROUNDING = 16 * np.finfo(float).eps
LONG = (1 << 63) - 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of longs) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * SCALE))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def blocks(vectors: DataFrame) -> DataFrame:
    """Vectors packed by length: dims, n, ids as little-endian 64-bit integers, values as the least of WIDTHS that holds them."""

    def narrow(values):
        lo, hi = (values.min(), values.max()) if values.size else (0, 0)
        return values.astype(next(w for w in WIDTHS if np.iinfo(w).min <= lo and hi <= np.iinfo(w).max))

    def pack(batches):
        for pdf in batches:
            dims = pdf["v"].map(len).to_numpy()
            rows = []
            for d in np.unique(dims):
                some = pdf[dims == d]
                for i in range(0, len(some), BLOCK):
                    part = some.iloc[i : i + BLOCK]
                    values = np.stack([np.asarray(x, "<i8") for x in part["v"]]) if d else np.zeros((len(part), 0), "<i8")
                    rows.append((int(d), len(part), part["vec_id"].to_numpy("<i8").tobytes(), narrow(values).tobytes()))
            yield pd.DataFrame(rows, columns=["dims", "n", "ids", "values"])

    return vectors.mapInPandas(pack, "dims int, n int, ids binary, values binary")


class Block:
    """Unpacked vectors with the statistics of each level."""

    def __init__(self, dims: int, n: int, ids: bytes, values: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(values, f"<i{len(values) // (n * dims) if dims else 8}").reshape(n, dims)
        self.f = self.v.astype(float)
        self.levels = []
        for segments in LEVELS:
            if dims and dims % segments == 0:
                x = self.f.reshape(n, segments, -1)
                size = x.shape[2] ** 0.5
                self.levels.append(np.concatenate((x.mean(axis=2) * size, x.std(axis=2) * size), axis=1))
        self.norm = np.sqrt((self.f**2).sum(axis=1))
        self.top = max(int(self.v.max()), -int(self.v.min())) if self.v.size else 0


def products(q: np.ndarray, c: Block, at: np.ndarray, top: int) -> np.ndarray:
    """Exact inner products of q with the chosen rows."""
    bound = top * c.top * max(1, c.v.shape[1])
    if bound < 1 << 53:
        return (c.f[at] @ q.astype(float)).astype(np.int64)
    if bound < 1 << 63:
        return c.v[at].astype(np.int64) @ q.astype(np.int64)
    return np.array([sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in c.v[at]], object)


def search(q: Block, c: Block, best: dict, k: int) -> int:
    """Adds c's candidates to best: query id -> (scores, ids), best first; returns how many exact products it took."""
    exact = 0
    for i, qid in enumerate(q.ids.tolist()):
        scores, ids = best.get(qid, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        at = np.flatnonzero(c.ids != qid)
        floor = scores[-1] if len(scores) >= k else None
        if floor is None and len(at) > k and c.levels:  # the finest bounds tell which few to try first
            bound = c.levels[-1][at] @ q.levels[-1][i]
            first = np.argpartition(-bound, k - 1)[:k]
            floor = np.sort(products(q.v[i], c, at[first], q.top))[0]
        if floor is not None:
            for mine, theirs in zip(q.levels, c.levels, strict=True):
                if not len(at):
                    break
                slack = ROUNDING * (q.v.shape[1] + 16) * (q.norm[i] * c.norm[at] + abs(float(floor)))
                at = at[theirs[at] @ mine[i] >= float(floor) - slack]
        if not len(at):
            continue
        exact += len(at)
        s = np.concatenate((scores, products(q.v[i], c, at, q.top)))
        n = np.concatenate((ids, c.ids[at]))
        order = np.lexsort((n, -s))[:k] if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], n[j]))[:k])
        best[qid] = (s[order], n[order])
    return exact


def topk(embeddings: DataFrame, every: int = 100, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the k best of each row whose id is divisible by `every`."""
    small_batches(embeddings.sparkSession)
    vectors = quantised(embeddings)
    asked = table(vectors.where(F.expr(f"vec_id % {every} = 0")).groupBy("vec_id").agg(F.min("v").alias("v")))
    rows, values = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    groups = max(1, -(-rows // GROUP), -(-values // VALUES))
    repeated = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    dealt = lambda k: F.pmod(F.xxhash64("ids"), F.lit(k)).cast("int")
    q = blocks(asked.select("vec_id", "v")).withColumn("grp", dealt(groups)).withColumn("slot", repeated(SLOTS)).withColumn("kind", F.lit(0))
    c = blocks(vectors).withColumn("slot", dealt(SLOTS)).withColumn("grp", repeated(groups)).withColumn("kind", F.lit(1))
    cells = q.unionByName(c).repartitionById(SLOTS * groups, F.col("grp") * SLOTS + F.col("slot")).sortWithinPartitions("grp", "slot", "kind")

    def run(batches):
        best: dict = {}
        here: dict[int, list[Block]] = {}
        own = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if own != (r.grp, r.slot):
                    yield from ranked(best)
                    best, here, own = {}, {}, (r.grp, r.slot)
                if not r.kind:
                    here.setdefault(r.dims, []).append(Block(r.dims, r.n, r.ids, r.values))
                elif r.dims in here:
                    c = Block(r.dims, r.n, r.ids, r.values)
                    for q in here[r.dims]:
                        search(q, c, best, k)
        yield from ranked(best)

    def ranked(best):
        rows = [(q, i, int(s)) for q, (scores, ids) in best.items() for s, i in zip(scores, ids, strict=True)]
        for at in range(0, len(rows), 50_000):
            q, i, s = zip(*rows[at : at + 50_000], strict=True)
            shown = [min(max(x, -LONG - 1), LONG) for x in s]
            yield pd.DataFrame({"query_id": q, "vec_id": i, "score": shown, "exact": [(x + (1 << 191)).to_bytes(24, "big") for x in s]})

    found = cells.mapInPandas(run, "query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("query_id").orderBy(F.col("exact").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")


#: The same rows in DuckDB SQL.
ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
