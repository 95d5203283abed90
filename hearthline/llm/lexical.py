"""Operator 11: ranked lexical search over a tiered index.

All documents are counted once: how many terms each has, and how often it holds each term that an item asks for. From the counts come the
weights of terms, the impact of each posting (term, document), and a histogram of impacts by term. Thresholds cut a term's postings into tiers: the first holds its
TIERS[0] postings of highest impact at most, the next TIERS[1] at most, and the last one all. What a tier leaves out of a term is at most the
term's residual bound.

Items are searched in the first tier. A document that is not found there scores less than the sum of its item's residual bounds; if the item's tenth best
exact score is above that sum, its result is among the found ones whose own bound reaches the tenth, and these are scored exactly. Items without
that proof fall through to the next tier, and the last is a pass over the counted documents in which each task keeps
its best few rows for every item that is left. So rows grow with items and their terms, or stay inside tasks, and never with documents times items.

Items are taken in blocks of about BLOCK_BYTES of text, so that what is broadcast, the terms that a block asks for and their weights, is bounded whatever the items' number.

Defined cases: null and empty texts, and texts without terms, are no documents and no items; rows without doc_id take no part; rows that
share a doc_id are documents of their own, as are equal rows, and tie in any order; rows of items that share an item_id are items of their own; a very long text is
counted whole; with fewer than k documents of a score above 0 there are fewer rows; empty tables give no rows; further columns, of any name, are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import finished, lean, maybe_in, small_batches, table, word_spans
from hearthline.llm.words import Vocabulary, units

K = 10
#: Postings of a term in the first tier and in the first two, at most.
TIERS = (256, 2048)
#: Impacts to a level of the histogram.
LEVEL = 4000
#: Bytes of items in a block, about.
BLOCK_BYTES = 4 << 20
#: Items whose scores the last tier computes at once, and documents.
ITEMS, DOCUMENTS = 64, 512
SOME_BYTES = 1 << 20
#: Letters to lower case, digits and bytes beyond ASCII as they are, all else to spaces.
TRANSLATION = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    return (text or "").encode().translate(TRANSLATION)


def counted(documents: DataFrame, words: list[bytes]) -> DataFrame:
    """doc (a number of the row's own), doc_id, n (all its terms), terms (places in words), tfs; rows that have a term."""
    shared = documents.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        v = max(1, len(shared.value))
        for batch in batches:
            texts = [folded(t) for t in batch.column(1).to_pylist()]
            n, codes = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)]
            for some in units(texts, SOME_BYTES):
                joined = b" ".join(raw for _, raw in some)
                start, end = word_spans(np.frombuffer(joined, np.uint8))
                ends = np.cumsum([len(raw) + 1 for _, raw in some])
                owner = np.array([i for i, _ in some])[np.searchsorted(ends, start, "right")] if len(start) else np.zeros(0, np.int64)
                np.add.at(n, owner, 1)
                at = vocabulary.find(joined, start, end)
                own, many = np.unique((owner * v + at)[at >= 0], return_counts=True)
                codes.append(np.stack((own, many), axis=1).reshape(-1))
            pairs = np.concatenate(codes).reshape(-1, 2)
            own, back = np.unique(pairs[:, 0], return_inverse=True)
            tf = np.bincount(back, weights=pairs[:, 1], minlength=len(own)).astype(np.int64)
            offsets = np.searchsorted(own, np.arange(len(texts) + 1) * v).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in ((own % v).astype(np.int32), tf)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], names=["doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(lean(run), "doc_id long, n long, terms array<int>, tfs array<long>")
    return rows.withColumn("doc", F.monotonically_increasing_id())


def impact(tf, m):
    return F.expr(f"(1000000000L * {tf}) div (1000L * {tf} + 8L * {m})")


class Asked:
    """A block of items: their terms as places in `words`, and how often each item has each."""

    def __init__(self, rows):
        place: dict[bytes, int] = {}
        self.ids, self.terms = [r.item_id for r in rows], []
        for r in rows:
            mine: dict[int, int] = {}
            for w in folded(r.text).split():
                at = place.setdefault(w, len(place))
                mine[at] = mine.get(at, 0) + 1
            self.terms.append(mine)
        self.words = list(place)


def levels(postings: DataFrame, tiers) -> DataFrame:
    """term, df, and for each tier j its threshold t{j} (the least level in it; null: none) and residual r{j} (no impact outside is above it)."""
    hist = postings.groupBy("term", F.expr(f"impact div {LEVEL}").alias("level")).count()
    upto = Window.partitionBy("term").orderBy(F.col("level").desc())
    hist = hist.withColumn("upto", F.sum("count").over(upto))
    out = [F.sum("count").alias("df")]
    for j, most in enumerate(tiers):
        out += [F.min(F.when(F.col("upto") <= most, F.col("level"))).alias(f"t{j}")]
        out += [F.coalesce(F.max(F.when(F.col("upto") > most, (F.col("level") + 1) * LEVEL - 1)), F.lit(0)).alias(f"r{j}")]
    return hist.groupBy("term").agg(*out)


def search(documents: DataFrame, items: DataFrame, k: int = K, tiers=TIERS) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of each item, and tier: the tier that proved the item's result."""
    return finished(lambda: _search(documents, items, k, tiers))


def _search(documents: DataFrame, items: DataFrame, k: int, tiers) -> DataFrame:
    small_batches(documents.sparkSession)
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    out = None
    for b in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = table(_block(documents, Asked(some.orderBy("item_id", "text").collect()), k, tiers))
        out = found if out is None else out.union(found)
    return out


def _block(documents: DataFrame, asked: Asked, k: int, tiers) -> DataFrame:
    spark = documents.sparkSession
    docs = table(counted(documents, asked.words))
    n_docs, n_terms = docs.agg(F.count(F.lit(1)), F.sum("n")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
    if not n_docs or not asked.words:
        return empty
    docs = docs.withColumn("m", F.expr(f"25 + (75 * n * {n_docs}L) div {n_terms}L"))
    postings = docs.select("doc", "m", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc", F.col("p.terms").alias("term"), impact("p.tfs", "m").alias("impact"))
    terms = table(levels(postings, tiers).withColumn("w", F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))))
    pairs = [(i, t, r) for i, mine in enumerate(asked.terms) for t, r in mine.items()]
    weights = table(spark.createDataFrame(pairs, "item int, term int, n int").join(terms, "term").withColumn("w", F.col("w") * F.col("n")).drop("n", "df"))
    # as many rows as the block's items have terms, so the broadcast is bounded by BLOCK_BYTES
    deepest = f"t{len(tiers) - 1}"
    cut = terms.where(f"{deepest} IS NOT NULL").select("term", *(f"t{j}" for j in range(len(tiers))))
    tier = F.coalesce(*(F.when(F.expr(f"impact div {LEVEL} >= t{j}"), j) for j in range(len(tiers))))
    index = table(postings.join(F.broadcast(cut), "term").withColumn("tier", tier).where("tier IS NOT NULL").select("tier", "term", "doc", "impact"))
    maps = table(weights.groupBy("item").agg(F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias("weights")))

    left, done = weights, []
    floors = spark.createDataFrame([], "item int, floor long")
    for j in range(len(tiers)):
        rows, floors = _tier(j, index.where(f"tier <= {j}"), left, docs, maps, k)
        done.append(rows)
        proven = rows.select("item").distinct()
        # items without any row are searched on, unless no document can hold a term of theirs
        left = table(left.join(proven, "item", "left_anti"))
    done.append(_last(left, floors, docs, len(asked.words), k, len(tiers)))
    rows = done[0]
    for d in done[1:]:
        rows = rows.union(d)
    ids = F.broadcast(spark.createDataFrame(list(enumerate(asked.ids)), "item int, item_id long"))
    return rows.join(ids, "item").select("item_id", "rank", "doc_id", "score", "tier")


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id", "doc")
    return rows.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}")


def exact(pairs: DataFrame, docs: DataFrame, maps: DataFrame) -> DataFrame:
    """pairs (item, doc) with doc_id and the exact score, from the documents' own counts."""
    some = maybe_in(docs, pairs, "doc").join(pairs, "doc").join(maps, "item")
    each = F.aggregate(
        F.arrays_zip("terms", "tfs"), F.lit(0).cast("long"),
        lambda s, p: s + F.coalesce(F.try_element_at("weights", p["terms"]), F.lit(0).cast("long")) * _impact_of(p["tfs"]),
    )
    return some.select("item", "doc", "doc_id", each.alias("score"))


def _impact_of(tf):
    above, below = F.lit(1_000_000_000).cast("long") * tf, F.lit(1000).cast("long") * tf + F.lit(8).cast("long") * F.col("m")
    return ((above - above % below) / below).cast("long")  # exact: quotients are below 2^53


def _tier(j: int, index: DataFrame, left: DataFrame, docs: DataFrame, maps: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Results of the items that tier j proves, and the k-th best exact score known of every item."""
    asks = left.select("item", "term", "w", (F.col("w") * F.col(f"r{j}")).alias("residual"))
    all_left = asks.groupBy("item").agg(F.sum("residual").alias("unseen"))
    hits = table(asks.join(index, "term").groupBy("item", "doc").agg(F.sum(F.col("w") * F.col("impact")).alias("part"), F.sum("residual").alias("seen")))
    order = Window.partitionBy("item").orderBy(F.col("part").desc(), "doc")
    first = table(hits.withColumn("at", F.row_number().over(order)).where(f"at <= {k}").select("item", "doc"))
    floors = exact(first, docs, maps).where("score > 0").groupBy("item").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    floors = table(floors.where("floor IS NOT NULL"))
    state = all_left.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0)))
    # a document that was not found scores at most `unseen`
    proven = table(state.where("unseen = 0 OR unseen < floor"))
    able = table(hits.join(proven, "item").where("part + unseen - seen >= floor").select("item", "doc"))
    rows = best(exact(able, docs, maps).where("score > 0"), k)
    return table(rows.select("item", "rank", "doc_id", "score", F.lit(j).alias("tier"))), floors


def _last(left: DataFrame, floors: DataFrame, docs: DataFrame, v: int, k: int, tier: int) -> DataFrame:
    """Results of the items that are left: a pass over all documents, the best few rows of each task."""
    spark = docs.sparkSession
    rows = left.select("item", "term", "w").orderBy("item", "term").collect()  # within the block's bound
    known = {r.item: r.floor for r in floors.collect()}
    weights: dict[int, dict[int, int]] = {}
    for r in rows:
        weights.setdefault(r.item, {})[r.term] = r.w
    shared = spark.sparkContext.broadcast((weights, known))

    def run(batches):
        weights, known = shared.value
        items = list(weights)
        groups = []
        for a in range(0, len(items), ITEMS):
            mine = items[a : a + ITEMS]
            terms = sorted({t for i in mine for t in weights[i]})
            local = np.full(v, -1, np.int32)
            local[terms] = np.arange(len(terms))
            w = np.zeros((len(terms), len(mine)), np.int64)
            for c, i in enumerate(mine):
                for t, x in weights[i].items():
                    w[local[t], c] = x
            groups.append((mine, local, w, np.array([max(1, known.get(i, 1)) for i in mine], np.int64)))
        kept: dict[int, list] = {i: [] for i in items}
        for batch in batches:
            doc, doc_id, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 2))
            terms, tfs = batch.column(3), batch.column(4)
            size = np.asarray(terms.value_lengths())
            t, tf = (np.asarray(x.flatten()) for x in (terms, tfs))
            of = np.repeat(np.arange(len(doc)), size)
            score = 1_000_000_000 * tf // (1000 * tf + 8 * m[of])
            for mine, local, w, floor in groups:
                at = np.flatnonzero(local[t] >= 0)
                cuts = np.flatnonzero(np.diff(of[at], prepend=-1))  # where a document's entries start
                for a in range(0, len(cuts), DOCUMENTS):
                    lo, hi = cuts[a], cuts[a + DOCUMENTS] if a + DOCUMENTS < len(cuts) else len(at)
                    here = at[lo:hi]
                    sums = np.add.reduceat(score[here, None] * w[local[t[here]]], cuts[a : a + DOCUMENTS] - lo, axis=0)
                    for x, c in zip(*np.nonzero(sums >= floor), strict=True):
                        d = of[at[cuts[a + x]]]
                        kept[mine[c]].append((-int(sums[x, c]), int(doc_id[d]), int(doc[d])))
                    for c, i in enumerate(mine):
                        if len(kept[i]) > 8 * k:
                            kept[i] = sorted(kept[i])[:k]
                            floor[c] = -kept[i][-1][0]
        rows = [(i, d, doc_id, -s) for i, best in kept.items() for s, doc_id, d in sorted(best)[:k]]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["item", "doc", "doc_id", "score"]), pa.schema([("item", pa.int32()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]))

    if not weights:
        return spark.createDataFrame([], "item int, rank int, doc_id long, score long, tier int")
    found = docs.select("doc", "doc_id", "m", "terms", "tfs").mapInArrow(lean(run), "item int, doc long, doc_id long, score long")
    return best(found, k).select("item", "rank", "doc_id", "score", F.lit(tier).alias("tier"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


#: The same rows in DuckDB SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS doc,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
n AS (SELECT doc, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
p AS (SELECT doc, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT doc, unnest(t) AS term FROM n) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * CAST(docs AS DOUBLE) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term, docs),
s AS (
  SELECT item_id, doc, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (doc), g GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, doc) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
