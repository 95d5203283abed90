"""The vector index, builds without names, sketches, the keyed ledger and the stream join, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.operators import matching, sketches, vectors
from hearthline.sources import ledger
from hearthline.streaming import live


def brute(rows, queries, k):
    out = set()
    for q, w in queries:
        best = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, v in rows if i != q)[:k]
        out |= {(q, r, i, d) for r, (d, i) in enumerate(best, 1)}
    return out


def clustered(n, seed, dims=8):
    g = np.random.default_rng(seed)
    centres = g.integers(-200, 200, (12, dims))
    return [(i, [int(x) for x in centres[i % 12] + g.integers(-25, 25, dims)]) for i in range(n)]


def test_index_is_exact_with_hot_vectors_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_QUERIES", 7)
    rows = clustered(600, 1) + [(1000 + i, [5] * 8) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    queries = rows[::50] + [(-1, [900] * 8), (-2, [0] * 8)]
    found = vectors.nearest(vectors.indexed(df, cells=16), spark.createDataFrame(queries, "id long, v array<long>"), 5, probes=2)
    assert set(map(tuple, found.collect())) == brute(rows, queries, 5)


def test_recall_of_probes_alone(spark):
    rows = clustered(3000, 2)
    df = spark.createDataFrame(rows, "id long, v array<long>")
    index, queries = vectors.indexed(df, cells=32), rows[::50]
    asked = spark.createDataFrame(queries, "id long, v array<long>")
    exact, some = brute(rows, queries, 10), vectors.nearest(index, asked, 10, exact=False).collect()
    assert len({(r.query, r.id) for r in some} & {(q, i) for q, _, i, _ in exact}) >= 0.9 * len(exact)


def test_index_defined_cases(spark):
    schema = "id long, v array<long>"
    empty = spark.createDataFrame([], schema)
    some = spark.createDataFrame([(1, [0, 0]), (2, [3, 4]), (3, [1]), (4, None), (5, [1, None]), (None, [0, 0]), (6, [3, 4])], schema)
    assert vectors.nearest(vectors.indexed(empty), some, 3).collect() == []
    index = vectors.indexed(some)
    assert vectors.nearest(index, empty, 3).collect() == []
    assert sorted(map(tuple, vectors.nearest(index, some, 3).collect())) == [(1, 1, 2, 25), (1, 2, 6, 25), (2, 1, 6, 0), (2, 2, 1, 25), (6, 1, 2, 0), (6, 2, 1, 25)]
    with pytest.raises(Exception, match="components beyond"):
        vectors.indexed(spark.createDataFrame([(1, [vectors.LARGEST + 1])], schema))


def plain_colours(nodes, edges):
    colour = {n: ("", label) for n, label in nodes.items()}
    while True:
        key = {n: (c, tuple(sorted(str(colour[d]) for s, d in edges if s == n)), tuple(sorted(str(colour[s]) for s, d in edges if d == n))) for n, c in colour.items()}
        number = {k: i for i, k in enumerate(sorted(set(key.values()), key=str))}
        if len(number) == len(set(colour.values())):
            return key
        colour = {n: number[k] for n, k in key.items()}


def test_planted_renamings_are_found_and_ties_given(spark):
    r = random.Random(5)
    edges = {(r.randrange(40), r.randrange(40)) for _ in range(70)} | {(50, 51), (52, 53)}  # two equal pairs tie
    label = {0: "malloc", 1: "free"}
    names = list(range(54))
    r.shuffle(names)
    rename = {n: 1000 + m for n, m in enumerate(names)}
    nodes = [("a", n, label.get(n)) for n in range(54)] + [("b", rename[n], label.get(n)) for n in range(54)]
    calls = [("a", s, d) for s, d in edges] * 2 + [("b", rename[s], rename[d]) for s, d in edges]
    got = matching.matched(matching.refined(spark.createDataFrame(nodes, "build string, id long, label string"), spark.createDataFrame(calls, "build string, src long, dst long")), "a", "b").collect()
    key = plain_colours({n: label.get(n, "?") for n in range(54)}, edges)
    size = {n: list(key.values()).count(key[n]) for n in key}
    assert {x.id: (x.n_a, x.n_b, x.match) for x in got} == {n: (size[n], size[n], rename[n] if size[n] == 1 else None) for n in key}
    assert size[50] == 2 and sum(s == 1 for s in size.values()) > 20


def test_function_without_counterpart(spark):
    nodes = spark.createDataFrame([("a", 1, None), ("a", 2, None), ("a", 3, "x"), ("b", 7, None)], "build string, id long, label string")
    edges = spark.createDataFrame([("a", 1, 2), ("a", 1, 99)], "build string, src long, dst long")
    got = {tuple(r) for r in matching.matched(matching.refined(nodes, edges), "a", "b").collect()}
    assert got == {(1, 1, 0, None), (2, 1, 0, None), (3, 1, 0, None)}


def test_sketches_of_hours_over_any_span(spark):
    rows = spark.range(200_000).selectExpr("timestamp_seconds(id * 3) AS ts", "hash(id) % 20000 AS key", "CASE WHEN id % 1000 = 0 THEN NULL WHEN id % 1001 = 0 THEN double('nan') ELSE exp(rand(1) * 20) END AS value")
    rows = rows.cache()
    stored = sketches.by_hour(rows, "ts", "key", "value").cache()
    assert stored.count() == 167
    got = sketches.merged(stored.where("hour >= '1970-01-02' AND hour < '1970-01-05'"), F.lit(0), {"median": 0.5, "high": 0.99}).first()
    held = rows.where("ts >= '1970-01-02' AND ts < '1970-01-05'").agg(
        F.count(F.lit(1)).alias("n"), sketches.within(F.count_distinct("key"), F.lit(got["distinct"])).alias("d"),
        *[sketches.rank_within(F.when(~F.isnan("value"), F.col("value")), F.lit(got[c]), q).alias(c) for c, q in (("median", 0.5), ("high", 0.99))],
    ).first()
    assert got.n == held.n and held.d and held.median and held.high
    nothing = sketches.by_hour(spark.createDataFrame([("2024-01-01 00:00:00", None, None)], "ts string, key long, value double").withColumn("ts", F.to_timestamp("ts")), "ts", "key", "value")
    assert tuple(sketches.merged(nothing, F.lit(0), {"q": 0.5}).first()) == (0, 1, 0, None)


def test_ledger_replays_compaction_and_versions(spark, tmp_path):
    path, key, order = str(tmp_path / "ledger"), ["k"], ["seq"]
    r = random.Random(2)
    batches = [[(r.randrange(8) or None, 100 * b + i if r.random() < 0.8 else i, r.random()) for i in range(20)] for b in range(5)]
    frames = [spark.createDataFrame([(k, s * 100 + i, v) for i, (k, s, v) in enumerate(rows)], "k long, seq long, v double") for rows in batches]

    def plain(upto):
        best = {}
        for f in frames[: upto + 1]:
            for x in f.collect():
                best[x.k] = max(best.get(x.k, (-1,)), (x.seq, x.v))
        return {(k, *v) for k, v in best.items()}

    state = lambda v=None: set(map(tuple, ledger.as_of(spark, path, key, order, v).collect()))
    for i, f in enumerate(frames):
        ledger.upsert(f, i, path, key, order)
        if i in (1, 3):
            assert ledger.compact(spark, path, key, order) == i
        assert state() == plain(i)
    ledger.upsert(frames[4], 4, path, key, order)
    assert [state(v) for v in range(5)] == [plain(v) for v in range(5)] and ledger.versions(spark, path) == list(range(5))
    assert {x.batch for x in ledger.changes(spark, path, 2).collect()} == {3, 4}
    (tmp_path / "ledger" / "batch=9").mkdir()  # a job that was lost before it ended
    assert state() == plain(4)
    with pytest.raises(ValueError):
        ledger.as_of(spark, path, key, order, -1)


def rows_of(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long")
    return df.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id")


def test_feed_into_ledger(spark, tmp_path):
    src, path, ck = (str(tmp_path / x) for x in ("src", "ledger", "ck"))
    for part in ([(1, 10, 1), (2, 20, 2)], [(3, 15, 1), (4, 5, 2), (5, 50, 3)]):
        rows_of(spark, part).coalesce(1).write.mode("append").parquet(src)
        live.upserts(live.event_stream(spark, src, rows_of(spark, part)), path, ["user_id"], ["ts", "event_id"], ck)
    assert {(r.user_id, r.event_id) for r in ledger.as_of(spark, path, ["user_id"], ["ts", "event_id"]).collect()} == {(1, 3), (2, 2), (3, 5)}
    assert ledger.versions(spark, path) == [0, 1]


def test_stream_join_agrees_with_batch(spark, tmp_path):
    r = random.Random(4)
    left = [(i, 60 * i + r.randrange(50), r.randrange(4)) for i in range(120)]
    right = [(1000 + i, 60 * i + r.randrange(50), r.randrange(4)) for i in range(120)]
    conf = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for name, rows in (("l", left), ("r", right)):
            for k in range(4):  # a few rows come a batch late, and some come twice
                at = lambda i: min(3, i // 30 + (i % 30 > 20 and i % 10 == 3))
                part = [x for i, x in enumerate(rows) if at(i) == k or (i % 30 > 25 and at(i) == k - 1)] + rows[30 * k : 30 * k + 3]
                rows_of(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            for k, at in enumerate((100_000, 200_000)):  # time goes on, so that what waits is given
                rows_of(spark, [(9000 + k, at, 99)]).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        feeds = [live.event_stream(spark, str(tmp_path / n), rows_of(spark, left), 1) for n in ("l", "r")]
        live.run_available(live.followed_live(*feeds, "user_id", "5 minutes", "40 minutes"), str(tmp_path / "out"), str(tmp_path / "ck"))
    finally:
        spark.conf.unset(conf)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).where("user_id < 99").collect()))
    batch = live.followed(rows_of(spark, left), rows_of(spark, right), "user_id", "5 minutes")
    assert got == sorted(map(str, batch.collect())) and any("next_id=None" in g for g in got)


def test_shuffles_grow_with_the_graph(spark, monkeypatch):
    """A graph of more edges is refined in more partitions, to the same colours, and the session is left as it was."""
    nodes = spark.range(400).selectExpr("'a' AS build", "CAST(id AS STRING) AS id", "CAST(NULL AS STRING) AS label")
    edges = spark.range(1, 400).selectExpr("'a' AS build", "CAST(id AS STRING) AS src", "CAST(id div 3 AS STRING) AS dst")
    want = sorted(map(tuple, matching.refined(nodes, edges).collect()))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        monkeypatch.setattr(matching, "EDGES_A_TASK", 40)
        got = matching.refined(nodes, edges)
        assert got.rdd.getNumPartitions() == 10 and sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
