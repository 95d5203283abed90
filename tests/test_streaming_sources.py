import os

import pytest
from pyspark.sql import functions as F

from hearthline.operators import graph, state, time
from hearthline.sources import tables
from hearthline.streaming import live


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 7 % 600 AS INT), 0)").alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.expr("element_at(array('click', 'error', 'view'), CAST(id % 3 AS INT) + 1)").alias("event_type"),
        (F.col("id") % 13).cast("double").alias("value"), F.concat(F.lit('{"k": '), "id", F.lit("}")).alias("props"),
    )
    return rows.cache()


def test_stream_agrees_with_batch(spark, events, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    events.orderBy("ts").coalesce(1).write.parquet(src)
    live.run_available(live.health(live.event_stream(spark, src, events), "1 hour", "10 minutes", ["event_type"]), out, ck)
    late = spark.range(1).select(F.lit(9999).cast("long").alias("event_id"), F.expr("timestamp_ntz '2024-01-03 00:00:00'").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    late.write.mode("append").parquet(src)
    live.run_available(live.health(live.event_stream(spark, src, events), "1 hour", "10 minutes", ["event_type"]), out, ck)
    got = sorted(map(str, spark.read.parquet(out).collect()))
    assert got == sorted(map(str, time.windowed(events, "1 hour", by=["event_type"]).collect())) and got


def test_push_and_dedup(spark, events, tmp_path):
    src = str(tmp_path / "src")
    events.union(events.limit(50)).coalesce(1).write.parquet(src)
    seen = []
    live.push(live.once_each(live.event_stream(spark, src, events), "event_id", "30 days"), lambda b, i: seen.append(b.count()), str(tmp_path / "ck"))
    assert sum(seen) == 400
    q = live.session_counts(live.event_stream(spark, src, events), "user_id", "5 minutes", "1 hour")
    live.run_available(q, str(tmp_path / "out"), str(tmp_path / "ck2"))
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["user_id", "start", "end", "n"]


def test_streaks_over_micro_batches(spark, events, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        kinds = [(1, "error"), (2, "error"), (1, "error"), (1, "view"), (1, "error"), (2, "error"), (1, "error"), (1, "error"), (2, "click")]
        rows = [(i, i, u, k) for i, (u, k) in enumerate(kinds)]
        df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string")
        df = df.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "0.0D AS value", "'' AS props")
        src, out = str(tmp_path / "src"), str(tmp_path / "out")
        for part in ("event_id < 5", "event_id >= 5"):
            df.where(part).coalesce(1).write.mode("append").parquet(src)
            live.run_available(live.streak_alarms(live.event_stream(spark, src, df), 3), out, str(tmp_path / "ck"))
        assert [tuple(r) for r in spark.read.parquet(out).collect()] == [(1, 7)]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_event_log(spark, events, tmp_path):
    path = str(tmp_path / "log")
    tables.write_event_log(events.limit(5), path)
    tables.write_event_log(events.where("event_id = 7"), path)
    with open(os.path.join(path, "bad.json"), "w") as f:
        f.write('{"event_id": "x\n')
    rows = tables.event_log(spark, path).collect()
    assert len(rows) == 7 and sum(r._corrupt is not None for r in rows) == 1


def test_install_and_rebuild(spark, events, tmp_path):
    path = str(tmp_path / "t")
    tables.write_once(events.limit(3), path, "event_type")
    tables.write_once(events.limit(9), path)
    assert spark.read.parquet(path).count() == 3
    tables.rebuild(events.limit(9), path)
    assert spark.read.parquet(path).count() == 9


def test_binaries(spark, tmp_path):
    from hearthline.operators.corpus import paired

    for n in ("a", "a_symbols", "b"):
        (tmp_path / n).write_bytes(b"x")
    got = paired(tables.binaries(spark, str(tmp_path))).collect()
    assert [r.stem for r in got] == ["a"] and got[0].truth.endswith("a_symbols")


def test_graph_cycles_and_components(spark):
    e = spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "a", "t"), ("x", "y", "t"), ("z", "z", "t")], "src string, dst string, type string")
    roots = spark.createDataFrame([("a",)], "id string")
    assert {(r.id, r.depth) for r in graph.reachable(e, roots, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.id, r.component) for r in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("z", "z")}
    chain = spark.range(60).selectExpr("format_string('n%03d', id) AS src", "format_string('n%03d', id + 1) AS dst", "'t' AS type")
    assert {r.component for r in graph.components(chain).collect()} == {"n000"}


def test_keyset_pages_cover_the_log(spark, events):
    last, n = -1, 0
    while page := state.after(events, "event_id", last, 150).collect():
        n, last = n + len(page), page[-1].event_id
    assert n == 400
    plan = state.after(events, "event_id", 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan
