"""Loops by slices and by a stream, against the definition."""

import random

from hearthline.operators import loops
from hearthline.streaming import live

LONGEST, TIMES = 4, 3


def by_definition(kinds):
    """(period, repeats, first, length, place of the alarm) of all maximal stretches, places from 1."""
    out = []
    for p in range(1, LONGEST + 1):
        a = 0
        while a + p < len(kinds):
            b = a + p
            while b < len(kinds) and kinds[b] == kinds[b - p]:
                b += 1
            block = kinds[a : a + p]
            whole = all(block != block[:q] * (p // q) for q in range(1, p) if p % q == 0)
            if b - a >= TIMES * p and whole:
                out.append((p, (b - a) // p, a + 1, b - a, a + TIMES * p))
            a = max(b - p + 1, a + 1)
    return sorted(out)


def made(seed):
    r = random.Random(seed)
    actors = {1: [r.choice("ab") for _ in range(300)], 2: ["x"] * 40, 3: list("abcabcabcab") + ["q"] + list("abab") * 4, 4: ["a"], 5: [None, None, None, "b", None, "b", None, "b"]}
    for k in range(6, 12):
        actors[k] = [c for _ in range(8) for c in r.choice(["ab", "c", "abc", "aabb"]) * r.randint(1, 5)]
    rows, at = [], 0
    for i in range(max(map(len, actors.values()))):
        for k, kinds in actors.items():
            if i < len(kinds):
                rows.append((at, at // 3, k, kinds[i]))
                at += 1
    return actors, rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string")
    return df.selectExpr("event_id", "timestamp_seconds(s) AS ts", "user_id", "event_type", "0.0D AS value", "'' AS props")


def wanted(actors, rows):
    ids = {k: [r[0] for r in rows if r[2] == k] for k in actors}
    return sorted((k, p, n, first, size, ids[k][alarm - 1]) for k, kinds in actors.items() for p, n, first, size, alarm in by_definition(kinds))


def test_slices_agree_with_the_definition(spark):
    for seed in (1, 2):
        actors, rows = made(seed)
        random.Random(seed).shuffle(rows)
        got = loops.loops(frame(spark, rows), "user_id", ["ts", "event_id"], "event_type", LONGEST, TIMES)
        want = wanted(actors, sorted(rows))
        assert sorted((r.user_id, r.period, r.repeats, r.first, r.length, r.alarm.event_id) for r in got.collect()) == want and len({w[1] for w in want}) == LONGEST


def test_one_actor_in_all_slices_and_edges(spark):
    r = random.Random(3)
    kinds = [c for _ in range(60) for c in r.choice(["ab", "c", "abc", "aabb", "cb"]) * r.randint(1, 6)] + ["z"] * 200
    rows = [(i, i, None, c) for i, c in enumerate(kinds)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 60)  # slices of fewer events than the longest loop
    try:
        got = loops.loops(frame(spark, rows), "user_id", ["ts", "event_id"], "event_type", LONGEST, TIMES).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert sorted((x.period, x.repeats, x.first, x.length, x.alarm.event_id + 1) for x in got) == by_definition(kinds)
    assert loops.loops(frame(spark, []), "user_id", ["ts", "event_id"], "event_type").collect() == []


def test_stream_gives_the_alarms_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        actors, rows = made(4)
        df = frame(spark, rows)
        src, out = str(tmp_path / "src"), str(tmp_path / "out")
        cuts = [0, len(rows) // 3, len(rows) // 2, len(rows)]
        for a, b in zip(cuts, cuts[1:]):
            df.where(f"event_id >= {a} AND event_id < {b}").coalesce(1).write.mode("append").parquet(src)
            live.run_available(live.loop_alarms(live.event_stream(spark, src, df), LONGEST, TIMES), out, str(tmp_path / "ck"))
        got = sorted((r.user_id, r.period, r.event_id) for r in spark.read.parquet(out).collect())
        assert got == sorted((k, p, alarm) for k, p, *_, alarm in wanted(actors, rows))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
