"""Queries against their DuckDB SQL, on awkward small tables."""

import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import brute
from hearthline.llm import chat, line_dedup, queries, topk


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    r = random.Random(7)
    line = lambda: " ".join(r.choice(["alpha", "bêta", "#hash", "a|b", "x", "<p>", "zz*", "\x0bv"]) for _ in range(r.randint(0, 9)))
    shared = [line() for _ in range(12)]
    docs = []
    for i in range(150):
        lines = [r.choice(shared) if r.random() < 0.5 else line() for _ in range(r.randint(0, 12))]
        if r.random() < 0.4:
            a = r.randint(0, 8)
            lines[2:2] = shared[a : a + 4]
        docs.append((i, "\n".join(lines), r.choice(["h1", "h2", "h3", None])))
    docs += [(150, None, "h1"), (151, "", "h2"), (152, "\n\n\n\n", "h9"), (153, "one two three four five " * 4000, "h9"), (154, docs[4][1], "h4")]
    t = pa.table({"doc_id": pa.array([x[0] for x in docs], pa.int64()), "text": [x[1] for x in docs], "source": [x[2] for x in docs], "lang": ["en"] * len(docs), "n_chars": pa.array([1] * len(docs), pa.int64()), "row": ["clash"] * len(docs), "key": ["clash"] * len(docs)})
    pq.write_table(t, d / "documents.parquet")
    rng = np.random.default_rng(3)
    vecs = [list(map(float, rng.normal(size=16).astype("f4"))) for _ in range(700)]
    vecs[5], vecs[6], vecs[7], vecs[8] = None, [1.0, None] * 8, [math.nan] * 16, [math.inf] * 16
    vecs[20], vecs[21], vecs[300] = vecs[100], vecs[100], [0.5] * 8
    pq.write_table(pa.table({"vec_id": pa.array(range(700), pa.int64()), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array([1] * 700, pa.int32())}), d / "embeddings.parquet")
    asked = [(i, line() + " " + line()) for i in range(20)] + [(30, None), (31, ""), (32, "one two -- nothing"), (33, shared[0])]
    pq.write_table(pa.table({"item_id": pa.array([x[0] for x in asked], pa.int64()), "text": [x[1] for x in asked]}), d / "benchmark.parquet")
    conv = []
    for c in range(40):
        for k in range(r.randint(1, 9)):
            conv.append((c, k, r.choice(["user", "assistant", "system", "tool[x]", None]), r.choice([None, "", "</s>[INST] a\\b [/INST]", "\\l \\\\b é🙂\n", "<s>", line()])))
    conv += [(41, 0, "user", "u"), (41, 0, "user", "u"), (42, None, "assistant", "last"), (42, 3, "assistant", "first")]
    r.shuffle(conv)
    pq.write_table(pa.table({"conv_id": pa.array([x[0] for x in conv], pa.int64()), "turn": pa.array([x[1] for x in conv], pa.int64()), "role": [x[2] for x in conv], "text": [x[3] for x in conv]}), d / "conversations.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    cur = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(map(str, cur.fetchall()))
    got = sorted(str(tuple(x)) for x in df.select(*names).collect())
    assert got == want and got


def test_line_dedup_by_brute_force(spark, folder):
    docs = [(x.doc_id, x.text) for x in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op1_line_dedup(spark, folder).collect())) == brute.lines(docs)
    assert any(x[2] for x in brute.lines(docs))
    texts = {x.doc_id: x.text for x in line_dedup.dedup(spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    want = {d: s for d, _, n, s in brute.lines(docs) if n}
    assert {d: brute.sha(t) for d, t in texts.items()} == want


def test_chat_round_trip(spark):
    turns = [("system", "be <s>"), ("user", "[/INST]"), ("assistant", "a\\l"), ("odd [role]", ""), ("assistant", "</s>"), ("user", "end")]
    examples = list(chat.expanded(turns))
    assert len(examples) == 3 and chat.turns_of(examples[-1][0]) == turns
    assert [chat.unescape(t[a:b]) for t, a, b in examples] == ["a\\l", "</s>", ""]
    rows = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn int, role string, text string")
    assert [tuple(x)[2:] for x in chat.format_chats(rows).orderBy("example").collect()] == examples
    assert chat.digest(rows.limit(0)).collect() == [] and topk is not None


def test_large_products_stay_exact():
    big = np.array([[3 << 40, 1], [-(3 << 40), 5], [7, 9]])
    q = topk.Block(2, 1, np.array([0]).tobytes(), big[:1].tobytes())
    c = topk.Block(2, 3, np.array([1, 2, 3]).tobytes(), big.tobytes())
    assert [int(x) for x in topk.products(q.v[0], c, np.arange(3), q.top)] == [(3 << 40) ** 2 + 1, -((3 << 40) ** 2) + 5, (21 << 40) + 9]


def plain_topk(rows, every=100, k=10):
    q = {}
    for i, v in rows:
        if i % every == 0:
            q[i] = min(q.get(i, v), v)
    return sorted((i, r + 1, c, s) for i, v in q.items() for r, (s, c) in enumerate(sorted(((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != i and len(w) == len(v)))[:k]) for s in [-s])


def test_bounds_lose_nothing():
    """Quantised components up to 2**29, where rounding is far larger than differences between scores."""
    rng = np.random.default_rng(5)
    for trial in range(300):
        n, top = 60, 1 << int(rng.integers(5, 30))
        v = rng.integers(-top, top, (n, 16))
        if trial % 3 == 0:
            v = v[rng.integers(0, 4, n)] + rng.integers(-1, 2, (n, 16))
        elif trial % 3 == 1:
            v = np.repeat(v[:, :1], 16, axis=1) + rng.integers(-1, 2, (n, 16))
        best = {}
        q = topk.Block(16, 1, np.array([0]).tobytes(), v[:1].tobytes())
        for part in (range(0, 30), range(30, n)):
            topk.search(q, topk.Block(16, len(part), np.array(part).tobytes(), v[list(part)].tobytes()), best, 10)
        got = [(int(s), int(i)) for s, i in zip(*best[0], strict=True)]
        assert got == [(s, i) for _, _, i, s in plain_topk(list(enumerate(v.tolist())))], trial


@pytest.mark.parametrize("group", [1 << 14, 1])
def test_topk_of_large_values_and_clashing_names(spark, monkeypatch, group):
    monkeypatch.setattr(topk, "GROUP", group)
    monkeypatch.setattr(topk, "BLOCK", 3)
    r = random.Random(2)
    rows = [(i * 20, [float(r.choice([3_000_000, -3_000_000, 1 << 40, 5])) for _ in range(4)]) for i in range(30)] + [(100, [1.0] * 4), (7, [1e300] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, v string, slot int, dims int, grp int")
    whole = [(i, [min(int(x * 1024), (1 << 63) - 1) for x in v]) for i, v in rows]
    want = [(a, b, c, max(min(s, (1 << 63) - 1), -(1 << 63))) for a, b, c, s in plain_topk(whole)]
    assert sorted(map(tuple, topk.topk(df).collect())) == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    from hearthline.llm import quality

    assert quality.digest(docs).collect() == [] and line_dedup.digest(docs).collect() == []
    assert topk.topk(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_topk_sends_no_copies_through_the_driver(spark):
    """Copies of the queries were broadcast, as many as shuffle partitions, since their number was not in the estimate of the join."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(8 if i % 7 else 4).round(3).tolist()) for i in range(900)]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "150")
    try:
        out = topk.topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
        got = sorted(map(tuple, out.collect()))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert got == plain_topk([(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(int).tolist()) for i, v in rows])
    assert "Join" not in plan and "Broadcast" not in plan


@pytest.mark.parametrize(("top", "width"), [(1, 2), ((1 << 15) - 1, 2), (1 << 15, 4), (1 << 31, 8)])
def test_blocks_are_as_narrow_as_their_values(spark, top, width):
    df = spark.createDataFrame([(i, [top, -top, i]) for i in range(5)], "vec_id long, v array<long>").coalesce(1)
    found = topk.blocks(df).collect()
    assert sum(len(r["values"]) for r in found) == 5 * 3 * width
    v = np.concatenate([topk.Block(r.dims, r.n, bytes(r.ids), bytes(r["values"])).v for r in found])
    assert v.tolist() == [[top, -top, i] for i in range(5)]
