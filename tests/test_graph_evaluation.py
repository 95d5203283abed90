"""Graph and evaluation operators against plain Python."""

import json
import random
import statistics

import pytest

from hearthline.operators import evaluation, graph
from hearthline.sources import tables


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def closure(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: {n} for n in nodes}
    while True:
        before = sum(map(len, reach.values()))
        for a, b in edges:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
        if sum(map(len, reach.values())) == before:
            return reach


def test_strong_components(spark):
    r = random.Random(1)
    for n, m in ((8, 12), (14, 20)):
        edges = list({(f"n{r.randrange(n):02}", f"n{r.randrange(n):02}") for _ in range(m)})
        reach = closure(edges)
        want = {a: min(b for b in reach if b in reach[a] and a in reach[b]) for a in reach}
        assert {x.id: x.component for x in graph.strong_components(frame(spark, edges)).collect()} == want


def test_topological_depth(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("x", "d")]
    assert {x.id: x.depth for x in graph.topological_depth(frame(spark, edges)).collect()} == {"a": 0, "x": 0, "b": 1, "c": 2, "d": 3}
    with pytest.raises(RuntimeError, match="cycle"):
        graph.topological_depth(frame(spark, [("a", "b"), ("b", "c"), ("c", "b")]))


def test_reachable_in_a_cycle(spark):
    got = graph.reachable(frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]), spark.createDataFrame([("a",)], "id string"), 9)
    assert {x.id: x.depth for x in got.collect()} == {"a": 0, "b": 1, "c": 2, "d": 3}


@pytest.mark.parametrize("buckets", [1, 7, 1024])
def test_quantiles(spark, buckets):
    r = random.Random(2)
    rows = [(g, r.choice([r.gauss(0, 5), float(r.randrange(4))])) for g in ("a", "b", None) for _ in range(101)] + [("c", 4.0), ("c", None), ("d", 1.0), ("d", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.q1, x.median) for x in evaluation.quantiles(df, "g", "v", {"q1": 0.25, "median": 0.5}, buckets).collect()}
    assert set(got) == {"a", "b", None, "c", "d"}
    for g, (q1, median) in got.items():
        v = sorted(x for h, x in rows if h == g and x is not None)
        assert median == pytest.approx(statistics.median(v)) and q1 == pytest.approx(statistics.quantiles(v, n=4, method="inclusive")[0] if len(v) > 1 else v[0])


def test_metrics(spark):
    truth = spark.createDataFrame([(1, "x", 1), (2, "x", 0), (3, "x", 1), (4, "y", 1)], "k int, g string, v int")
    guess = spark.createDataFrame([(1, "x", 1), (2, "x", 1), (9, "x", 1), (4, "y", 1)], "k int, g string, v int")
    got = {r.g: tuple(r)[1:] for r in evaluation.metrics(truth, guess, ["k"], "v", ["g"]).collect()}
    assert got["y"] == (1, 1.0, 1.0, 1.0, 1)
    assert got["x"] == (3, pytest.approx(2 / 3), pytest.approx(1 / 3), pytest.approx(1 / 3), 0)


def test_ground_truth_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"binary": "a", "functions": [{"name": "f", "address": 16, "type": "int"}, {"name": "g", "address": 32, "type": None}]}, indent=1))
    (tmp_path / "b.json").write_text("{ broken")
    (tmp_path / "c.json").write_text(json.dumps({"binary": "c", "functions": []}))
    rows = tables.ground_truth(spark, str(tmp_path)).collect()
    assert {(r.binary, r.name, r.address, r.type) for r in rows if r.corrupt is None} == {("a", "f", 16, "int"), ("a", "g", 32, None)}
    assert [r.corrupt for r in rows if r.corrupt] == ["{ broken"]
