"""Queries over whole tables, on small tables with rows that an id filter would leave out."""

import random

import pytest

from hearthline.operators import graph
from hearthline.plans.registry import QUERIES


def run(spark, folder, name, table, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    return sorted(map(tuple, QUERIES[name](spark, str(folder)).collect()))


def test_components_of_all_orders(spark, tmp_path):
    orders = [(1, 7), (2, 7), (3, 8), (50, 7), (51, 9), (100, 10), (101, 8)]
    parts = {}
    for o, c in orders:
        parts.setdefault(f"c{c}", {f"c{c}"}).add(f"o{o}")
    got = run(spark, tmp_path, "connected_parts", "orders", orders, "o_orderkey long, o_custkey long")
    assert got == sorted((min(p), len(p)) for p in parts.values())


def test_layouts_of_all_base_keys(spark, tmp_path):
    lines = [(1, 2, 5.0), (1, 1, 7.0), (1, 2, 5.0), (9, 1, 3.0), (10, 1, 4.0), (11, 3, 6.0)]
    got = run(spark, tmp_path, "struct_layouts", "lineitem", lines, "l_orderkey long, l_linenumber int, l_quantity double")
    assert got == [(1, "1:7,2:5"), (9, "1:3"), (10, "1:4"), (11, "3:6")]


def test_payloads_of_all_events(spark, tmp_path):
    events = [(1, '{"k": 5}'), (2, "{broken"), (10, '{"k": 7}'), (13, "{}"), (20, '{"k": "x"}')]
    got = run(spark, tmp_path, "payload_parsed", "events", events, "event_id long, props string")
    assert got == [(1, 5, False), (2, None, True), (10, 7, False), (13, None, False), (20, None, True)]


def test_components_settle_or_raise(spark):
    names = [f"v{i:03}" for i in range(40)]
    random.Random(3).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [("x", "y")], "src string, dst string")
    got = {r.id: r.component for r in graph.components(edges).collect()}
    assert got == dict.fromkeys(names, "v000") | {"x": "x", "y": "x"}
    with pytest.raises(RuntimeError):
        graph.components(edges, rounds=1)
