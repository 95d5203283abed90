"""Interval joins by dyadic blocks, against all pairs."""

import random

from hearthline.operators import time


def spans(r, n, prefix):
    out = []
    for i in range(n):
        lo = r.choice([r.randrange(-50, 50), r.randrange(-(10**9), 10**9)])
        out.append((f"{prefix}{i}", lo, lo + r.choice([0, -3, 1, 2, 7, 64, 1000, 10**9, 2**40])))
    return [*out, (f"{prefix}n", None, 5), (f"{prefix}m", 0, 1), (f"{prefix}m", 0, 1), (f"{prefix}w", -(2**61), 2**61)]


def test_overlaps_and_points(spark):
    r = random.Random(3)
    a, b = spans(r, 90, "a"), spans(r, 80, "b")
    fa, fb = spark.createDataFrame(a, "a string, alo long, ahi long"), spark.createDataFrame(b, "b string, blo long, bhi long")
    got = sorted((x.a, x.b) for x in time.overlaps(fa, fb, "alo", "ahi", "blo", "bhi").collect())
    ok = lambda s: s[1] is not None and s[1] < s[2]
    assert got == sorted((x[0], y[0]) for x in a for y in b if ok(x) and ok(y) and x[1] < y[2] and y[1] < x[2])
    points = [(f"p{i}", r.choice([r.randrange(-60, 60), r.randrange(-(10**9), 10**9)])) for i in range(60)] + [("p0", 0), ("q", None)]
    fp = spark.createDataFrame(points, "p string, at long")
    got = sorted((x.p, x.a) for x in time.points_in(fp, fa, "at", "alo", "ahi").collect())
    assert got == sorted((p, x[0]) for p, t in points if t is not None for x in a if ok(x) and x[1] <= t < x[2])


def test_a_span_costs_the_logarithm_of_its_length(spark):
    rows = spark.createDataFrame([(1, 5, 6), (2, -(2**40) + 1, 2**40 - 1), (3, 0, 2**30), (4, 7, 7)], "id int, lo long, hi long")
    blocks = {}
    for x in time.dyadic(rows, "lo", "hi").collect():
        blocks.setdefault(x.id, []).append((x._block << x._level, (x._block + 1) << x._level))
    assert len(blocks[1]) == 1 and len(blocks[3]) == 1 and len(blocks[2]) <= 84 and 4 not in blocks
    for i, lo, hi in ((1, 5, 6), (2, -(2**40) + 1, 2**40 - 1), (3, 0, 2**30)):
        parts = sorted(blocks[i])
        assert parts[0][0] == lo and parts[-1][1] == hi and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))


def test_overlaps_are_counted_without_pairs(spark):
    r = random.Random(4)
    a, b = spans(r, 90, "a"), [(*s, i) for i, s in enumerate(spans(r, 80, "b"))]
    fa, fb = spark.createDataFrame(a, "a string, alo long, ahi long"), spark.createDataFrame(b, "b string, blo long, bhi long, i long")
    ok = lambda s: s[1] is not None and s[1] < s[2]
    met = [(x, [y[3] for y in b if ok(x) and ok(y) and x[1] < y[2] and y[1] < x[2]]) for x in a]
    got = sorted(map(tuple, time.overlap_counts(fa, fb, "alo", "ahi", "blo", "bhi", "i").collect()))
    assert got == sorted((*x, len(y), min(y)) for x, y in met if y)


def test_spans_that_all_overlap_cost_no_pairs(spark):
    n = 100_000  # 10,000,000,000 pairs
    fa = spark.range(n).selectExpr("id AS a", "id % 7 AS alo", "100 + id % 3 AS ahi")
    fb = spark.range(n).selectExpr("id + 5 AS b", "id % 11 AS blo", "90 + id % 2 AS bhi")
    got = time.overlap_counts(fa, fb, "alo", "ahi", "blo", "bhi", "b").selectExpr("count(*)", "min(n)", "max(n)", "max(first)").first()
    assert tuple(got) == (n, n, n, 5)
