"""One key with all rows, and values with a heavy tail."""

import random

from pyspark.sql import functions as F

from hearthline.operators import evaluation, time


def test_as_of_of_one_hot_key(spark):
    r = random.Random(1)
    left = [(i, "hot" if r.random() < 0.9 else r.choice("ab"), r.randrange(300)) for i in range(1500)] + [(9000, None, 5), (9001, "none", 5)]
    right = [("hot", t, t * 10) for t in r.sample(range(300), 25)] + [("a", 7, 1), (None, 3, 4), ("b", 290, None)]
    fl = spark.createDataFrame(left, "id int, k string, t int")
    fr = spark.createDataFrame(right, "k string, t int, v int")
    out = time.as_of(fl, fr, "k", "t", "v")
    got = {x.id: x.last_v for x in out.collect()}
    want = {i: max(((t, v) for c, t, v in right if c == k and t <= at and v is not None), default=(0, None))[1] for i, k, at in left}
    assert got == want
    sliced = fl.where("k = 'hot'").repartitionByRange(4, "k", "t").groupBy(F.spark_partition_id()).count().collect()
    assert len(sliced) == 4 and max(x["count"] for x in sliced) < 700  # the range that as_of deals by splits the key


def test_quantiles_of_a_heavy_tail(spark):
    r = random.Random(2)
    rows = [("g", r.random()) for _ in range(5000)] + [("g", 1e18), ("h", 3.0), ("h", 4.0), ("n", None)] + [("t", float(int(r.random() ** 4 * 50))) for _ in range(2000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x.g: (x.m, x.p) for x in evaluation.quantiles(df, "g", "v", {"m": 0.5, "p": 0.9}).collect()}

    def q(xs, p):
        xs = sorted(xs)
        at = (len(xs) - 1) * p
        lo = int(at)
        return xs[lo] + (xs[min(lo + 1, len(xs) - 1)] - xs[lo]) * (at - lo)

    for g in "ght":
        xs = [v for k, v in rows if k == g]
        assert abs(got[g][0] - q(xs, 0.5)) < 1e-9 and abs(got[g][1] - q(xs, 0.9)) < 1e-9
    some = df.where("g = 'g'")
    cuts = some.agg(F.percentile_approx("v", [k / 64 for k in range(1, 64)], 256).alias("c")).first().c
    sizes = {}
    for _, v in rows[:5001]:
        b = sum(c < v for c in cuts)
        sizes[b] = sizes.get(b, 0) + 1
    assert max(sizes.values()) < 5001 / 16
