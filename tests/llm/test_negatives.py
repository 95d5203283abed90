import numpy as np
import pytest

from hearthline.llm import negatives, vantage


def brute(rows, every=100, k=5):
    """rows: (vec_id, label, v)."""
    rows = [(i, (c + 1) % 10 if i % 7 == 0 else c, v) for i, c, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    anchors = {}
    for i, c, v in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    for a, (label, v) in anchors.items():
        s = sorted((-dot(v, w), i, c) for i, c, w in rows if i != a and len(w) == len(v))
        for ps, p, _ in [x for x in s if x[2] == label][:k]:
            neg = [x for x in s if x[2] != label and 80 * -ps <= 100 * -x[0] <= 100 * -ps]
            out += [(a, p, r, n, -ps, -ns) for r, (ns, n, _) in enumerate(neg[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) / 256 for x in v] if v is not None else None, c, 1, 2, "x") for i, c, v in rows], "vec_id long, embedding array<double>, label int, leaf int, rank int, V_ string")


def got(df):
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def cloud(n, dims, seed, groups=6):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 60, (groups, dims))
    x = (centres[r.integers(0, groups, n)] + r.normal(0, 25, (n, dims))).astype(int)
    return [(i, int(r.integers(0, 10)), x[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 14, 150])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ASKS", 3)
    monkeypatch.setattr(vantage, "LEAF", 16)
    rows = cloud(900, 6, 1)
    rows += [(2000 + i, 3, rows[0][2]) for i in range(300)]  # a hot vector, and ties
    rows += [(3000 + 100 * i, i, [5, 5]) for i in range(4)] + [(4000 + i, i % 10, [3 + i % 4, 4]) for i in range(40)]  # another length
    want = brute(rows)
    assert len(want) > 200
    assert got(negatives.hard_negatives(frame(spark, rows))) == want


def test_defined_cases(spark):
    assert negatives.hard_negatives(frame(spark, [])).collect() == []
    base = [(i, i % 3, [i % 5, 1 + i % 4]) for i in range(60)]
    odd = [(None, 1, [1, 1]), (101, None, [1, 1]), (102, 1, None), (103, 1, [float("nan"), 1.0]), (104, 1, [float("inf"), 1.0])]
    repeated = [(0, 0, [0, 1]), (0, 0, [0, 1]), (30, 0, [4, 3]), (30, 0, [4, 3])] + [(50, 1, [9, 9])] * 9
    df = frame(spark, base + odd + repeated).union(frame(spark, []).union(spark.sql("SELECT 7L, array(CAST(NULL AS DOUBLE), 1D), 1, 1, 2, 'x'")))
    assert got(negatives.hard_negatives(df)) == brute(base + repeated)
    huge = [(100 * i, i % 2, [(-1) ** i * 2**40 * (i + 1), 2**41]) for i in range(8)] + [(i, i % 4, [2**40 + i, 2**42]) for i in range(1, 30)]
    assert got(negatives.hard_negatives(frame(spark, huge))) == [(*x[:4], min(x[4], negatives.LONG), min(x[5], negatives.LONG)) for x in brute(huge)]


def test_a_tree_looks_at_few_rows_where_vectors_lie_apart():
    r = np.random.default_rng(3)
    centres = r.normal(0, 400, (64, 16))
    centres *= 1600 / np.linalg.norm(centres, axis=1, keepdims=True)
    x = (np.repeat(centres, 128, axis=0) + r.normal(0, 4, (8192, 16))).astype(np.int64)
    tree = vantage.VpTree.unpacked(vantage.VpTree.build(np.arange(8192), r.integers(0, 10, 8192), x).packed())
    looked = 0
    for i in range(0, 8192, 512):
        q = x[i]
        ask = tree.asked(q)
        s = x @ q
        order = np.lexsort((np.arange(8192), -s))
        assert ask.nearest(5, np.ones(8192, bool)) == [(int(s[j]), int(j)) for j in order[:5]]
        inside = [j for j in order if s[order[40]] * 0.8 <= s[j] <= s[order[40]]]
        assert ask.nearest(5, np.ones(8192, bool), -(-80 * int(s[order[40]]) // 100), int(s[order[40]])) == [(int(s[j]), int(j)) for j in inside[:5]]
        looked += ask.rows
    assert looked < 16 * 8192 * 0.1
