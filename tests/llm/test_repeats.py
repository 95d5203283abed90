import random

import pytest

import brute
from hearthline.llm import line_dedup, repeats, substring_dedup, suffix_dedup


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(300)]
    make = lambda k: [r.choice(vocab) for _ in range(k)]
    passages = [make(r.randint(45, 130)) for _ in range(6)]
    docs = []
    for d in range(n):
        w = make(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            p = list(r.choice(passages))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edit"
            w += p + make(r.randint(0, 30))
        docs.append((d, r.choice([" ", "\n", "  \t"]).join(w)))
    docs += [(n, docs[3][1]), (n + 1, None), (n + 2, ""), (n + 3, "la " * 400), (n + 4, "x" + "la " * 300), (n + 5, docs[5][1] + " " + docs[6][1])]
    docs += [(n + 6, "a b " * 300), (n + 7, "Z" * 900), (n + 8, "Z" * 450 + "q")]
    r.shuffle(docs)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, key string, n int")


@pytest.mark.parametrize("rows", [20_000, 3])
def test_substring(spark, monkeypatch, rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", rows)
    docs = corpus()
    got = sorted(map(tuple, substring_dedup.digest(frame(spark, docs)).collect()))
    assert got == brute.substring(docs)


@pytest.mark.parametrize("rows", [20_000, 3])
def test_suffix(spark, monkeypatch, rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", rows)
    docs = corpus(2)
    got = sorted(map(tuple, suffix_dedup.digest(frame(spark, docs)).collect()))
    assert got == brute.suffix(docs)


@pytest.mark.parametrize("size", [1, 7])
def test_small_batches(spark, size):
    """Groups that go over the ends of batches, and equal strings in several batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        docs = corpus(3, 30)
        assert sorted(map(tuple, substring_dedup.digest(frame(spark, docs)).collect())) == brute.substring(docs)
        assert sorted(map(tuple, suffix_dedup.digest(frame(spark, docs[:20])).collect())) == brute.suffix(docs[:20])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_sampled_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 20)
    docs = corpus(6)
    assert sorted(map(tuple, suffix_dedup.digest(frame(spark, docs)).collect())) == brute.suffix(docs)


def test_multikey_sorts():
    r = random.Random(1)
    parts = [bytes(r.choice([0, 0, 97, 98]) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    s = repeats.Strings(parts)
    order, seg = repeats.multikey(s.whole, len(parts), 5)
    assert [parts[i] for i in order] == sorted(parts, key=lambda p: (len(p), p))
    same = [parts[a] == parts[b] for a, b in zip(order, order[1:])]
    assert same == (seg[1:] == seg[:-1]).tolist()


def test_negative_large_and_repeated_ids(spark):
    text = " ".join(f"word{i}" for i in range(72))
    big = 1 << 62
    for ids in ((-1, -1, 0), (9, 9, 10), (-big, -big, big), (big, big, big + 5)):
        docs = [(ids[0], "zz " + text), (ids[1], text), (ids[2], text + " q")]
        got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digest(frame(spark, docs)).collect())
        assert got == [(ids[0], 72, 0), (ids[0], 73, 0), (ids[2], 73, 72)]
        rows = suffix_dedup.digest(frame(spark, docs)).collect()
        n = len(text.encode())
        assert sum(r.n_removed for r in rows) == 2 * n
        lines = line_dedup.digest(frame(spark, [(d, t.replace(" ", "\n")) for d, t in docs])).collect()
        assert sorted((r.doc_id, r.n_removed) for r in lines)[2] == (ids[2], 72) and sum(r.n_removed for r in lines) == 144


def test_texts_over_one_piece(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 61)
    for f, op, want in ((repeats, substring_dedup, brute.substring), (repeats, suffix_dedup, brute.suffix)):
        monkeypatch.setattr(op, "piecewise", lambda *a: f.piecewise(*a, piece=61))
        docs = corpus(5, 25)
        assert sorted(map(tuple, op.digest(frame(spark, docs)).collect())) == want(docs)


def test_edges(spark):
    for op, width in ((substring_dedup, 4), (suffix_dedup, 5)):
        assert op.digest(frame(spark, [])).collect() == []
        text = " ".join(f"word{i}" for i in range(80))
        rows = op.digest(frame(spark, [(None, text), (1, text), (1, text), (2, None), (3, text), (4, text), (4, text + " end")])).collect()
        assert len(rows) == 7 and all(len(r) == width for r in rows)
        by = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in rows)
        assert by[0] == (-1, 0) and by[1] == by[2] == (1, 0) and by[3] == (2, 0) and by[4][1] > 0 and by[5][1] > 0


def test_texts(spark):
    docs = corpus(4)
    got = {r.doc_id: r.text for r in substring_dedup.dedup(frame(spark, docs)).collect()}
    want = {d: (n, s) for d, _, n, s in brute.substring(docs)}
    assert got and all(brute.sha(t) == want[d][1] for d, t in got.items()) and set(got) == {d for d, (n, _) in want.items() if n}


def test_pieces_of_long_texts_give_the_same_windows():
    import numpy as np

    from hearthline.llm.repeats import Powers, piecewise

    t = np.random.default_rng(1).integers(0, 1 << 60, 700, np.uint64)
    for piece in (1 << 20, 97, 1):
        starts = [a + int(x) + i for a, _, start, n, _ in piecewise(len(t), lambda a, b: t[a:b], 50, 8, Powers(), piece) for x, k in zip(start, n) for i in range(k)]
        assert starts == list(range(651))
    assert list(piecewise(49, lambda a, b: t[a:b], 50, 8, Powers())) == []


@pytest.mark.parametrize("rows", [20_000, 1])
def test_suffixes_that_repeat_within_one_run(spark, monkeypatch, rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", rows)
    lone = {"ab" * 60: 118, "Z" * 299: 298, "Y" * 100: 0, "xyz" * 66: 195}
    lone |= {c * k: k - 1 for c, k in zip("ABCDEFG", (101, 150, 199, 299, 399, 400, 1099))}
    for text, n in lone.items():
        assert brute.suffix([(1, text)])[0][2] == n
    docs = [(d, t) for d, t in enumerate(lone)]
    got = sorted(map(tuple, suffix_dedup.digest(frame(spark, docs)).collect()))
    assert got == brute.suffix(docs) and [r[2] for r in got] == list(lone.values())
    docs = [(1, "ab" * 60), (2, "ab" * 60), (3, "Q" * 150), (4, "Q" * 150), (5, "Q" * 150)]
    got = sorted(map(tuple, suffix_dedup.digest(frame(spark, docs)).collect()))
    assert got == brute.suffix(docs) and sum(r[2] for r in got) == 238 + 449
