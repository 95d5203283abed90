import random
import re

import pytest

from hearthline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs, items, k=10):
    every = [(d, t) for d, t in ((d, terms(t)) for d, t in docs if d is not None) if t]
    n, total = len(every), sum(len(t) for _, t in every)
    df = {}
    for _, t in every:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        s = []
        for d, t in every:
            m = 25 + 75 * len(t) * n // total
            score = sum(lexical.weight(n, df[w]) * (10**9 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in terms(text) if w in df)
            if score > 0:
                s.append((-score, d))
        out += [(item, r, d, -x) for r, (x, d) in enumerate(sorted(s)[:k], 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, "x", 2, 3) for d, t in docs], "doc_id long, text string, n int, TERMS string, m int, doc int")


def asks(spark, items):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, item int, w int")


def got(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def corpus(seed=1, n=400):
    r = random.Random(seed)
    vocab = [f"{'W' if i % 5 else 'é'}{i}" for i in range(600)]
    word = lambda: vocab[int(600 * r.random() ** 3)]
    docs = [(i, r.choice([" ", "\n", "-", "_"]).join(word() for _ in range(r.choice([1, 5, 40, 200])))) for i in range(n)]
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 20])))) for i in range(25)]
    passage = "Rare passage of words that nobody else has"
    docs += [(1000 + i, passage + " " + word()) for i in range(40)] + [(2000 + i, passage) for i in range(60)]
    return docs, [*items, (100, passage), (101, passage + " w1 w2 w1"), (102, "zzz nothing"), (103, None), (104, ""), (105, "w1")]


@pytest.mark.parametrize("tiers", [(256, 2048), (4, 40), (1, 2), (0, 0)])
def test_against_brute_force(spark, monkeypatch, tiers):
    docs, items = corpus()
    monkeypatch.setattr(lexical, "DOCUMENTS", 7)
    monkeypatch.setattr(lexical, "ITEMS", 3)
    df = lexical.search(frame(spark, docs), asks(spark, items), tiers=tiers)
    assert got(df) == brute(docs, items)
    proved = {r.tier for r in df.select("tier").distinct().collect()}
    assert proved == {(256, 2048): {0}, (4, 40): {1, 2}, (1, 2): {2} | (proved & {0, 1}), (0, 0): {2}}[tiers]


def test_blocks_of_items(spark, monkeypatch):
    docs, items = corpus(2, 150)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    assert got(lexical.search(frame(spark, docs), asks(spark, items))) == brute(docs, items)


def test_defined_cases(spark):
    docs = [(None, "a b c"), (1, None), (2, ""), (3, "-- !!"), (4, "A b"), (4, "a B"), (5, "a b"), (5, "a b"), (6, "word " * 300_000 + "needle"), (7, "x" * 5000), (8, "c")]
    items = [(1, "a"), (1, "a"), (2, "needle b"), (3, "x" * 5000 + " c"), (4, None)]
    assert got(lexical.search(frame(spark, docs), asks(spark, items))) == brute(docs, items)
    assert lexical.search(frame(spark, []), asks(spark, items)).collect() == []
    assert lexical.search(frame(spark, docs), asks(spark, [])).collect() == []
