import random

import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

import brute
import corpus_pipeline
from hearthline.llm.queries import tokenizer_file


#: Names that an operator might use for itself.
CLASHING = ["_row", "_slot", "_word", "_bits", "_maybe", "_new", "_d", "_r", "doc.id", "n words"]


def kept_by_rules(docs):
    """(doc_id, text) pairs that pass their own rules, where no host is rejected."""
    out = []
    for d, t in docs:
        w = brute.words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        many = {g for g in grams if grams.count(g) > 1}
        covered = {j for i, g in enumerate(grams) if g in many for j in range(i, i + 5)}
        if len(w) >= 10 and 100 * len(covered) <= 20 * len(w):
            out.append((d, t))
    return out


def without_lines(docs):
    seen, out = set(), []
    for d, t in sorted(docs):
        ls = t.split("\n")
        gone = set()
        for i in range(len(ls) - 2):
            k = "\n".join(ls[i : i + 3])
            if k in seen and brute.words(k):
                gone |= {i, i + 1, i + 2}
            seen.add(k)
        t = "\n".join(x for i, x in enumerate(ls) if i not in gone)
        if brute.words(t):
            out.append((d, t))
    return out


def without_passages(docs):
    first = {}
    for d, t in docs:
        w = brute.words(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    out = []
    for d, t in docs:
        w = brute.words(t)
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        t = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        if brute.words(t):
            out.append((d, t))
    return out


def test_against_brute_force(spark, tmp_path):
    r = random.Random(11)
    vocab = [f"w{i}" for i in range(600)]
    make = lambda k: [" ".join(r.choice(vocab) for _ in range(r.randint(4, 20))) for _ in range(k)]
    passages, docs = [make(3) for _ in range(3)], []
    long = [" ".join(r.choice(vocab) for _ in range(70)) for _ in range(3)]
    for i in range(90):
        ls = make(r.randint(1, 9))
        if r.random() < 0.3:
            ls += r.choice(passages)
        if r.random() < 0.2:
            ls.append("x" + str(i) + " " + r.choice(long))
        docs.append((i, "\n".join(ls)))
    for i in range(90, 130):
        w = docs[r.randrange(60)][1].replace("\n", " ").split(" ")
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "edited"
        docs.append((i, " ".join(w)))
    docs += [(130, None), (131, "same five words come again " * 30), (132, "short"), (133, docs[1][1])]
    t = pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs], "lang": ["en"] * len(docs), "source": ["a"] * len(docs), "n_chars": pa.array([len(t or "") for _, t in docs], pa.int64()), "key": ["clash"] * len(docs), "row": [1] * len(docs), **{c: list(range(len(docs))) for c in CLASHING}})
    pq.write_table(t, tmp_path / "documents.parquet")

    want = without_lines(kept_by_rules(docs))
    alone = {d for d, _, _, kept in brute.near(want) if kept}
    want = without_passages([x for x in want if x[0] in alone])
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = state.columns
        state = stage(spark, state, str(tmp_path))
        assert state.columns == columns
        state.write.parquet(str(tmp_path / f"{k}.parquet"))
        state = spark.read.parquet(str(tmp_path / f"{k}.parquet"))
    rows = state.collect()
    assert sorted((x.doc_id, x.text) for x in rows) == want
    assert all(x.n_chars == len(x.text) for x in rows)
    place = {d: i for i, (d, _) in enumerate(docs)}
    assert all(x[c] == place[x.doc_id] for x in rows for c in CLASHING)

    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = []
    for d, text in want:
        ids = tok.encode(text, add_special_tokens=False).ids + [1]
        pieces += [(d, a, len(ids[a : a + 2048]), brute.crc_ids(ids[a : a + 2048])) for a in range(0, len(ids), 2048)]
    assert sorted(map(tuple, (x[:4] for x in got))) == sorted(pieces)


def test_edges(spark, tmp_path):
    """Empty tables, null and repeated doc_ids, equal rows, one long text without spaces."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    some = " ".join(f"w{i}" for i in range(60))
    rows = [(None, some), (None, some), (4, some + " x"), (4, some + " y"), (4, some + " y"), (5, None), (6, "z" * 200_000), (None, None), (-3, "a b c d e f g h i j k")]
    for docs in ([], rows):
        state = spark.createDataFrame([(d, t, "en", None, len(t or "")) for d, t in docs], schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, state = state, stage(spark, state, str(tmp_path))
            assert state.columns == before.columns
        got = sorted(((r.doc_id is not None, r.doc_id or 0), r.text) for r in state.collect())
        want = [((False, 0), some)] * 2 + [((True, -3), rows[-1][1])] + [((True, 4), some + e) for e in (" x", " y", " y")]
        assert got == (want if docs else [])
        assert corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path)).count() == len(got)
