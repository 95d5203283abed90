import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from hearthline.llm import sentencepiece_codec as sc

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return sc.Codec(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts(n, seed):
    r = random.Random(seed)
    kinds = [
        "abcdefghijklmnopqrstuvwxyz ", "aeiou   ", " ▁a", "ab\n \t", "theandingro", "éàçüñß ea", "漢字かなカナ中国日本語 ", "0123456789.,-", "<s></s>[INST] ",
        "\x00\x01​  x", "🙂👍a ", "àèéa ́e", "    ", "aaaa", "function(){return x;} ",
    ]
    for _ in range(n):
        k = r.choice(kinds)
        yield "".join(r.choice(k) for _ in range(r.choice([0, 1, 2, 5, 20, 80, 300])))
        yield "".join(r.choice(r.choice(kinds)) for _ in range(r.choice([3, 30, 200])))


def test_against_the_library(both):
    own, lib = both
    for t in texts(1500, 1):
        ids = own.encode(t)
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(t)
        assert own.decode(ids).decode() == lib.decode(want), repr(t)


def test_backtracking_alone_agrees_with_merging(both):
    own, _ = both
    r = random.Random(5)
    pieces = [p for p in own.ids if "▁" not in p]
    for _ in range(4000):
        cut = "".join(r.choice(pieces) for _ in range(r.randint(1, 8)))
        assert own.pieces(cut) == own.merge(cut)


def test_runs_of_spaces(both):
    own, lib = both
    for n in range(90):
        for end in ("", "a", "the", "x\n", " \n  b"):
            t = " " * n + end
            assert np.frombuffer(own.encode(t), "<u4").tolist() == lib.encode(t, add_bos=True, add_eos=True)


def test_rows(spark):
    rows = [(1, "the cat  sat"), (2, None), (None, "x"), (3, "long " * 30000), (1, "the cat  sat")]
    df = spark.createDataFrame([(d, t, 0, "z") for d, t in rows], "doc_id long, text string, n_tokens int, ids string")
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    hexa = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for d, t in rows:
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        want.append((d, len(ids), hexa(np.array(ids, "<u4").tobytes()), hexa(lib.decode(ids).encode())))
    order = lambda x: (x[0] is None, x)
    assert sorted(map(tuple, sc.digest(df, MODEL).collect()), key=order) == sorted(want, key=order)
    assert {r.doc_id: r.decoded.decode() for r in sc.decode(sc.encode(df, MODEL), MODEL).where("doc_id = 1").collect()} == {1: "the cat  sat"}
    assert sc.digest(df.limit(0), MODEL).collect() == []


def test_time_grows_with_the_length_of_a_text_without_spaces(both):
    import time

    own, lib = both
    r, took = random.Random(4), []
    for n in (200_000, 800_000):
        t = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
        start = time.process_time()
        ids = own.encode(t)
        took.append(time.process_time() - start)
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t, add_bos=True, add_eos=True)
    assert took[1] < 8 * took[0] + 1, took
