import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hearthline.llm import bpe_codec, common, packing, words

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe_codec.Bpe(open(FILE, "rb").read()), Tokenizer.from_file(FILE)


def ids(x):
    return np.frombuffer(x, "<u4").tolist()


def texts(n, seed):
    r = random.Random(seed)
    kinds = [
        "abcdefghijklmnopqrstuvwxyz ", "aeiou   ", "theandingro", "ABC's 't'LL'd'", "éàçüñß ÉÀ×÷", "漢字かなカナ中国日本語 ", "0123456789.,-", "<|startoftext|>", "<|endoftext|>a ",
        "\x00\x01​  x\x85\x1c\x1f\xa0 ", "🙂👍a ", "àèéa ́e", "ΑΣσς İı ǅ", "aaaa", "½²Ⅷ٣ª", "function(){return x;} ", "ﬁﬂ Å Å ﷺ", "\n\t\v\f\r a",
    ]
    for _ in range(n):
        k = r.choice(kinds)
        yield "".join(r.choice(k) for _ in range(r.choice([0, 1, 2, 5, 20, 80, 300])))
        yield "".join(r.choice(r.choice(kinds)) for _ in range(r.choice([3, 30, 200])))
        yield "".join(r.choice(kinds) for _ in range(r.choice([1, 3, 6])))


def test_against_the_library(both):
    own, lib = both
    every = list(texts(1500, 1)) + [chr(c) + "a" + chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for t, x in zip(every, own.encode_all(every), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids(x) == want, repr(t)
        assert own.decode(x).decode() == lib.decode(want, skip_special_tokens=False), repr(t)
        assert own.shown(x).decode() == " ".join(map(str, want))


def test_queue_agrees_with_merging_one_by_one(both):
    own, _ = both
    r = random.Random(3)
    for _ in range(500):
        part = "".join(r.choice("aeinorsth") for _ in range(r.choice([1, 2, 5, 30]))).encode()
        sym = [own.inner[b] for b in part[:-1]] + [own.last[part[-1]]]
        while found := [(own.merges[p], i) for i, p in enumerate(zip(sym, sym[1:])) if p in own.merges]:
            (_, new), i = min(found, key=lambda f: (f[0][0], f[1]))
            sym[i : i + 2] = [new]
        assert ids(own.merged(part)) == sym


def test_long_words_take_no_squares(both):
    own, lib = both
    for t in ("ab" * 200_000, "漢字" * 50_000, "x" * 300_000 + " <|endoftext|>"):
        assert ids(own.encode_all([t])[0]) == lib.encode(t, add_special_tokens=False).ids


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in docs], "doc_id long, text string, n_tokens int, ids int, Text_ string")


def test_defined_cases(spark, both):
    _, lib = both
    docs = [(1, None), (2, ""), (None, "a b"), (4, "same same"), (4, "same same"), (5, "word " * 400_000), (6, " \n\t")]
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_codec.digest(frame(spark, docs), FILE).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in docs:
        x = lib.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), len(x), sha(" ".join(map(str, x))), sha(lib.decode(x, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe_codec.digest(frame(spark, []), FILE).collect() == []
    again = bpe_codec.decode(bpe_codec.encode(frame(spark, docs), FILE), FILE).collect()
    assert sorted((len(r.ids) // 4, hashlib.sha256(r.decoded).hexdigest()) for r in again) == sorted((w[1], w[3]) for w in want)


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


class Numbered(words.Words):
    def added(self, new):
        self.words += new

    def cleared(self):
        self.words = []


def test_words_of_one_hash_are_told_apart(monkeypatch):
    r = random.Random(2)
    for hashed in (common.word_hashes, lambda data, start, end, powers: (end - start).astype(np.uint64) % 3):
        monkeypatch.setattr(words, "word_hashes", hashed)
        table = Numbered()
        for _ in range(30):
            text = " ".join("".join(r.choice("ab") for _ in range(r.choice([1, 2, 3, 8, 9, 16, 17, 300]))) for _ in range(200)).encode()
            start, end = common.word_spans(np.frombuffer(text, np.uint8))
            assert [table.words[i] for i in table.numbers(text, start, end)] == text.split()
            assert len(set(table.words)) == len(table.words)


def test_packing_of_words_whose_hashes_agree(spark):
    a = thue_morse(1024)
    docs = [(1, a + " " + a), (2, a.translate(str.maketrans("ab", "ba")) + " " + a), (3, a[:128]), (4, a[:128].translate(str.maketrans("ab", "ba")))]
    lib = Tokenizer.from_file(FILE)
    got = {r.doc_id: r.ids_crc32 for r in packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), FILE).where("start = 0").collect()}
    import brute

    assert got == {d: brute.crc_ids((lib.encode(t, add_special_tokens=False).ids + [1])[:2048]) for d, t in docs}
