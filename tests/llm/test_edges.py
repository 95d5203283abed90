"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, for the operators that have no such test elsewhere."""

import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

import brute
from hearthline.llm import chat, line_dedup, packing, quality, sentencepiece_codec, sharding, topk
from hearthline.llm.common import Cached

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
DENSE = "漢字かなカナ中国" * 3000 + "aGVsbG8gd29ybGQ" * 2000


def frame(spark, docs):
    """Documents with columns named as operators might name their own."""
    return spark.createDataFrame([(d, t, "s", 1, 2, 3, "x") for d, t in docs], "doc_id long, text string, source string, row int, shard int, start int, _word string")


def test_texts_without_spaces(spark):
    docs = [(1, DENSE), (2, "x" * 100_000 + " y"), (2, "x" * 100_000 + " y"), (None, "z " * 50_000)]
    tok = Tokenizer.from_file(WORDS)
    got = sorted(((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack(frame(spark, docs), WORDS).collect()))
    want = []
    for _, t in docs:
        ids = tok.encode(t, add_special_tokens=False).ids + [1]
        want += [(a, len(ids[a : a + 2048]), brute.crc_ids(ids[a : a + 2048]), len(ids)) for a in range(0, len(ids), 2048)]
    assert got == sorted(want)
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256) for r in sentencepiece_codec.digest(frame(spark, docs), PIECES).collect())
    ids = [(d, lib.encode(t, add_bos=True, add_eos=True)) for d, t in docs]
    assert rows == sorted((str(d), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for d, x in ids)


def test_caches_do_not_keep_long_keys():
    made = []
    c = Cached(lambda k: made.append(k) or len(k), limit=3, longest=4)
    assert [c["abcde"], c["abcde"], c["ab"], c["ab"]] == [5, 5, 2, 2] and made == ["abcde", "abcde", "ab"]
    c.fill({"x", "toolong", "y"}, lambda ks: [len(k) for k in ks])
    assert set(c) | set(c.old) == {"ab", "x", "y"} and c["toolong"] == 7


def test_sharding_of_a_very_long_text(spark):
    docs = [(1, "é" * 500_000), (2, "a"), (3, None), (4, "b" * 1000), (4, "b" * 1000), (None, "a")]
    rows = sharding.shard(frame(spark, docs)).collect()
    assert sorted(r.size for r in rows) == sorted(len((t or "").encode()) + 1 for _, t in docs)
    long = next(r.shard for r in rows if r.size > 10**6)
    assert [r.doc_id for r in rows if r.shard == long] == [1]


def test_quality_of_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = [(None, text), (None, text), (1, text), (1, text), (1, "short"), (2, None), (3, "a b c d e " * 100_000)]
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in quality.digest(frame(spark, docs)).collect())
    assert got == sorted([("None", 30, False, True)] * 2 + [("1", 30, False, True)] * 2 + [("1", 1, True, False), ("2", 0, True, False), ("3", 500_000, True, False)])
    assert quality.digest(frame(spark, [])).collect() == []


def test_lines_of_null_and_repeated_ids(spark):
    a, b = "one two\nthree\nfour", "five\nsix\nseven"
    docs = [(None, a), (None, a), (1, a), (1, a), (2, a + "\n" + b), (2, b), (3, "\n".join(f"{i}" for i in range(200_000))), (4, None)]
    got = sorted((str(r.doc_id), r.n_lines, r.n_removed) for r in line_dedup.digest(frame(spark, docs)).collect())
    assert [g for g in got if g[0] != "2"] == sorted([("None", 3, 0)] * 2 + [("1", 3, 0)] * 2 + [("3", 200_000, 0), ("4", 1, 0)])
    assert sum(g[2] for g in got if g[0] == "2") == 6 and line_dedup.digest(frame(spark, [])).collect() == []


def test_chat_without_conversation(spark):
    rows = [(None, 0, "user", "lone"), (None, 0, "user", "lone"), (None, 1, "assistant", "other"), (5, 0, None, None), (5, 1, "assistant", "x" * 300_000), (6, 2, "assistant", "b"), (6, None, "user", "c")]
    df = spark.createDataFrame([(*r, "e", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, example string, loss_start int, conversation int")
    got = sorted(((str(r.conv_id), r.n_turns, r.loss_chars) for r in chat.digest(df).collect()))
    assert got == [("5", 2, 300_000), ("6", 2, 1), ("None", 1, 0), ("None", 1, 0), ("None", 1, 5)]
    assert sorted(str(r.conv_id) for r in chat.format_chats(df).collect()) == ["5", "6", "6", "None", "None", "None"]
    assert chat.format_chats(df.limit(0)).collect() == [] and chat.digest(df.limit(0)).collect() == []


def test_topk_of_one_row(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert topk.topk(df).collect() == []
