import random
import tracemalloc
import zlib

import public_tokenizers
from tokenizers import Tokenizer

import brute
from hearthline.llm import packing, sharding
from hearthline.llm.words import WordIds, units

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_fill_is_best():
    r = random.Random(1)
    for _ in range(200):
        left = {r.randint(1, 40): r.randint(1, 3) for _ in range(r.randint(1, 6))}
        room = r.randint(0, 100)
        sums = {0}
        for k, v in left.items():
            sums = {s + k * i for s in sums for i in range(v + 1)}
        taken = packing.fill(left, room)
        assert all(v <= left[k] for k, v in taken.items())
        assert sum(k * v for k, v in taken.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    r = random.Random(2)
    counts = {r.randint(1, 2048): r.randint(1, 10**6) for _ in range(1500)}
    used = {}
    fillings = packing.plan(counts)
    for _, times, taken in fillings:
        assert sum(k * v for k, v in taken.items()) <= 2048
        for k, v in taken.items():
            used[k] = used.get(k, 0) + v * times
    assert used == counts
    assert sum(x[1] for x in fillings) * 2048 < 1.02 * sum(k * v for k, v in counts.items())


def texts(n=120, seed=3):
    r = random.Random(seed)
    vocab = ["the", "Straße", "can't", "ΟΔΟΣ", "éa", "x1y22", "…", "<|endoftext|>", "日本語", " nb sp", "a'll", "--;", "🙂"]
    return [r.choice([" ", "\n", "\t "]).join(r.choice(vocab) for _ in range(r.choice([0, 1, 5, 50, 400, 3000]))) for _ in range(n)]


def test_packing(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (None, "x y"), (7, texts()[7])]
    df = spark.createDataFrame([(d, t, 5, "s") for d, t in rows], "doc_id long, text string, length int, start string")
    tok = Tokenizer.from_file(TOKENIZER)
    got = packing.pack(df, TOKENIZER).collect()
    pieces = sorted(((r.doc_id is None, r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=str)
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d is None, d, a, len(ids[a : a + 2048]), brute.crc_ids(ids[a : a + 2048]), len(ids)) for a in range(0, len(ids), 2048)]
    assert pieces == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for at in by.values():
        end = 0
        for o, n in sorted(at):
            assert o == end
            end += n
        assert end <= 2048
    assert len(by) <= 1.12 * sum(r.length for r in got) / 2048
    assert packing.pack(df.limit(0), TOKENIZER).collect() == []


def best(sizes, shards):
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid, n, s = (lo + hi) // 2, 1, 0
        for x in sizes:
            if s + x > mid:
                n, s = n + 1, 0
            s += x
        lo, hi = (lo, mid) if n <= shards else (mid + 1, hi)
    return lo


def test_sharding(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SLICES", 5)
    for seed in (1, 2):
        r = random.Random(seed)
        pool = ["é" * r.randint(0, 60) + str(i) for i in range(150)]
        rows = [(i, r.choice(pool)) for i in range(400)] + [(400, None), (401, ""), (None, "only"), (3, pool[0]), (3, pool[0])]
        if seed == 2:
            rows += [(500 + i, pool[5]) for i in range(300)]
        r.shuffle(rows)
        df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, size int, shard int")
        got = sharding.shard(df).collect()
        assert sorted((str(x.doc_id), x.size, x.text_crc32) for x in got) == sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
        first, size = {}, {}
        for d, t in rows:
            t = t or ""
            first[t] = min(first.get(t, 10**9), d if d is not None else 10**9)
            size[t] = size.get(t, 0) + len(t.encode()) + 1
        order = [size[t] for t in sorted(size, key=lambda t: first[t])]
        per, slots, where = [0] * 8, [[] for _ in range(8)], {}
        for x in got:
            per[x.shard] += x.size
            slots[x.shard].append(x.slot)
            where.setdefault(x.text_crc32, set()).add(x.shard)
        assert max(per) == best(order, 8)
        assert all(sorted(s) == list(range(len(s))) for s in slots) and all(len(v) == 1 for v in where.values())
    assert sharding.shard(df.limit(0)).collect() == []
    assert [x.shard for x in sharding.shard(df.limit(1)).collect()] == [0]


def test_words_encode_as_texts():
    tok = Tokenizer.from_file(TOKENIZER)
    ids, many = packing.word_encoder(tok)
    words = {w.encode() for t in texts(200, 9) for w in t.split(" ")} | {b"~", b"a~b", b"~~", "x́~".encode(), b"<|startoftext|>~", b"don't'll", b"\x1c", "İΣ".encode(), "ÀÉ.'s't".encode(), "Ä''sß'LL'd".encode(), b"a.'rex''Ve|#", b"\x00", "́".encode()}
    words = sorted(w for w in words if w.split() == [w])
    want = [packing.np.array(tok.encode(w.decode(), add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert many(words) == want and [ids[w] for w in words] == want and many([]) == []
    ids.fill(set(words), many)


def test_words_in_arrays_give_the_ids_of_texts(monkeypatch):
    """Also where the store starts over and texts are cut in small units."""
    from hearthline.llm import words
    from hearthline.llm.packing import WordIds, units, word_encoder

    tok = Tokenizer.from_file(TOKENIZER)
    some = texts(60, 11) + ["", " \n", "~", "x" * 300, None and ""]
    some = [t for t in some if t is not None]
    want = [b"".join(int(i).to_bytes(4, "little") for i in tok.encode(t, add_special_tokens=False).ids) for t in some]
    for kept, most in ((1_000_000, 1 << 20), (5, 40), (0, 1)):
        monkeypatch.setattr(words, "KEPT_WORDS", kept)
        ids = WordIds(word_encoder(tok)[1])
        got = [b""] * len(some)
        for unit in units(some, most):
            for (i, _), part in zip(unit, ids.encode([raw for _, raw in unit]), strict=True):
                got[i] += part
        assert got == want


def test_what_an_encoder_holds():
    """Stages of the pipeline leave two workers of an executor little memory: what a stretch of text takes is bounded, and so is the table."""
    with open(TOKENIZER, "rb") as f:
        shared = type("Shared", (), {"value": f.read()})
    packing._kept.clear()
    ids = packing.word_ids(shared)
    r = random.Random(4)
    text = " ".join(r.choice(["the", "Straße", "can't", "x1y22", "--;"]) for _ in range(500_000)).encode()
    tracemalloc.start()
    n = sum(len(x) for some in units([text], packing.SOME_BYTES) for x in ids.encode([raw for _, raw in some]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 4 * len(Tokenizer.from_file(TOKENIZER).encode(text.decode(), add_special_tokens=False).ids)
    assert peak < 40e6
    assert ids.kept_words < 1_000_000 and {x.a.itemsize for x in (ids.at, ids.size, ids.first, ids.length)} == {4}


def test_tables_that_start_over_give_the_same_ids():
    words = [f"w{i % 300}x" for i in range(2000)]
    tok = Tokenizer.from_file(TOKENIZER)
    many = packing.word_encoder(tok)[1]
    few, all_ = WordIds(many, 20), WordIds(many)
    texts_ = [" ".join(words[i : i + 50]).encode() for i in range(0, 2000, 50)]
    for t in texts_:
        assert few.encode([t]) == all_.encode([t])
    assert few.count < 100 < all_.count == 300
