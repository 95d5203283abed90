"""Operator 12: BPE encoding by a priority queue of merge ranks, and decoding from the vocabulary's strings.

A pre-token starts as a doubly linked list of symbols. A queue holds (rank, place) of each pair of neighbours that has a merge; the least is taken,
and skipped as stale if the pair at its place is not the one that was queued. A merge joins two symbols, unlinks the right one and queues the
two pairs that it made: n log n in the length of a pre-token. Decoding puts the vocabulary's strings of the ids one after the
other, with a space between them, as the library does for a tokenizer without a decoder.

Words between ASCII white space are encoded apart, since normalising and splitting never look across it; ids of words come from a worker's exact table. Strings of
special tokens inside texts become their ids. Words of ASCII and Latin letters are lower-cased and split here; for all others the tokenizer
file's own normaliser and splitter say what the pre-tokens are, as their Unicode tables decide it.

Defined cases: null texts are empty; an empty text has no ids and decodes to nothing; an empty table gives no rows; a very long text is encoded whole,
as is a very long word; rows are independent, so ties and repeated rows change nothing and rows without doc_id are encoded like others; further columns, of any
name, are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import Cached, lean, small_batches
from hearthline.llm.words import WordIds, units

#: Bytes of texts whose new words are gathered.
SOME_BYTES = 1 << 20
#: Pre-tokens whose ids a Python worker keeps in each of two generations.
KEPT_PARTS = 200_000
#: The tokenizer's normalisers, and its pattern of pre-tokens.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words that these rules split as the tokenizer does: visible ASCII, and Latin letters that no mark can change.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: visible Latin-1 characters for themselves, the others numbered from U+0100."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(seen)]
    return [chr(b) if b in set(seen) else chr(256 + other.index(b)) for b in range(256)]


class Bpe:
    def __init__(self, file: bytes):
        from tokenizers import Tokenizer

        state = json.loads(file)
        model, split = state["model"], state["pre_tokenizer"]["pretokenizers"]
        if (
            [n["type"] for n in state["normalizer"]["normalizers"]] != NORMALIZERS or split[0]["pattern"].get("Regex") != PATTERN or split[1]["type"] != "ByteLevel"
            or state["decoder"] or model["type"] != "BPE" or model["dropout"] or model["byte_fallback"] or model["ignore_merges"] or model["continuing_subword_prefix"]
        ):
            raise ValueError("not a BPE tokenizer of the kind that this module encodes")
        self.tokenizer = Tokenizer.from_buffer(file)
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in state["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in state["added_tokens"]):
            raise ValueError("special tokens of another kind")
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + end] for c in letters]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            strings[i] = s
        self.strings = [s.encode() for s in strings]
        self.decimals = [str(i).encode() for i in range(len(strings))]
        self.parts = Cached(self.merged, KEPT_PARTS)
        self.words = WordIds(self.word_ids)

    def merged(self, part: bytes) -> bytes:
        """Ids of one pre-token, by the queue of merges."""
        ids = [self.inner[b] for b in part]
        ids[-1] = self.last[part[-1]]
        n, merges = len(ids), self.merges
        if n == 1:
            return np.array(ids, "<u4").tobytes()
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if (m := merges.get((ids[i], ids[i + 1]))) is not None:
                queue.append((m[0], i))
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            j = after[i]
            if j < 0 or ids[i] < 0:
                continue  # stale: the place has no right neighbour any more, or is gone
            m = merges.get((ids[i], ids[j]))
            if m is None or m[0] != rank:
                continue  # stale: another pair stands there now
            ids[i], ids[j] = m[1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (m := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(queue, (m[0], i))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(queue, (m[0], h))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pre_tokens(self, text: str) -> list[bytes]:
        if SIMPLE.fullmatch(text):
            return [p.encode() for p in PARTS.findall(text.lower())]
        parts = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
        return [bytes(map(self.byte_of.__getitem__, p)) for p, _ in parts]

    def word(self, word: str) -> bytes:
        if self.marks and "<" in word and self.marks.search(word):
            return b"".join(np.array([self.special[t]], "<u4").tobytes() if t in self.special else self.word(t) for t in self.marks.split(word) if t)
        return b"".join(map(self.parts.__getitem__, self.pre_tokens(word)))

    def word_ids(self, words: list[bytes]) -> list[bytes]:
        return [self.word(w.decode()) for w in words]

    def encode_all(self, texts) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for some in units(texts, SOME_BYTES):
            for (i, _), ids in zip(some, self.words.encode([raw for _, raw in some]), strict=True):
                out[i].append(ids)
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8."""
        return b" ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def shown(self, ids: bytes) -> bytes:
        """Decimal ids, joined by one space."""
        return b" ".join(map(self.decimals.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[int, Bpe] = {}


def codec(shared) -> Bpe:
    """One codec in each Python worker."""
    key = hash(shared.value)
    if key not in _codecs:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _codecs[key] = Bpe(shared.value)
    return _codecs[key]


def _shared(df: DataFrame, tokenizer: str):
    small_batches(df.sparkSession)
    with open(tokenizer, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def encode(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of every row."""
    shared = _shared(documents, tokenizer)

    def run(batches):
        c = codec(shared)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": c.encode_all(pdf["text"].tolist())})

    return _texts(documents).mapInPandas(lean(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded (the text in UTF-8) of rows of encode()."""
    shared = _shared(encoded, tokenizer)

    def run(batches):
        c = codec(shared)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "ids": pdf["ids"], "decoded": [c.decode(x) for x in pdf["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(lean(run), "doc_id long, ids binary, decoded binary")


def digest(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; both ways run in one pass over the texts."""
    shared = _shared(documents, tokenizer)

    def run(batches):
        c = codec(shared)
        hexa = lambda x: hashlib.sha256(x).hexdigest()
        for pdf in batches:
            rows = [(len(ids) // 4, hexa(c.shown(ids)), hexa(c.decode(ids))) for ids in c.encode_all(pdf["text"].tolist())]
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    return _texts(documents).mapInPandas(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
