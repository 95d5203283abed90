"""Operator 6: exact encoding and decoding for merge-type (BPE) SentencePiece models.

Encoding does not replay merges over the text. An Aho-Corasick pass finds the longest piece that starts at each place; pieces
are then taken greedily, each compatible with the one before, with shorter prefixes tried next and a bitfield of places
from which no completion exists. Two adjacent pieces are compatible if re-merging their characters gives
just these two; verdicts are kept. Text is first cut where no piece of the vocabulary can span
(before a space mark, around line ends), so that encodings of frequent cuts are kept, CACHE_WORDS at most and none of a long cut.

Pieces of equal score (runs of spaces in some models) merge leftmost first; re-merging follows that, and tests hold
such runs against the library.

Defined cases: null texts are empty; an empty text has the begin and end ids only; an empty table gives no rows; a very long text is encoded whole, in time linear in its
length also where it has no spaces; unknown characters become byte pieces; further columns, of any name, are not read; rows are independent, so ties and repeats
change nothing and rows without doc_id are encoded like others.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import Cached, lean, small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Codec:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        m = proto.ModelProto()
        m.ParseFromString(model)
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("not a merge-type model without normalisation")
        if {p.type for p in m.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("the model has pieces of a user's own")
        self.prefix = norm.add_dummy_prefix
        self.bos, self.eos = m.trainer_spec.bos_id, m.trainer_spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in m.pieces if p.type == NORMAL}
        byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == BYTE}
        unk = m.trainer_spec.unk_id
        self.fallback = lambda c: [byte_ids[b] for b in c.encode()] if len(byte_ids) == 256 else [unk]
        self.surface = [b"" if p.type == CONTROL else m.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(SPACE, " ").encode() for p in m.pieces]
        self.machine = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) > 1:
                self.machine.add_word(p, p)
        self.machine.make_automaton()
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = any("\n" in p for p in self.ids)
        self.cut = re.compile(r"(?s).+" if inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if line else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.shorter = Cached(self._shorter)
        self.fits = Cached(lambda pair: self.merge(pair[0] + pair[1]) == list(pair))
        self.known = Cached(lambda cut: np.array(self.cut_ids(cut), "<u4").tobytes())

    def _shorter(self, piece: str) -> str | None:
        """The longest proper prefix that is a piece or one character."""
        return next((piece[:k] for k in range(len(piece) - 1, 0, -1) if k == 1 or piece[:k] in self.ids), None)

    def merge(self, text: str) -> list[str]:
        """Symbols after all merges: the best score first, the leftmost of equals."""
        parts, scores = list(text), self.scores
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def pieces(self, cut: str) -> list[str]:
        """The pieces of a cut, by backtracking."""
        longest = list(cut)
        for end, piece in self.machine.iter(cut):
            at = end - len(piece) + 1
            if len(piece) > len(longest[at]):
                longest[at] = piece
        failed = bytearray(len(cut) // 8 + 1)  # a bit for each place
        out: list[str] = []
        at, piece = 0, longest[0]
        while True:
            last = out[-1] if out else None
            while piece is not None and (failed[(end := at + len(piece)) >> 3] >> (end & 7) & 1 or (last is not None and not self.fits[last, piece])):
                piece = self.shorter[piece]
            if piece is None:  # nothing fits here
                if last is None:
                    raise ValueError("no compatible sequence of pieces")
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                continue
            out.append(piece)
            at += len(piece)
            if at == len(cut):
                return out
            piece = longest[at]

    def cut_ids(self, cut: str) -> list[int]:
        out: list[int] = []
        for p in self.pieces(cut):
            i = self.ids.get(p)
            out += [i] if i is not None else self.fallback(p)
        return out

    def encode(self, text: str) -> bytes:
        """All ids, with begin and end, as little-endian unsigned 32-bit integers."""
        marked = text.replace(" ", SPACE)
        if marked and self.prefix:
            marked = SPACE + marked
        ends = np.array([self.bos, self.eos], "<u4").tobytes()
        return b"".join((ends[:4], *map(self.known.__getitem__, self.cut.findall(marked)), ends[4:]))

    def decode(self, ids: bytes) -> bytes:
        """The text of ids in UTF-8; bytes that are none become U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        if self.prefix and data[:1] == b" ":
            data = data[1:]
        try:
            data.decode()
        except UnicodeDecodeError:
            data = data.decode(errors="replace").encode()
        return data


def model_bytes(spark, path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_codecs: dict[int, Codec] = {}


def codec(shared) -> Codec:
    """One codec in each Python worker."""
    key = hash(shared.value)
    if key not in _codecs:
        _codecs[key] = Codec(shared.value)
    return _codecs[key]


def encode(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, with begin and end) of every row."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model_bytes(documents.sparkSession, model))

    def run(batches):
        c = codec(shared)
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                some = pdf.iloc[i : i + 1000]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "ids": [c.encode(t) for t in some["text"]]})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(lean(run), "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, ids and the decoded text (UTF-8) of rows of encode()."""
    small_batches(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(model_bytes(encoded.sparkSession, model))

    def run(batches):
        c = codec(shared)
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                some = pdf.iloc[i : i + 1000]
                yield pd.DataFrame({"doc_id": some["doc_id"].astype("Int64"), "ids": some["ids"], "decoded": [c.decode(x) for x in some["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(lean(run), "doc_id long, ids binary, decoded binary")


def digest(documents: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; both ways run in one pass over the texts."""
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model_bytes(documents.sparkSession, model))

    def run(batches):
        c = codec(shared)
        hexa = lambda x: hashlib.sha256(x).hexdigest()
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                ids = c.encode(t)
                rows.append((len(ids) // 4, hexa(ids), hexa(c.decode(ids))))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", pdf["doc_id"].astype("Int64").to_numpy())
            yield out

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
