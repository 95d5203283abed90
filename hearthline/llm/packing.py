"""Operator 3: sequence packing by minimum bin slack.

Documents are tokenised, closed with an end id, and cut into pieces of at most `window` ids. A histogram of piece lengths (a row
per length, so never over `window` rows) goes to the driver, where each window is filled around
the longest piece left: a bitset of reachable sums over the remaining lengths finds the multiset closest to capacity,
and the history of the bitset gives back how many pieces of each length it takes. A filling is repeated while its
lengths last, so the plan stays a few thousand rows for any corpus. Pieces then find their place by their rank
within their length, which is a row number in a hash bucket plus the bucket's offset.

Defined cases: null and empty texts are one piece, the end id alone; an empty table gives no rows; a very long text is cut in as many pieces as it takes; a very
long word, as in texts without spaces, is encoded each time and not kept; equal rows are packed once each; rows without doc_id are packed like others; lengths that
tie are told apart by a hash; words whose hashes agree are compared by their bytes and get each its own ids; further columns, of any name, are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearthline.llm.common import Cached, lean, spare, table
from hearthline.llm.words import WordIds, units

WINDOW = 2048
END = 1
#: Rows of one length and bucket, about, where a length holds all of them.
BUCKET_ROWS = 1 << 18


#: Bytes of texts whose new words are gathered, and words that one call encodes.
SOME_BYTES, SOME_WORDS = 1 << 18, 200
#: Stands between words in a call.
MARK = "~"
#: Words whose ids a Python worker keeps, and parts of words in each of two generations: two workers share an executor with its JVM.
KEPT_WORDS, KEPT_PARTS = 600_000, 50_000
#: How the tokenizer normalises and splits. Where it is just this, words of plain letters and marks
#: are split here, so that their parts are encoded once; all other words go to the tokenizer whole.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SIMPLE = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ'.,;:!?\"()|#*-]+")
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[^a-zß-öø-ÿ]+")

_kept: dict[int, tuple] = {}


def word_encoder(tok):
    """(cache of the ids of words and parts, function for many words).

    Many words go through one call with a mark between them, as a call costs more than a word. The mark is used only if it
    is one id that stands apart between white space; words that hold it are encoded alone.
    """
    plain = lambda text: tok.encode(text, add_special_tokens=False).ids
    raw = lambda ids: np.array(ids, "<u4").tobytes()
    alone = lambda w: raw(plain(w.decode()))
    mark = plain(MARK)
    apart = len(mark) == 1 and plain(f"a {MARK} b") == plain("a") + mark + plain("b")

    def some(words):
        ids = np.array(tok.encode_batch_fast([f" {MARK} ".join([w.decode() for w in words])], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == mark[0])
        if len(cuts) != len(words) - 1:
            return [alone(w) for w in words]
        data, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip([0, *[e + 4 for e in ends[:-1]]], ends, strict=True)]

    def marked(words):
        held = MARK.encode()
        out, at = [], 0
        while at < len(words):
            end = at
            while end < len(words) and end < at + SOME_WORDS and apart and held not in words[end]:
                end += 1
            if end > at:
                out += some(words[at:end])
            else:
                end = at + 1
                out.append(alone(words[at]))
            at = end
        return out

    state = json.loads(tok.to_str())
    split = (state.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    known = (split[0].get("pattern") or {}).get("Regex") == PATTERN and [n["type"] for n in (state.get("normalizer") or {}).get("normalizers", [])] == NORMALIZERS
    ids = Cached(alone, KEPT_PARTS)

    def many(words):
        if not known:
            return marked(words)
        cut = [[p.encode() for p in PARTS.findall(w.decode().lower())] if SIMPLE.fullmatch(w.decode()) else None for w in words]
        ids.fill({p for c in cut if c for p in c}, marked)
        rest = iter(marked([w for w, c in zip(words, cut, strict=True) if c is None]))
        return [b"".join(map(ids.__getitem__, c)) if c else next(rest) for c in cut]

    return ids, many


def word_ids(shared) -> WordIds:
    """What encodes words, kept over the tasks of a Python worker."""
    key = hash(shared.value)
    if key not in _kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        _kept[key] = WordIds(word_encoder(Tokenizer.from_buffer(shared.value))[1], KEPT_WORDS)
    return _kept[key]


def tokenised(documents: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens.

    Words between ASCII white space are encoded apart, which is what the tokenizer itself does: it
    normalises, splits and merges without looking across white space. Words that came before are looked up in an exact table.
    """
    with open(tokenizer, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        ids = word_ids(shared)
        last = np.array([end], "<u4").tobytes()
        for pdf in batches:
            data: list[list[bytes]] = [[] for _ in range(len(pdf))]
            for some in units(pdf["text"], SOME_BYTES):
                for (i, _), part in zip(some, ids.encode([raw for _, raw in some]), strict=True):
                    data[i].append(part)
            rows = []
            for doc_id, parts in zip(pdf["doc_id"], data, strict=True):
                whole = b"".join((*parts, last))
                n = len(whole) // 4
                rows += [(doc_id, a, min(window, n - a), zlib.crc32(whole[4 * a : 4 * (a + window)]), n) for a in range(0, n, window)]
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            del pdf, data
            spare()
            yield out

    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInPandas(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(left: dict[int, int], room: int) -> dict[int, int]:
    """How many pieces of each length to take so that their sum is closest to room, from below."""
    reach, full, history = 1, (1 << room + 1) - 1, []
    for size in sorted((k for k in left if k <= room), reverse=True):
        count, step = min(left[size], room // size), 1
        while count and not reach >> room & 1:
            step = min(step, count)
            history.append((reach, size, step))
            reach |= reach << size * step & full
            count -= step
            step *= 2
        if reach >> room & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for before, size, step in reversed(history):
        if not before >> at & 1:
            taken[size] = taken.get(size, 0) + step
            at -= size * step
    return taken


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, dict[int, int]]]:
    """Fillings: (first sequence, how many sequences, pieces of each length in one)."""
    left = {k: v for k, v in counts.items() if v}
    out, sequence = [], 0
    while left:
        seed = max(left)
        left[seed] -= 1
        taken = fill({k: v for k, v in left.items() if v}, window - seed)
        left[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        times = min(left[k] // v for k, v in taken.items())
        for k, v in taken.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
        out.append((sequence, times, taken))
        sequence += times
    return out


def places(fillings, window: int) -> dict[str, np.ndarray]:
    """For a length and a rank within it: from which rank on a filling holds, and where its pieces lie."""
    rows, used = [], {}
    for first, times, taken in fillings:
        offset = 0
        for size in sorted(taken, reverse=True):
            lo = used.get(size, 0)
            rows.append(((size << 44) + lo, first, taken[size], offset))
            used[size] = lo + taken[size] * times
            offset += size * taken[size]
    rows.sort()
    return {k: np.array(x, np.int64) for k, x in zip(("lo", "first", "copies", "offset"), zip(*rows, strict=True) if rows else [()] * 4, strict=True)}


def packed(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """pieces (doc_id, start, length, ids_crc32, doc_tokens), written already, with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    at = places(plan(counts, window), window)
    buckets = max(64, sum(counts.values()) // BUCKET_ROWS)
    key = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    sizes = key.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = key.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")))
    ranked = ranked.join(sizes, ["length", "bucket"]).withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("bucket", "before")

    def place(batches):
        for pdf in batches:
            size, rank = pdf["length"].to_numpy(), pdf.pop("rank").to_numpy()
            i = np.searchsorted(at["lo"], (size << 44) + rank, "right") - 1
            k = rank - (at["lo"][i] - (size << 44))
            pdf["sequence_id"] = at["first"][i] + k // at["copies"][i]
            pdf["offset"] = at["offset"][i] + k % at["copies"][i] * size
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    ranked = ranked.select(F.col("doc_id").cast("string").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "rank")
    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(documents: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END) -> DataFrame:
    return packed(table(tokenised(documents, tokenizer, window, end)), window)
