"""Windows that repeat across documents: the engine under line, suffix and substring dedup.

A map task cuts texts into runs of consecutive windows that share a minimiser. Runs that may repeat meet in buckets, sorted
by what they share; a bucket sorts whole runs and then their windows by multikey quicksort, so each removal comes from
comparing sorted strings, never from a hash. Results are ranges of tokens, (doc_id, row, a, b), and only texts that have some
are shuffled. `row` is a hash of doc_id and text that tells rows of one doc_id apart.

Skew: a map task sorts what it holds as a bucket of its own before it gives it on, and settles all but the first of equal strings, so a
passage that a third of all rows hold reaches its bucket once for each such sort. A group of over GROUP_ROWS different runs (near copies)
does not stay in one task: its windows go on as strings of their own and are sorted by Spark, which spills.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import Powers, finished, lean, maybe_in, mix, prefix_sums, row_hash

def window_hashes(sums: np.ndarray, length: int, powers: Powers) -> np.ndarray:
    """Hash of each window of `length` tokens, from prefix sums."""
    n = len(sums) - length
    return mix((sums[length:] - sums[:-length]) * powers.get(n)[1])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n, cur, size = len(x) - w + 1, x, 1
    while 2 * size <= w:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    return np.minimum(cur[:n], cur[w - size : w - size + n])


def runs(t: np.ndarray, window: int, gram: int, powers: Powers):
    """Runs of consecutive windows that share a minimiser, of `window` windows at most: (minimiser, start, windows, gram hashes)."""
    grams = window_hashes(prefix_sums(t, powers), gram, powers)
    low = sliding_min(grams, window - gram + 1)
    edges = np.flatnonzero(low[1:] != low[:-1]) + 1
    start = np.concatenate(([0], edges))
    n = np.diff(np.concatenate((start, [len(low)])))
    if n.max() > window:
        pieces = -(-n // window)
        first = np.repeat(np.cumsum(pieces) - pieces, pieces)
        k = np.arange(pieces.sum()) - first
        start, left = np.repeat(start, pieces) + k * window, np.repeat(n, pieces) - k * window
        n = np.minimum(left, window)
    return low[start], start, n, grams


#: Windows of a text that are hashed at once; longer texts go in pieces, so memory is bounded.
PIECE = 1 << 20


def piecewise(n: int, tokens, window: int, gram: int, powers: Powers, piece: int = PIECE):
    """runs() of n tokens, where tokens(a, b) gives the hashes of tokens a to b; runs end at the pieces' ends. Yields each piece's offset too."""
    for a in range(0, n - window + 1, piece):
        yield a, *runs(tokens(a, min(n, a + piece + window - 1)), window, gram, powers)


def numbered(documents: DataFrame) -> DataFrame:
    """doc_id, row, text (null: empty) of every row."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), row_hash().alias("row"), F.coalesce("text", F.lit("")).alias("text"))


def in_order(batch):
    """The batch's (doc_id, row, text) in the order in which occurrences count."""
    doc, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    last = None
    for i in np.lexsort((row, doc)).tolist():
        if (doc[i], row[i]) != last:  # equal rows share their ranges
            last = (doc[i], row[i])
            yield int(doc[i]), int(row[i]), batch.column(2)[i].as_py()


def multikey(char, n: int, depth: int, part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorts n strings by multikey quicksort: (order, seg), where positions of one seg hold strings equal in all characters.

    char(rows, c) gives character c, a 64-bit word, of the given strings. A level sorts each segment that is still open by
    one character, which splits it into lesser, equal and greater strings; only segments of equal ones stay open.
    With `part`, segments of strings of different parts are apart from the start.
    """
    order, seg, at = np.arange(n), np.zeros(n, np.int64), np.arange(n)
    for c in range(-1 if part is not None else 0, depth):
        if not len(at):
            break
        x, s = part[order[at]] if c < 0 else char(order[at], c), seg[at]
        apart = s[1:] != s[:-1]
        unlike = (x[1:] != x[:-1]) & ~apart
        if not unlike.any():
            continue  # each segment has one character here
        which = np.cumsum(np.append(False, apart))
        split = np.zeros(which[-1] + 1, bool)
        split[which[1:][unlike]] = True
        split = split[which]
        own, x, s = at[split], x[split], s[split]
        k = np.lexsort((x, s)) if s[0] != s[-1] else np.argsort(x, kind="stable")
        x, order[own] = x[k], order[own][k]
        new = np.ones(len(own), bool)
        new[1:] = (x[1:] != x[:-1]) | (s[1:] != s[:-1])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(own)))
        seg[own] = own[first].repeat(size)
        still = np.ones(len(at), bool)
        still[split] = (size > 1).repeat(size)
        at = at[still]
    return order, seg


class Strings:
    """Byte strings one after the other, with their characters of eight bytes, the first in front."""

    def __init__(self, parts: list[bytes]):
        self.size = np.fromiter(map(len, parts), np.int64, len(parts))
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(parts) + bytes(8), np.uint8)

    def char(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The character at a place of which `left` bytes count, the others being zero."""
        x = self.data[np.minimum(at, len(self.data) - 8)[:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
        left = np.clip(left, 0, 8).astype(np.uint64)
        return np.where(left > 0, x & ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(left, np.uint64(1))), np.uint64(0))

    def whole(self, rows: np.ndarray, c: int) -> np.ndarray:
        """Character c of whole strings; character 0 is the length."""
        return self.size[rows].astype(np.uint64) if c == 0 else self.char(self.start[rows] + 8 * (c - 1), self.size[rows] - 8 * (c - 1))


class Bytes:
    """Tokens that are bytes."""

    @staticmethod
    def length(part: bytes) -> int:
        return len(part)

    @staticmethod
    def cut(part: bytes, window: int) -> list[bytes]:
        return [part[i : i + window] for i in range(len(part) - window + 1)]

    @staticmethod
    def windows(parts: list[bytes], window: int):
        """(string of each window, its place in it, characters, depth)."""
        s = Strings(parts)
        n = s.size - window + 1
        of = np.repeat(np.arange(len(parts)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = s.start[of] + at
        return of, at, lambda rows, c: s.char(place[rows] + 8 * c, np.full(len(rows), window - 8 * c)), -(-window // 8)


class Words:
    """Tokens that are words, joined by single spaces."""

    @staticmethod
    def length(part: bytes) -> int:
        return part.count(b" ") + 1

    @staticmethod
    def cut(part: bytes, window: int) -> list[bytes]:
        w = part.split(b" ")
        return [b" ".join(w[i : i + window]) for i in range(len(w) - window + 1)]

    @staticmethod
    def windows(parts: list[bytes], window: int):
        ids: dict[bytes, int] = {}
        words = [x.split(b" ") for x in parts]
        size = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.fromiter((ids.setdefault(w, len(ids)) for x in words for w in x), np.uint64, int(size.sum()))
        n = size - window + 1
        of = np.repeat(np.arange(len(parts)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = (np.cumsum(size) - size)[of] + at
        pair = (codes << np.uint64(32)) | np.append(codes[1:], np.uint64(0)) if window > 1 else codes
        last = codes[window - 1 :] if window % 2 else None

        def char(rows, c):
            return pair[place[rows] + 2 * c] if 2 * c + 1 < window else last[place[rows]]

        return of, at, char, -(-window // 2)


def earliest(seg: np.ndarray, order: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray, by_doc: bool) -> np.ndarray:
    """Which of the sorted strings have an equal one that counts earlier: in a smaller doc_id, if by_doc."""
    out = np.zeros(len(seg), bool)
    tied = np.zeros(len(seg), bool)
    tied[1:] = seg[1:] == seg[:-1]
    tied[:-1] |= tied[1:]
    seg, order = seg[tied], order[tied]
    k = np.lexsort((start[order], row[order], doc[order], seg))
    seg, order = seg[k], order[k]
    doc, row, start = doc[order], row[order], start[order]
    new = np.ones(len(seg), bool)
    new[1:] = seg[1:] != seg[:-1]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = doc[first] < doc
    if not by_doc:
        later |= (doc[first] == doc) & ((row[first] < row) | ((row[first] == row) & (start[first] < start)))
    out[order] = later
    return out


def repeated(keys: list[np.ndarray], doc: np.ndarray, row: np.ndarray, start: np.ndarray, part, by_doc: bool) -> np.ndarray:
    """Which of a task's strings equal an earlier one of them: sorted by their keys, and by part(i), their bytes, where these tie."""
    order = np.lexsort(keys)
    same = np.ones(len(order) - 1, bool)
    for k in keys:
        same &= k[order[1:]] == k[order[:-1]]
    tied = np.zeros(len(order), bool)
    tied[1:] = same
    tied[:-1] |= same
    out = np.zeros(len(order), bool)
    rows = order[tied]
    if len(rows):
        s = Strings([part(i) for i in rows.tolist()])
        at, seg = multikey(s.whole, len(rows), 1 + -(-int(s.size.max()) // 8), np.cumsum(~np.append(False, same))[tied])
        out[rows] = earliest(seg, at, doc[rows], row[rows], start[rows], by_doc)
    return out


class Bucket:
    """Compares runs that met in a bucket, each a packed string."""

    def __init__(self, tokens, window: int, by_doc: bool):
        self.tokens, self.window, self.by_doc = tokens, window, by_doc

    def removed(self, group: np.ndarray, alone: np.ndarray, doc, row, start, parts: list[bytes]):
        """Ranges to remove, (doc_id, row, a, b) arrays, and which runs are not removed as a whole.

        group: which runs met; alone: runs whose windows may repeat within the run itself.
        """
        s = Strings(parts)
        order, seg = multikey(s.whole, len(parts), 1 + -(-int(s.size.max()) // 8), group)
        whole = earliest(seg, order, doc, row, start, self.by_doc)
        gone = np.flatnonzero(whole)
        length = np.fromiter((self.tokens.length(parts[i]) for i in gone.tolist()), np.int64, len(gone))
        out = [(doc[gone], row[gone], start[gone], start[gone] + length)]
        rest = np.flatnonzero(~whole)
        _, at, met = np.unique(group[rest], return_inverse=True, return_counts=True)
        rest = rest[(met[at] > 1) | alone[rest]]
        if len(rest):
            of, place, char, depth = self.tokens.windows([parts[i] for i in rest.tolist()], self.window)
            run = rest[of]
            order, seg = multikey(char, len(of), depth)
            again = np.flatnonzero(earliest(seg, order, doc[run], row[run], start[run] + place, self.by_doc))
            out.append(self.ranges(of[again], doc[run[again]], row[run[again]], start[run[again]] + place[again]))
        return [np.concatenate(x) for x in zip(*out, strict=True)], ~whole

    def ranges(self, run, doc, row, start):
        """Windows in order, as ranges of tokens; neighbours of one run are merged."""
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(run)) - 1 if len(run) else first
        return doc[first], row[first], start[first], start[last] + self.window


#: A group of more runs than this does not stay in one task.
GROUP_ROWS = 20_000
#: What buckets give: ranges (part is null), or windows that go on as strings of their own.
FOUND = "doc_id long, row long, a long, b long, part binary"


def found(doc, row, a, b, part=None) -> pa.RecordBatch:
    numbers = [pa.array(x, pa.int64()) for x in (doc, row, a, b)]
    return pa.RecordBatch.from_arrays([*numbers, pa.nulls(len(doc), pa.binary()) if part is None else pa.array(part, pa.binary())], names=["doc_id", "row", "a", "b", "part"])


def groups(batches, limit: int, keep_ends: bool = False):
    """Tables of whole groups of equal (k1, k2), of those with several rows or a row that may repeat within itself; batches are sorted by them.

    Yields (table, hot): hot tables are pieces of one group of over `limit` rows. With keep_ends, the first and the last group
    come even if they have one row.
    """
    carry, hot, ends = None, None, keep_ends
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if carry is not None:
            t = pa.concat_tables([carry, t])
        k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
        if hot is not None:
            m = int(np.argmin(np.append((k1 == hot[0]) & (k2 == hot[1]), False)))
            if m:
                yield t.slice(0, m), True
            t, k1, k2 = t.slice(m), k1[m:], k2[m:]
        if not len(k1):
            carry = None
            continue
        same = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
        last = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if last:
            some = t.slice(0, last)
            tied = np.zeros(last, bool)
            tied[1:] = same[: last - 1]
            tied[:-1] |= same[: last - 1]
            tied |= some.column("alone").to_numpy()
            if ends:
                tied[: int(np.argmin(np.append(same[: last - 1], False))) + 1] = True
                ends = False
            if tied.any():
                yield some.filter(pa.array(tied)), False
        carry, hot = t.slice(last), None
        if carry.num_rows > limit:
            yield carry, True
            carry, hot = None, (int(k1[-1]), int(k2[-1]))
    if carry is not None and (carry.num_rows > 1 or keep_ends or carry.column("alone")[0].as_py()):
        yield carry, False


def columns(t: pa.Table):
    number = lambda c: t.column(c).to_numpy()
    return number("k1"), number("k2"), number("doc_id"), number("row"), number("a"), t.column("alone").to_numpy(), t.column("part").to_pylist()


#: Runs whose windows are sorted at once before they go on.
SOME_RUNS = 2000


def windows_of(t: pa.Table, bucket: Bucket):
    """The windows of t's runs as strings that go on, sorted; equal ones that come next to each other are settled here."""
    _, _, doc, row, start, _, parts = columns(t)
    for lo in range(0, len(parts), SOME_RUNS):
        rows = []
        for i in range(lo, min(lo + SOME_RUNS, len(parts))):
            rows += [(w, int(doc[i]), int(row[i]), int(start[i]) + j) for j, w in enumerate(bucket.tokens.cut(parts[i], bucket.window))]
        rows.sort()
        ranges, more, first = [], [], (None,)
        for r in rows:
            if r[0] != first[0]:
                first = r
                more.append(r)
            elif first[1] < r[1] if bucket.by_doc else first < r:
                ranges.append(r)
            else:
                more.append(r)
        for some, part in ((ranges, False), (more, True)):
            if some:
                w, d, r, at = zip(*some, strict=True)
                yield found(d, r, at, [x + bucket.window for x in at], w if part else None)


def in_buckets(dealt: DataFrame, bucket: Bucket, edges: bool = False) -> DataFrame:
    """FOUND rows of dealt rows (k1, k2, doc_id, row, a, b, alone, part), which lie together and sorted by k1 and k2.

    Rows without part are ranges and pass. With `edges`, a group may go over a partition's end: what is left of the first and the last
    group of a partition goes on window by window, to be compared across the boundary.
    """
    limit = GROUP_ROWS

    def run(batches):
        settled = []

        def strings():
            for batch in batches:
                no_part = pc.is_null(batch.column("part"))
                if pc.any(no_part).as_py():
                    settled.append(batch.filter(no_part))
                    batch = batch.filter(pc.invert(no_part))
                if batch.num_rows:
                    yield batch

        def flush():
            while settled:
                b = settled.pop()
                yield found(*(b.column(c).to_numpy() for c in ("doc_id", "row", "a", "b")))

        first, last = True, None
        for t, hot in groups(strings(), limit, edges):
            yield from flush()
            if hot:
                yield from windows_of(t, bucket)
                continue
            k1, k2, doc, row, start, alone, parts = columns(t)
            new = np.ones(len(k1), bool)
            new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            number = np.cumsum(new)
            ranges, left = bucket.removed(number, alone, doc, row, start, parts)
            if len(ranges[0]):
                yield found(*ranges)
            if edges:
                if first:
                    yield from windows_of(t.filter(pa.array(left & (number == 1))), bucket)
                first, last = False, t.filter(pa.array(left & (number == number[-1])))
        if last is not None:
            yield from windows_of(last, bucket)
        yield from flush()

    return dealt.select("k1", "k2", "doc_id", "row", "a", "b", "alone", "part").mapInArrow(lean(run), FOUND)


def ranges_of(out: DataFrame) -> DataFrame:
    return out.where("part IS NULL").select("doc_id", "row", "a", "b")


def single_windows(out: DataFrame, by_doc: bool, n: int) -> DataFrame:
    """Ranges of windows that went on as strings of their own: sorted by Spark, then each is compared with the one before it."""
    strings = out.where("part IS NOT NULL").select("part", "doc_id", "row", "a", "b")
    dealt = strings.repartitionByRange(n, "part").sortWithinPartitions("part", "doc_id", "row", "a")

    def run(batches):
        last, first = None, None
        for batch in batches:
            rows = []
            for part, doc, row, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if part != last:
                    last, first = part, (doc, row, a)
                elif (first[0] < doc) if by_doc else (first < (doc, row, a)):
                    rows.append((doc, row, a, b))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "row", "a", "b"])

    return dealt.mapInArrow(lean(run), "doc_id long, row long, a long, b long")


def collected(ranges: DataFrame) -> DataFrame:
    """Ranges (doc_id, row, a, b) of each row in one array; its size is bounded by its own document."""
    return ranges.groupBy("doc_id", "row").agg(F.collect_list(F.expr("shiftleft(CAST(a AS LONG), 32) | CAST(b AS LONG)")).alias("ranges"))


def merged(packed, n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted(packed):
        a, b = x >> 32, min(x & 0xFFFFFFFF, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def touched(docs: DataFrame, ranges) -> DataFrame:
    """Texts of the rows for which ranges() gives any, with them: (doc_id, row, text, ranges); of equal rows one."""
    some = finished(lambda: collected(ranges()))
    texts = maybe_in(docs.where("doc_id IS NOT NULL").select("doc_id", "row", "text"), some, "row")
    return texts.join(some, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])


def with_results(every: DataFrame, some: DataFrame) -> DataFrame:
    """every (doc_id, row, ...) with what `some` has for its rows, by a join that keeps rows without doc_id."""
    mine = some.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), *[c for c in some.columns if c not in ("doc_id", "row")])
    return every.join(mine, (every["row"] == mine["_r"]) & (every["doc_id"] == mine["_d"]), "left").drop("_d", "_r")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
