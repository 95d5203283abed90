"""Numbers for words: a worker's exact table of the words it has met, looked up by the batch.

Words are found by a hash of their bytes, and each hit is then compared with the stored word, eight bytes at a time; what
differs although the hash is the same, and very long words, stand in a dictionary of their own. So equal numbers mean equal words whatever the hash does.
"""

from __future__ import annotations

import re

import numpy as np

from hearthline.llm.common import Powers, word_hashes, word_spans

#: Words that one table keeps before it starts over, their bytes, and the longest word looked up by its hash.
KEPT_WORDS = 1_000_000
KEPT_BYTES = 24_000_000
LONGEST = 256

_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")
_BREAK = re.compile(rb"[ \t\n\x0b\x0c\r]")


class Grown:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.a, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.a):
            a = np.zeros(self.n + len(more) + len(self.a) // 2, self.a.dtype)
            a[: self.n] = self.a[: self.n]
            self.a = a
        self.a[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def view(self) -> np.ndarray:
        return self.a[: self.n]


class Words:
    """Subclasses keep a value by number: `added` is given new words in the order of their numbers, `cleared` says that numbers start over."""

    def __init__(self) -> None:
        self.powers = Powers()
        self.clear()

    def added(self, words: list[bytes]) -> None:
        raise NotImplementedError

    def cleared(self) -> None:
        raise NotImplementedError

    def full(self) -> bool:
        return self.count > KEPT_WORDS or 8 * self.pool.n + self.odd_bytes > KEPT_BYTES

    def clear(self) -> None:
        self.key, self.num = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.pool, self.at, self.size = Grown("<u8"), Grown(np.int32), Grown(np.int32)
        self.odd: dict[bytes, int] = {}
        self.odd_bytes = self.count = 0
        self.cleared()

    def _differs(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Which places hold other bytes than the word of that number; data has eight bytes to spare."""
        out = size != self.size.view[number]
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        left, k = np.flatnonzero(~out), 0
        while len(left):
            here = eight[start[left] + 8 * k] & _MASKS[np.minimum(size[left] - 8 * k, 8)]
            out[left] |= here != self.pool.view[self.at.view[number[left]] + k]
            k += 1
            left = left[size[left] > 8 * k]
        return out

    def _store(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        """Puts the bytes of these words at the end of the pool, filled up with zeros to eight."""
        cells = -(-size // 8)
        first = np.cumsum(cells) - cells
        rows = np.repeat(np.arange(len(size)), cells)
        k = np.arange(int(cells.sum())) - first[rows]
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        words = eight[start[rows] + 8 * k] & _MASKS[np.minimum(size[rows] - 8 * k, 8)]
        self.at.add(self.pool.n + first)
        self.size.add(size)
        self.pool.add(words)

    def numbers(self, joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of the word at each place of joined."""
        if self.full():
            self.clear()
        if not len(start):
            return np.zeros(0, np.int64)
        data = np.zeros(len(joined) + 8, np.uint8)
        data[: len(joined)] = np.frombuffer(joined, np.uint8)
        size = end - start
        own, first, back = np.unique(word_hashes(data, start, end, self.powers), return_index=True, return_inverse=True)
        i = np.searchsorted(self.key, own)
        known = self.key[np.minimum(i, len(self.key) - 1)] == own if len(self.key) else np.zeros(len(own), bool)
        new = np.flatnonzero(~known & (size[first] <= LONGEST))
        if len(new):
            at = first[new]
            self.added([joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
            self._store(data, start[at], size[at])
            self.key = np.insert(self.key, i[new], own[new])
            self.num = np.insert(self.num, i[new], np.arange(self.count, self.count + len(new)))
            self.count += len(new)
            i = np.searchsorted(self.key, own)
        if not len(self.key):
            number, wrong = np.zeros(len(start), np.int64), np.ones(len(start), bool)
        else:
            i = np.minimum(i, len(self.key) - 1)
            number, wrong = self.num[i][back], (self.key[i] != own)[back]
            some = np.flatnonzero(~wrong)
            wrong[some] = self._differs(data, start[some], size[some], number[some])
        for j in np.flatnonzero(wrong).tolist():
            word = joined[start[j] : end[j]]
            if word not in self.odd:
                self.added([word])
                self.at.add(np.zeros(1, np.int64))  # keeps places by number; never compared
                self.size.add(np.full(1, -1))
                self.odd[word] = self.count
                self.odd_bytes += len(word)
                self.count += 1
            number[j] = self.odd[word]
        return number


class Vocabulary(Words):
    """A fixed list of words, looked up; numbers are places in the list."""

    def __init__(self, words: list[bytes]):
        super().__init__()
        joined = b"\n".join(words)
        start, end = word_spans(np.frombuffer(joined, np.uint8))
        place = {w: i for i, w in enumerate(words)}
        if len(place) < len(words) or len(start) < len(words):
            raise ValueError("words of a vocabulary differ, and none is empty or has white space")
        self.numbers(joined, start, end)
        self.place = np.array([place[w] for w in self.order], np.int64)

    def added(self, words: list[bytes]) -> None:
        self.order += words

    def cleared(self) -> None:
        self.order: list[bytes] = []

    def find(self, joined: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The place of each word in the list, -1 for words that are not there."""
        out = np.full(len(start), -1, np.int64)
        if not len(start) or not self.count:
            return out
        data = np.zeros(len(joined) + 8, np.uint8)
        data[: len(joined)] = np.frombuffer(joined, np.uint8)
        size = end - start
        if len(self.key):
            h = word_hashes(data, start, end, self.powers)
            i = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            some = np.flatnonzero(self.key[i] == h)
            number = self.num[i[some]]
            same = ~self._differs(data, start[some], size[some], number)
            out[some[same]] = self.place[number[same]]
        if self.odd:
            fits = np.isin(size, [len(w) for w in self.odd]) & (out < 0)
            for j in np.flatnonzero(fits).tolist():
                n = self.odd.get(joined[start[j] : end[j]])
                if n is not None:
                    out[j] = self.place[n]
        return out


class WordIds(Words):
    """Token ids of words; `many` encodes a list of words, and the table starts over beyond `kept_words`."""

    #: Ids that the table keeps before it starts over.
    KEPT_IDS = 10_000_000

    def __init__(self, many, kept_words: int = KEPT_WORDS):
        self.many, self.kept_words = many, kept_words
        super().__init__()

    def cleared(self) -> None:
        self.ids, self.first, self.length = Grown("<u4"), Grown(np.int32), Grown(np.int32)

    def full(self) -> bool:
        return super().full() or self.count > self.kept_words or self.ids.n > self.KEPT_IDS

    def added(self, words: list[bytes]) -> None:
        encoded = self.many(words)
        length = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        self.first.add(self.ids.n + np.cumsum(length) - length)
        self.length.add(length)
        self.ids.add(np.frombuffer(b"".join(encoded), "<u4"))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        joined = b"\n".join(texts)
        start, end = word_spans(np.frombuffer(joined, np.uint8))
        number = self.numbers(joined, start, end)
        size = self.length.view[number]
        upto = np.cumsum(size)
        ids = self.ids.view[np.repeat(self.first.view[number] - upto + size, size) + np.arange(int(size.sum()))]
        length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        words = np.searchsorted(start, np.cumsum(length))  # words up to each text's end
        cuts = np.concatenate(([0], upto))[words]
        return [ids[a:b].tobytes() for a, b in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist(), strict=True)]


def units(texts, most: int):
    """Lists of (number of the text, bytes of it) of about `most` bytes together; long texts are cut at white space."""
    some, size = [], 0
    for i, text in enumerate(texts):
        raw, at = text if isinstance(text, bytes) else text.encode(), 0
        while True:
            cut = _BREAK.search(raw, at + most) if len(raw) - at > most else None
            to = cut.start() if cut else len(raw)
            some.append((i, raw[at:to]))
            size += to - at
            if size >= most:
                yield some
                some, size = [], 0
            at = to
            if not cut:
                break
    if some:
        yield some
