"""Plain single-process versions of the operators, for tests on small inputs."""

import hashlib
import re
import zlib

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def substring(docs, window=50):
    """docs: (doc_id, text) pairs -> doc_id, n_words, n_removed, sha."""
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return sorted(out)


def suffix(docs, length=100):
    first = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            k = b[i : i + length]
            first[k] = min(first.get(k, (d, i)), (d, i))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d, i):
                gone[i : i + length] = b"\1" * length
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return sorted(out)


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(docs):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, r in sets[:i]:
            if s and r and 100 * len(s & r) >= 75 * len(s | r):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d), find(d) == d) for d, s in sets)


def crc_ids(ids):
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))


def lines(docs, window=3):
    docs = sorted(docs, key=lambda x: x[0])
    seen, out = set(), []
    for d, t in docs:
        ls = (t or "").split("\n")
        gone = [False] * len(ls)
        for i in range(len(ls) - window + 1):
            k = "\n".join(ls[i : i + window])
            if not words(k):
                continue
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = [x for x, g in zip(ls, gone) if not g]
        out.append((d, len(ls), sum(gone), sha("\n".join(kept))))
    return sorted(out)
