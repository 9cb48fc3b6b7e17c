"""Plain restatements that the operators are compared with."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept(rows, window=50):
    """(doc_id, words, words kept) of each (doc_id, text); a null id counts as the largest."""
    key = [(float("inf") if i is None else i) for i, _ in rows]
    words = [WORD.findall(t or "") for _, t in rows]
    low = {}
    for k, w in zip(key, words):
        for i in range(len(w) - window + 1):
            s = tuple(w[i:i + window])
            low[s] = min(low.get(s, k), k)
    out = []
    for (i, _), k, w in zip(rows, key, words):
        gone = set()
        for j in range(len(w) - window + 1):
            if low[tuple(w[j:j + window])] < k:
                gone.update(range(j, j + window))
        out.append((i, w, [x for j, x in enumerate(w) if j not in gone]))
    return out


def digest(words):
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def simhash(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    parts = [" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, max_bits):
    """The smallest index each value is connected with."""
    v = np.array(values, np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= max_bits
    out = [-1] * len(v)
    for i in range(len(v)):
        if out[i] < 0:
            todo = [i]
            out[i] = i
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if out[j] < 0:
                        out[j] = i
                        todo.append(j)
    return out
