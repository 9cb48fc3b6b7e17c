"""Token ids of whole texts by the ``tokenizers`` library, at several times its speed.

A text falls into segments that the library tokenises independently of each other.  Each
distinct segment is sent to the library once and its ids are kept in two bounded tables (a
full one becomes the older one, from which segments met again return); a document's ids are
the joined ids of its segments.  Segments not seen before are joined
by a separator and encoded together, and their ids are told apart by byte length.

Two layouts are recognised by the tokenizer file: byte-level BPE with its usual split
pattern, and lower-casing BPE with word ends, which drops white space.  Texts that hold
a special string or an unusual control character, and all texts of any other layout, go
to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

#: Unicode white space as the split patterns see it (Python's ``\s`` adds U+001C-001F).
_SEGMENT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: A letter or digit, then punctuation to the end: the split pattern cuts between them.
_TAIL = re.compile("(.*[A-Za-z0-9À-ÖØ-öø-ÿ])([,.;:!?]+)")
_ODD = re.compile("[\x1c-\x1f\x85\u180e]")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
GROUP = 256
BLOCK = 1 << 20


def text_blocks(text: str, size: int = BLOCK):
    """Cut a very long text before single spaces between words; most texts stay whole."""
    start, n = 0, len(text)
    while n - start > size:
        cut = _SAFE_CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


class LibraryIds:
    """``encode(texts)`` gives the ids of each text as little-endian uint32 bytes."""

    def __init__(self, path: str, limit: int | None = None, limit_bytes: int = 32 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.kind = _layout(spec)
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        vocab = self.tok.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            cut = len(self.suffix) if self.suffix and token.endswith(self.suffix) else 0
            self.bytes_of[i] = len(token) - cut
        self.cache: dict = {}
        self.older: dict = {}
        # words recur more than segments with their punctuation, so a smaller table serves
        self.limit = limit or (300_000 if self.kind == "word" else 600_000)
        self.limit_bytes, self.held = limit_bytes, 0

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes()
                for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list = [None] * len(texts)
        todo, plain = [], []
        for i, text in enumerate(texts):
            if self.kind == "whole" or _ODD.search(text) or any(s in text for s in self.special):
                out[i] = self.whole([text])[0]
            elif len(text) > BLOCK:
                out[i] = b"".join(x for part in text_blocks(text) for x in self._join([part]))
            else:
                todo.append(i)
                plain.append(text)
        for i, ids in zip(todo, self._join(plain)):
            out[i] = ids
        return out

    def _join(self, texts: list[str]) -> list[bytes]:
        if self.kind == "word":
            parts = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        else:
            parts = [_SEGMENT.findall(t) for t in texts]
        cache = self.cache
        found = [list(map(cache.get, p)) for p in parts]
        gaps = [(f, p, [j for j, ids in enumerate(f) if ids is None]) for f, p in zip(found, parts) if None in f]
        if gaps:
            self._learn(set().union(*[[p[j] for j in at] for _, p, at in gaps]))
            for f, p, at in gaps:
                for j in at:
                    f[j] = cache[p[j]]
        if len(cache) > self.limit or self.held > self.limit_bytes:
            # what is met again comes back from the older table; the rest goes with it
            self.older, self.cache, self.held = cache, {}, 0
        return [b"".join(f) for f in found]

    def _learn(self, missing: set) -> None:
        """Put the ids of segments into the table: from the older one, from a segment's two
        parts where punctuation follows a letter or digit, or from the library."""
        cache, older, new, joined = self.cache, self.older, set(), []
        for s in missing:
            ids = older.get(s)
            if ids is not None:
                cache[s] = ids
                continue
            cut = _TAIL.fullmatch(s) if self.kind == "byte" else None
            if cut is None:
                new.add(s)
                continue
            joined.append((s, *cut.groups()))
            for part in cut.groups():
                if part not in cache and part not in missing:
                    ids = older.get(part)
                    if ids is None:
                        new.add(part)
                    else:
                        cache[part] = ids
        if new:
            self._fill(list(new))
        for s, head, tail in joined:
            cache[s] = cache[head] + cache[tail]

    def _fill(self, new: list) -> None:
        self.held += sum(map(len, new))
        alone = []
        if self.kind == "word":
            names = [s.decode("utf-8", "surrogatepass") for s in new]
            order = range(len(new))
            sep = " "
        else:
            names = new
            order = [i for i, s in enumerate(new) if not s.isspace()]
            alone = [i for i, s in enumerate(new) if s.isspace()]
            sep = "\n"
        order = list(order)
        groups = [order[i:i + GROUP] for i in range(0, len(order), GROUP)]
        encoded = self.tok.encode_batch_fast([sep.join(names[i] for i in g) for g in groups],
                                             add_special_tokens=False)
        for g, enc in zip(groups, encoded):
            ids = np.array(enc.ids, dtype="<u4")
            ends = np.cumsum(self.bytes_of[ids])
            begins = ends - self.bytes_of[ids]
            gap = 0 if self.kind == "word" else 1  # the separator itself has a token
            sizes = self._sizes([names[i] for i in g])
            first = np.cumsum(sizes + gap) - (sizes + gap)
            total = int(ends[-1]) if len(ends) else 0
            lo = np.searchsorted(begins, first)
            hi = np.searchsorted(begins, first + sizes)
            edge = np.append(ends, 0)
            if (total != int(sizes.sum()) + gap * (len(g) - 1)
                    or not np.array_equal(edge[hi - 1][sizes > 0], (first + sizes)[sizes > 0])):
                alone.extend(g)  # lengths that do not add up: one by one
                continue
            raw = ids.tobytes()
            for i, a, b in zip(g, (4 * lo).tolist(), (4 * hi).tolist()):
                self.cache[new[i]] = raw[a:b]
        if alone:
            for i, ids in zip(alone, self.whole([names[i] for i in alone])):
                self.cache[new[i]] = ids

    def _sizes(self, names: list[str]) -> np.ndarray:
        """Bytes of each segment as the model sees it."""
        if self.kind == "word":
            import unicodedata
            names = [unicodedata.normalize("NFC", n).lower() for n in names]
        return np.array([len(n.encode("utf-8", "surrogatepass")) for n in names], dtype=np.int64)


def _layout(spec: dict) -> str:
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    model = spec["model"]
    if (model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback")
            or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])):
        return "whole"
    if norm is None and pre.get("type") == "ByteLevel" and not pre["add_prefix_space"] and pre["use_regex"]:
        return "byte"
    kinds = [n.get("type") for n in (norm or {}).get("normalizers", [])]
    steps = pre.get("pretokenizers", [])
    if (kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0]["type"] == "Split"
            and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
            and "[^\\s" in steps[0]["pattern"].get("Regex", "") and steps[1]["type"] == "ByteLevel"):
        return "word"
    return "whole"


_ENCODERS: dict[str, LibraryIds] = {}


def encoder(path: str) -> LibraryIds:
    """One encoder per Python worker and file; its table outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryIds(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def encode_rows(path: str, texts: list[str], chunk_chars: int = 4 << 20) -> list[bytes]:
    """Ids of each text, taken in chunks of bounded size."""
    enc, out, part, size = encoder(path), [], [], 0
    for t in chain(texts, [None]):
        if t is None or size > chunk_chars:
            out.extend(enc.encode(part))
            part, size = [], 0
        if t is not None:
            part.append(t)
            size += len(t)
    return out
