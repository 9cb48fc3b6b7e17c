"""Token counts by rank-synchronous merging of batched pre-tokens.

For a lower-casing BPE vocabulary with word ends (white space dropped), a text's count is
the sum over its white-space-delimited words.  Words not met before in the worker are
normalised (NFC, lower case), split into pre-tokens by the vocabulary's pattern, and all
pre-tokens of the batch are merged together as ragged arrays (:mod:`bpe_merge`); what
survives is counted.  Counts of words are kept in a bounded table.

Defined cases: a null or empty text has 0 bytes and 0 tokens; equal rows each keep their
row; a special string inside a text counts as one token, as the tokenizers library does
by default; an empty table gives no row; other columns of the input are not read.  A
text of any length is processed whole: a pre-token too long for the ragged arrays is
merged by a priority queue.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe_merge import PairTable, merge_ragged
from .common import document_columns, slices

COUNT_LIMIT = 2048


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {b: chr(b) for b in shown}
    for b in range(256):
        stand_in.setdefault(b, chr(256 + len(stand_in) - len(shown)))
    return [stand_in[b] for b in range(256)]


class TokenCounter:
    """``count(texts)`` for UTF-8 texts by one tokenizer file."""

    def __init__(self, path: str, limit: int = 400_000, limit_bytes: int = 32 << 20):
        import regex
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not self.suffix:
            raise ValueError("counts are for lower-casing BPE files with word ends")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = PairTable([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs],
                               range(len(pairs)), [vocab[a + b] for a, b in pairs])
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols])
        self.final = np.array([vocab[s + self.suffix] for s in symbols])
        self.cache: dict[bytes, int] = {}
        self.limit, self.limit_bytes, self.held = limit, limit_bytes, 0

    def count(self, texts: list[bytes]) -> list[int]:
        out = []
        for text in texts:
            if len(text) <= 4 << 20:
                out.append(self._count(text))
            else:  # a very long text: its words in blocks
                out.append(sum(self._count(part) for part in byte_blocks(text)))
        return out

    def prepare(self, texts: list[bytes]) -> None:
        """Count the new words of a batch together, so that their merges run together."""
        if len(self.cache) > self.limit or self.held > self.limit_bytes:
            self.cache.clear()
            self.held = 0
        self._learn(set().union(*[t.split() for t in texts if len(t) <= 4 << 20]))

    def _count(self, text: bytes) -> int:
        words = text.split()
        try:
            return sum(map(self.cache.__getitem__, words))
        except KeyError:
            self._learn(set(words))
            return sum(map(self.cache.__getitem__, words))

    def _learn(self, words: set[bytes]) -> None:
        new = list(words.difference(self.cache))
        if not new:
            return
        self.held += sum(map(len, new))
        extra = np.zeros(len(new), np.int64)
        owner, pre = [], []
        texts = [w.decode("utf-8") for w in new]
        joined = "\n".join(texts)
        if self.special.search(joined):
            for i, t in enumerate(texts):
                parts = self.special.split(t)
                extra[i] = len(parts) - 1
                for part in parts:
                    found = self._pre_tokens(part)
                    pre.extend(found)
                    owner.extend([i] * len(found))
        else:
            found = [self.pattern.findall(w) for w in self._normal(joined).split("\n")]
            pre = [p for f in found for p in f]
            owner = np.repeat(np.arange(len(new)), [len(f) for f in found])
        counts = extra
        if pre:
            raw = [p.encode("utf-8") for p in pre]
            lengths = np.array([len(r) for r in raw])
            values = np.frombuffer(b"".join(raw), dtype=np.uint8)
            symbols = self.inner[values]
            last = np.cumsum(lengths) - 1
            symbols[last] = self.final[values[last]]
            _, sizes = merge_ragged(symbols, lengths, self.table)
            counts = extra + np.bincount(np.asarray(owner, np.int64), weights=sizes,
                                         minlength=len(new)).astype(np.int64)
        self.cache.update(zip(new, counts.tolist()))

    def _pre_tokens(self, text: str) -> list[str]:
        return self.pattern.findall(self._normal(text))

    @staticmethod
    def _normal(text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text or "İ" in text:  # lower() looks at neighbours of a capital sigma; the library does not
            return "".join(c.lower() for c in text)
        return text.lower()


def byte_blocks(text: bytes, size: int = 2 << 20):
    """Cut a long text at spaces into blocks of about ``size`` bytes."""
    start, n = 0, len(text)
    while n - start > size:
        cut = text.find(b" ", start + size)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = COUNT_LIMIT,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    def count(batches):
        c = counter(tokenizer)
        for batch in slices(batches, 1024):
            texts = batch.column(1).to_pylist()
            c.prepare(texts)
            n = np.array(c.count(texts), dtype=np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    rows = document_columns(docs, binary=True, id_col=id_col, text_col=text_col)
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents for the word vocabulary."""
    from .library_ids import tokenizer_path
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        tokenizer_path("word_bpe_49k.json"))
