"""Substring dedup by seed and extend over winnowed anchors.

Words are runs of anything but ASCII white space.  A window is ``window`` consecutive
words.  Every window has one anchor: its smallest-hashed ``seed`` consecutive words (the
leftmost of equals), so equal windows have equal anchors at equal places, and an anchor
occurrence serves a run of consecutive windows.

* Seed: anchor occurrences of different documents are joined on the anchor's hash.
  Anchors that occur in one document only go no further.
* Extend, whole runs: occurrences whose runs hold the same words (hash of all words the
  run's windows reach) form one class; in all but the smallest document the whole run
  repeats, so its words are removed.
* Extend, parts of runs: where an anchor has several classes, the occurrences in each class's
  smallest document are extended word by word to both sides: their windows are compared with
  those of the other classes, and each window's smallest document is kept.

A document's removed words are the union of its repeated windows; adjoining windows make
maximal repeats (:func:`repeats` returns them).  Classes, windows and anchors are counted
with partial aggregates before their shuffles, so a passage that a third of all documents
share meets as one row per task, and no pair of occurrences is ever built.

Defined cases: texts that are null, empty or shorter than a window lose nothing; a window
repeated inside one document only, or in rows of equal ``doc_id``, stays; a null
``doc_id`` counts as 2^63-1, the largest; rows are told apart by id and a 64-bit hash of
the text, so repeated ids do no harm; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, slices

WINDOW = 50
SEED_WORDS = 10
#: Odd multipliers of the two polynomial word hashes (any odd numbers serve).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NO_ID = (1 << 63) - 1


class RollingHash:
    """Hashes of all runs of k words, modulo 2**64, by differences of prefix sums."""

    def __init__(self, base: int):
        self.base, self.back = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            with np.errstate(over="ignore"):
                for name, base in (("up", self.base), ("down", self.back)):
                    p = np.full(size, base, np.uint64)
                    p[0] = 1
                    setattr(self, name, np.multiply.accumulate(p))

    def prefix(self, words: np.ndarray) -> np.ndarray:
        self._grow(len(words) + 1)
        out = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[:len(words)], out=out[1:])
        return out

    def runs(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value's bits (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_ROLL: list[RollingHash] = []


def rolling() -> list[RollingHash]:
    if not _ROLL:
        _ROLL.extend(RollingHash(b) for b in BASES)
    return _ROLL


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest
    return np.array(list(map(xxh64_intdigest, words)), dtype=np.uint64)


def anchors_of(words: list[bytes], window: int, seed: int):
    """(anchor hash, position, first window, last window, run hash) of one document's anchors."""
    h = word_hashes(words)
    one, two = rolling()
    p1, p2 = one.prefix(h), two.prefix(h)
    at = np.arange(len(words) - seed + 1)
    grams = one.runs(p1, at, at + seed)
    n_windows = len(words) - window + 1
    span = window - seed + 1
    pos = np.empty(n_windows, np.int64)
    for i in range(0, n_windows, 1 << 15):  # bounded scratch for very long texts
        part = grams[i:i + (1 << 15) + span - 1]
        pos[i:i + (1 << 15)] = i + np.lib.stride_tricks.sliding_window_view(part, span).argmin(axis=1)[:n_windows - i]
    pos += np.arange(n_windows) - np.arange(n_windows) // (1 << 15) * (1 << 15)
    first = np.flatnonzero(np.r_[True, pos[1:] != pos[:-1]])
    last = np.r_[first[1:], n_windows] - 1
    p = pos[first]
    return grams[p], p, first, last, two.runs(p2, first, last + window)


ANCHORS = "anchor long, run long, doc long, tie long, pos int, head int, tail int"


def _documents(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc, tie, text, no_id): the id with null as the largest, and a hash that tells texts apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = [F.struct(F.col("text").isNull().alias("no_text"),
                     F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row")).alias("rest")] * carry
    doc_id = F.col("doc_id").cast("long")
    return (docs.select(F.coalesce(doc_id, F.lit(NO_ID)).alias("doc"), text.alias("text"), doc_id.isNull().alias("no_id"), *rest)
            .select("doc", F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("text"), "no_id",
                    *["rest"] * carry))


def _packed(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc, tie, body): texts compressed, for a smaller shuffle.

    With ``carry`` a struct ``rest`` holds all columns but the text, and whether it was null.
    """
    def squeeze(batches):
        import zstandard
        packer = zstandard.ZstdCompressor(level=3)
        for batch in slices(batches, 512):
            body = pa.array([packer.compress(t) for t in batch.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], body, *batch.columns[3:]],
                names=["doc", "tie", "body", "no_id", "rest"][:batch.num_columns])

    rows = _documents(docs, carry)
    schema = T.StructType([f if f.name != "text" else T.StructField("body", T.BinaryType()) for f in rows.schema])
    return rows.mapInArrow(squeeze, schema)


def _text(body: bytes) -> bytes:
    import zstandard
    return zstandard.ZstdDecompressor().decompress(body)


def anchors(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """Every anchor occurrence: ``head``/``tail`` are the first and last window's distance
    before the anchor, ``run`` the hash of all words that its windows reach."""
    def run(batches):
        names = ["anchor", "run", "doc", "tie", "pos", "head", "tail"]
        for batch in slices(batches, 256):
            cols = [[] for _ in names]
            for doc, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = text.split()
                if len(words) < window:
                    continue
                a, p, first, last, whole = anchors_of(words, window, seed)
                n = len(p)
                for c, v in zip(cols, (a.view(np.int64), whole.view(np.int64), np.full(n, doc), np.full(n, tie),
                                       p, p - first, p - last)):
                    c.append(v)
            if cols[0]:
                kinds = [np.int64] * 4 + [np.int32] * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds)], names=names)

    return _documents(docs).mapInArrow(run, ANCHORS)


def repeated_windows(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """(doc, tie, first, last): inclusive ranges of window positions that repeat a smaller document's."""
    found = materialize(anchors(docs, window, seed), "anchors")
    # what is joined back is written first: a join of two plain shuffles is one whose hot
    # keys adaptive execution splits, which it does not where an aggregate shares the stage
    seeds = materialize(found.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                        .where("low < high").select("anchor"), "seeds")
    shared = materialize(found.join(seeds, "anchor", "left_semi"), "shared-anchors")
    key = ["anchor", "run", "head", "tail"]
    classes = materialize(shared.groupBy(*key).agg(F.min(F.struct("doc", "tie", "pos")).alias("low")), "classes")
    whole = (shared.join(classes, key).where(F.col("doc") > F.col("low.doc"))
             .select("doc", "tie", (F.col("pos") - F.col("head")).alias("first"),
                     (F.col("pos") - F.col("tail")).alias("last")))
    several = materialize(classes.groupBy("anchor").count().where("count > 1").select("anchor"), "split-anchors")
    partly = (shared.join(classes, key).where(F.col("doc") == F.col("low.doc"))
              .join(several, "anchor", "left_semi")
              .select("doc", "tie", "pos", "head", "tail")
              .groupBy("doc", "tie").agg(F.collect_set(F.struct("pos", "head", "tail")).alias("runs")))
    once = _packed(docs).dropDuplicates(["doc", "tie"])  # equal rows have equal windows
    windows = materialize(_extend(once.join(partly, ["doc", "tie"]), window), "windows")
    lowest = materialize(windows.groupBy("w1", "w2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                         .where("low < high"), "low-windows")
    parts = (windows.join(lowest, ["w1", "w2"]).where("doc > low")
             .select("doc", "tie", F.col("at").alias("first"), F.col("at").alias("last")))
    return whole.unionByName(parts)


def _extend(rows: DataFrame, window: int) -> DataFrame:
    """The windows around given anchors, one row each: (w1, w2, doc, tie, at)."""
    def run(batches):
        one, two = rolling()
        for batch in slices(batches, 64):
            cols = [[] for _ in range(5)]
            for doc, tie, body, runs in zip(*(batch.column(i).to_pylist() for i in range(4))):
                h = word_hashes(_text(body).split())
                at = np.unique(np.concatenate([np.arange(r["pos"] - r["head"], r["pos"] - r["tail"] + 1)
                                               for r in runs]))
                for c, v in zip(cols, (one.runs(one.prefix(h), at, at + window).view(np.int64),
                                       two.runs(two.prefix(h), at, at + window).view(np.int64),
                                       np.full(len(at), doc), np.full(len(at), tie), at)):
                    c.append(v)
            kinds = [np.int64] * 4 + [np.int32]
            if cols[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(k)) for c, k in zip(cols, kinds)],
                    names=["w1", "w2", "doc", "tie", "at"])

    return rows.select("doc", "tie", "body", "runs").mapInArrow(run, "w1 long, w2 long, doc long, tie long, at int")


def repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """Maximal repeats per document: (doc, tie, spans) with sorted, disjoint word ranges
    [from, to), each of at least ``window`` words."""
    ranges = materialize(repeated_windows(docs, window, seed).distinct(), "repeats")
    grouped = ranges.groupBy("doc", "tie").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("r"))

    def merge(batches):
        for batch in batches:
            spans = []
            for r in batch.column(2).to_pylist():
                first = np.array([x["first"] for x in r])
                end = np.maximum.accumulate(np.array([x["last"] for x in r]) + window)
                begin = np.flatnonzero(np.r_[True, first[1:] > end[:-1]])
                stop = np.r_[begin[1:], len(first)] - 1
                spans.append([{"from": int(a), "to": int(b)} for a, b in zip(first[begin], end[stop])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(spans, pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))],
                names=["doc", "tie", "spans"])

    return grouped.mapInArrow(merge, "doc long, tie long, spans array<struct<from:int,to:int>>")


def kept_words(words: list[bytes], spans) -> list[bytes]:
    if not spans:
        return words
    out, at = [], 0
    for s in spans:
        out += words[at:s["from"]]
        at = s["to"]
    return out + words[at:]


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """All columns of ``docs`` as struct ``row``, and text, n_words, n_removed, spans.

    ``text`` is the original (null as null) where nothing was removed, else the words left,
    joined by one space.
    """
    found = _apply(docs, window, seed, lambda text, left, n: text if not n else b" ".join(left), "text", carry=True)
    return found.select("rest.row", F.when(~F.col("rest.no_text"), F.col("text")).alias("text"),
                        "n_words", "n_removed", "spans")


def kept_digests(docs: DataFrame, window: int = WINDOW, seed: int = SEED_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words left, joined by one space."""
    return _apply(docs, window, seed, lambda text, left, n: hashlib.sha256(b" ".join(left)).hexdigest().encode(),
                  "kept_sha256").drop("spans")


def _apply(docs, window, seed, shape, name, carry=False):
    found = repeats(docs, window, seed)
    rows = _packed(docs, carry).join(found, ["doc", "tie"], "left").select("doc", "body", "spans", "no_id", *["rest"] * carry)
    span = "array<struct<from:int,to:int>>"

    def cut(batches):
        for batch in slices(batches, 256):
            n_words, n_removed, kept = [], [], []
            for body, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = _text(body)
                words = text.split()
                left = kept_words(words, spans)
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(shape(text, left, n_removed[-1]).decode())
            doc, no_id = batch.column(0).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64(), mask=no_id), pa.array(n_words, pa.int64()),
                 pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), batch.column(2), *batch.columns[4:]],
                names=["doc_id", "n_words", "n_removed", name, "spans", "rest"][:batch.num_columns + 1])

    out = T.StructType.fromDDL(f"doc_id long, n_words long, n_removed long, {name} string, spans {span}")
    return rows.mapInArrow(cut, T.StructType([*out, *([rows.schema["rest"]] if carry else [])]))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove 50-word windows that also start in a smaller document; digest of what is kept."""
    return kept_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s
        FROM d, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN low USING (s) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM hit, unnest(range(0, 50)) AS t(j)),
word AS (SELECT doc_id, i AS p, w[i] AS x FROM d, unnest(range(1, len(w) + 1)) AS t(i)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS k
         FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
