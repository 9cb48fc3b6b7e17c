"""Language identification by rank-order n-gram profiles.

A text is lower-cased, composed (NFC), and everything but letters becomes one space.  Its
1-, 2- and 3-grams (spaces mark word ends, none lies across a space) are ranked by count;
the ``PROFILE`` most frequent ones are its profile.  Each language's profile is ranked the
same way over its training texts.  A document is nearest to the language with the
smallest out-of-place distance: the sum, over the document's n-grams, of the difference
of the two ranks, or ``PROFILE`` where the language's profile lacks the n-gram.

The profiles are learnt from at most about ``sample_docs`` labelled documents of each
language, picked by a hash of their id; that bound is a parameter.  The learnt profiles
(``PROFILE`` n-grams a language) are all that comes to the driver.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no
labelled document all texts are ``und``; equal distances go to the language first in
order of name, equal counts to the n-gram of smaller code points; rows are judged one by
one, so equal rows each keep theirs; a null ``doc_id`` counts as held out (it has no
remainder that allows it to teach); an empty table gives no row.  Whole texts are read.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices

PROFILE = 400
SAMPLE_DOCS = 2000
UNKNOWN = "und"
_NO_LETTER = re.compile(r"[\W\d_]+")


def letters_only(text: str) -> str:
    """Lower-case words with one space around each; empty if the text has no letter."""
    words = _NO_LETTER.sub(" ", unicodedata.normalize("NFC", text).lower()).strip()
    if not any(map(str.isalpha, set(words))):
        return ""
    return f" {words} "


def grams(words: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits a character, and their counts."""
    cp = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = cp != 32
    two = cp[:-1] << 21 | cp[1:]
    three = two[:-1] << 21 | cp[2:]
    return np.unique(np.concatenate([cp[letter], two, three[letter[1:-1]]]), return_counts=True)


def profile(words: str, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    code, count = grams(words)
    if len(code) > size:  # only those that can be among the first
        least = np.partition(count, len(count) - size)[len(count) - size]
        code, count = code[count >= least], count[count >= least]
    return code[np.lexsort((code, -count))][:size]


class RankModel:
    """Language profiles as one table of ranks; ``judge`` gives the language and a score."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.names = sorted(profiles)
        self.size = size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.rank = np.full((len(self.names), len(self.codes)), -1, np.int64)
        for i, name in enumerate(self.names):
            self.rank[i, np.searchsorted(self.codes, np.array(profiles[name], np.int64))] = \
                np.arange(len(profiles[name]))

    def distances(self, text: str) -> np.ndarray | None:
        """Out-of-place distance to each language as a share of the largest possible one."""
        words = letters_only(text)
        if not words or not self.names:
            return None
        own = profile(words, self.size)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        known = np.flatnonzero(self.codes[at] == own)
        rank = self.rank[:, at[known]]
        away = np.where(rank >= 0, np.abs(rank - known), self.size).sum(axis=1)
        return (away + self.size * (len(own) - len(known))) / (self.size * len(own))

    def judge(self, text: str | None) -> tuple[str, float]:
        away = None if text is None else self.distances(text)
        if away is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(away))
        return self.names[best], float(1.0 - away[best])


def taught(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The documents that may teach: labelled, and crc32 of the id's text modulo 3 is not 1."""
    return docs.where((F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 != 1) & F.col("lang").isNotNull())


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, size: int = PROFILE) -> RankModel:
    """Profiles from about ``sample_docs`` documents of each language, picked by id hash."""
    rows = taught(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                               F.col("text").cast("string").alias("text"))
    sizes = materialize(rows.groupBy("lang").count(), "language-sizes")  # reads no text
    place = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = (rows.join(sizes.select("lang", (F.lit(float(sample_docs)) / F.col("count")).alias("share")), "lang")
              .where((place < F.col("share")) & F.col("text").isNotNull()).select("lang", "text"))

    def count(batches):
        for batch in slices(batches, 512):
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(letters_only(text).strip())
            for lang, texts in by_lang.items():
                words = " ".join(t for t in texts if t)
                if words:
                    code, n = grams(f" {words} ")
                    yield pa.RecordBatch.from_pydict({"lang": [lang] * len(code), "gram": pa.array(code),
                                                      "n": pa.array(n, pa.int64())})

    counts = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(
        F.sum("n").alias("n"))
    from pyspark.sql import Window
    place_in = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = materialize(counts.withColumn("r", place_in).where(F.col("r") <= size), "profiles")
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "r").collect():  # ``size`` rows a language
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return RankModel(profiles, size)


def identify(docs: DataFrame, model: RankModel, *keep: str) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (1: identical profiles; 0: nothing shared)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True)).alias("held_out"),
        F.col("text").cast("string").alias("text"))

    def judge(batches):
        for batch in slices(batches, 512):
            found = [model.judge(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "held_out": batch.column(1),
                "lang_pred": pa.array([f[0] for f in found], pa.string()),
                "score": pa.array([f[1] for f in found], pa.float64())})

    return rows.mapInArrow(judge, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: RankModel, least: float = 0.0) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a learnt language: it has letters
    and its score is above ``least``.  With nothing learnt all texts with letters stay."""
    schema = docs.schema
    at = docs.columns.index("text")

    def keep(batches):
        for batch in slices(batches, 512):
            texts = [None if t is None else str(t) for t in batch.column(at).to_pylist()]
            if model.names:
                good = [model.judge(t)[1] > least for t in texts]
            else:
                good = [t is not None and bool(letters_only(t)) for t in texts]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(keep, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of all documents from profiles of the labelled two thirds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
