"""Corpus pipeline over ``documents``: language, near duplicates, repeats, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all rows its
predecessor kept.  All but the last return the columns of ``documents``.

* ``language``: documents in no learnt language go (no letter, null text, or nothing in
  common with any language's profile).  Profiles are learnt from the stage's own labelled
  rows; where none is labelled, every text with a letter stays.
* ``near_duplicates``: of each group of SimHash-linked rows (3-word shingles, 3 bits) the
  one with the smallest ``doc_id`` (none ranks last) and then the smallest text hash stays,
  once if it is repeated.  Rows that share an id but are not linked are told apart.
* ``repeats``: words of 50-word windows that also start in a smaller document are cut;
  a document of which nothing is left goes, one without repeats keeps its text as it is,
  and ``n_chars`` follows the text.
* ``packing``: the pieces of 4,096-token sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stagecraft.llm import language_id, packing, simhash, substring_dedup
from stagecraft.llm.common import materialize
from stagecraft.llm.library_ids import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_identified(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = simhash.rooted(docs, shingle=3, max_bits=3, tie=True)
    keys = materialize(found.groupBy("root", "doc_id", "tie").agg(F.count(F.lit(1)).alias("copies")), "row-keys")
    key = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "tie")
    groups = materialize(keys.groupBy("root").agg(F.min(key).alias("first"), F.sum("copies").alias("rows"))
                         .where("rows > 1").select("root", "first"), "groups")
    marks = materialize(keys.join(groups, "root").select(
        F.col("doc_id").alias("of_id"), F.col("tie").alias("of_tie"), (key != F.col("first")).alias("gone"), "copies")
        .where("gone or copies > 1"), "near-duplicates")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("tie"))
    same = F.col("id").eqNullSafe(F.col("of_id")) & (F.col("tie") == F.col("of_tie"))
    kept = rows.join(marks.where("gone").select("of_id", "of_tie"), same, "left_anti")
    again = marks.where("not gone").select("of_id", "of_tie")
    if again.limit(1).count():
        one = kept.join(again, same, "left_semi").groupBy("id", "tie").agg(
            F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row"))
        kept = kept.join(again, same, "left_anti").select("row").unionByName(one.select("row"))
    return kept.select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(docs).where("n_words = 0 or n_removed < n_words")
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row.n_chars"))
                        .cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row").getField(c).alias(c))
    return found.select(*cols)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("repeats", repeats), ("packing", packed)]

#: Tokenisation, profiles and SimHash are beyond SQL; tests compare with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
