"""Rows that share an id, a short hash, a vector or everything: nothing clean is lost, nothing gathers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stagecraft.llm import neighbours, packing, substring_dedup
from stagecraft.llm.library_ids import LibraryIds, tokenizer_path
from tests.llm.brute import digest, kept

PASSAGE = " ".join(f"p{i}" for i in range(60))
OTHER = " ".join(f"o{i}" for i in range(60))


@pytest.fixture(scope="module")
def colliding(spark):
    """Two texts whose 32-bit hashes agree: one holds the passage, one holds nothing of it."""
    n = spark.range(1 << 17)
    texts = [n.select(F.concat_ws(" ", F.lit(t), F.concat(F.lit(tag), F.col("id").cast("string"))).alias(tag))
             for t, tag in ((PASSAGE, "x"), (OTHER, "y"))]
    a, b = (t.withColumn("h", F.hash(t.columns[0])) for t in texts)
    pair = a.join(b, "h").orderBy("h").first()
    assert pair is not None
    return pair["x"], pair["y"]


@pytest.mark.parametrize("shared", [5, None, (1 << 63) - 1])
def test_rows_of_one_id_are_told_apart_by_more_than_32_bits(spark, colliding, shared):
    rows = [(1, PASSAGE), (shared, colliding[0]), (shared, colliding[1])]
    got = substring_dedup.kept_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted(((i, len(w), len(w) - len(k), digest(k)) for i, w, k in kept(rows)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sorted(r["n_removed"] for r in got) == [0, 0, 60]


def test_thousands_of_equal_rows_are_worked_on_once(spark):
    rows = [(1, PASSAGE + " a b c"), (2, OTHER + " " + PASSAGE)] + [(9, "z " + PASSAGE + " d " + OTHER)] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    windows = substring_dedup.repeated_windows(df).distinct()
    assert windows.count() < 200
    got = substring_dedup.kept_digests(df).where("doc_id = 9").groupBy("n_removed").count().collect()
    assert [tuple(r) for r in got] == [(120, 3000)]


def brute_nearest(rows, queries, k):
    out = {}
    for q in queries:
        for i, v in rows:
            if i == q:
                near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in set(rows)
                              if j != q and len(w) == len(v))
                out[q] = [j for _, j in near[:k]]
    return out


def test_every_vector_length_is_searched(spark):
    rng = np.random.default_rng(7)
    rows = [(i, tuple(rng.standard_normal(4).tolist())) for i in range(40)]
    rows += [(100 + i, tuple(rng.standard_normal(3).tolist())) for i in range(30)]
    rows += [(500, (1.0,)), (501, ()), (502, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 10 == 0, certainty=0.99999).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    usable = [(i, v) for i, v in rows if v]
    want = brute_nearest(usable, [i for i, _ in usable if i % 10 == 0], 10)
    assert got == {q: w for q, w in want.items() if w} and len(got[100]) == 10


def test_equal_queries_are_one_question(spark):
    rng = np.random.default_rng(8)
    same = tuple(rng.standard_normal(6).tolist())
    rows = [(i, same) for i in range(10_000)] + [(20_000 + i, tuple(rng.standard_normal(6).tolist())) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") < 10_000, k=5)
    assert got.count() == 50_000 and got.where("score <> 0 or query_id = vec_id").count() == 0
    lists = got.groupBy("query_id").agg(F.sort_array(F.collect_list("vec_id")).alias("v"))
    assert lists.where("query_id > 5 and v <> array(0L, 1L, 2L, 3L, 4L)").count() == 0
    assert lists.where("query_id = 2").first()["v"] == [0, 1, 3, 4, 5]


def test_recall_on_all_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    found = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0, cell_rows=256).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q in ids[ids % 50 == 0].tolist():
        d = ((v - v[ids == q][0]) ** 2).sum(axis=1)
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))][:10].tolist())
        hits, total = hits + len(best & found[q]), total + 10
    assert hits / total >= 0.9


def test_equal_rows_spread_over_the_packing_groups(spark):
    df = spark.createDataFrame([(7, "the same text")] * 3000, "doc_id long, text string").repartition(3)
    path = tokenizer_path("word_bpe_49k.json")
    pieces = packing.document_pieces(df, path, 2, 8)
    sizes = {r["group"]: r["count"] for r in pieces.groupBy("group").count().collect()}
    assert set(sizes) == set(range(8)) and max(sizes.values()) < 500
    again = {r["group"]: r["count"] for r in packing.document_pieces(df, path, 2, 8).groupBy("group").count().collect()}
    assert again == sizes
    packed = packing.pack(df, path, group_docs=400)
    assert packed.count() >= 3000 and packed.agg(F.sum("length")).first()[0] == 3000 * packed.first()["doc_tokens"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_a_full_table_changes_no_ids(name):
    path = tokenizer_path(name)
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeé "), int(rng.integers(1, 9)))) for _ in range(600)]
    texts = [" ".join(rng.choice(words, 30)) + rng.choice(["", "\n", "  x", "!"]) for _ in range(200)]
    small, large = LibraryIds(path, limit=50), LibraryIds(path)
    for i in range(0, 200, 10):
        part = texts[i:i + 10]
        assert small.encode(part) == large.encode(part) == large.whole(part)
