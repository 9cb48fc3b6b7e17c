"""Substring dedup, SimHash near-duplicates and components, against brute force."""

import numpy as np
import pytest

from stagecraft.llm import simhash, substring_dedup
from stagecraft.llm.components import connected_components

from . import brute
from .common_rows import documents, no_documents, odd_documents, odd_rows, texts


def random_texts(seed, n=60):
    """Short texts over few words that share passages, whole and in part."""
    rng = np.random.default_rng(seed)
    pool = [" ".join(f"p{k}x{i}" for i in range(int(rng.integers(8, 30)))) for k in range(6)]
    out = []
    for i in range(n):
        parts = [pool[rng.integers(6)] if rng.random() < 0.5 else
                 " ".join(f"u{rng.integers(40)}" for _ in range(rng.integers(1, 12))) for _ in range(rng.integers(1, 6))]
        out.append((i % 45, " ".join(parts)))  # some ids twice
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repeated_windows_equal_brute_force(spark, seed):
    rows = random_texts(seed)
    got = substring_dedup.kept_digests(spark.createDataFrame(rows, "doc_id long, text string"), 10, 4).collect()
    want = [(i, len(w), len(w) - len(k), brute.digest(k)) for i, w, k in brute.kept(rows, 10)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_query_equals_brute_force_on_documents(spark):
    rows = sorted(texts(spark).items())
    got = substring_dedup.kept_digests(documents(spark)).collect()
    assert sorted(tuple(r) for r in got) == sorted(
        (i, len(w), len(w) - len(k), brute.digest(k)) for i, w, k in brute.kept(rows))


def test_repeats_are_maximal_spans(spark):
    passage = " ".join(f"w{i}" for i in range(70))
    rows = [(1, "a b " + passage + " c"), (2, "d " + passage + " e f"), (3, passage[:-4])]
    got = {r["doc"]: [(s["from"], s["to"]) for s in r["spans"]]
           for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {2: [(1, 71)], 3: [(0, 69)]}


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = substring_dedup.kept_digests(odd_documents(spark)).collect()
    want = [(i, len(w), len(w) - len(k), brute.digest(k)) for i, w, k in brute.kept(rows)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    whole = substring_dedup.remove_repeats(odd_documents(spark)).select("row.*", "text", "n_removed").collect()
    assert len(whole) == len(rows) and sum(r["text"] is None for r in whole) == 1
    clean = {r["doc_id"]: r["text"] for r in whole if r["n_removed"] == 0}
    assert clean[5] == " \t\n " and clean[7] == "der Hund läuft über die Straße"
    assert substring_dedup.kept_digests(no_documents(spark)).count() == 0


def fps(spark, df):
    return {(r["doc_id"], r["fp"] & (1 << 64) - 1): r["component_id"]
            for r in simhash.near_duplicates(df).collect()}


def test_near_duplicates_equal_brute_force(spark):
    rows = sorted(texts(spark).items())
    values = [brute.simhash(t) for _, t in rows]
    of = brute.components(values, 3)
    assert fps(spark, documents(spark)) == {(i, v): rows[c][0] for (i, _), v, c in zip(rows, values, of)}


def test_near_duplicates_on_odd_rows(spark):
    got = fps(spark, odd_documents(spark))
    assert got[(3, 0)] == got[(4, 0)] == got[(5, 0)] == 3  # null, empty and blank texts are one group
    assert {v for (i, v) in got if i == 8} == {brute.simhash("one")}
    assert [c for (i, _), c in got.items() if i is None] == [None]
    assert {i for i, _ in got} == {r[0] for r in odd_rows()}
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("limit", [1 << 16, 8])
def test_trie_join_keeps_every_link(spark, limit):
    rng = np.random.default_rng(11)
    v = rng.integers(0, 1 << 64, 25, dtype=np.uint64)[rng.integers(0, 25, 700)]
    for _ in range(5):
        v = v ^ (np.uint64(1) << rng.integers(0, 64, 700).astype(np.uint64))
    v = np.unique(v)
    df = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = simhash.near_links(df, 3, limit).collect()
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") >= 1 for r in links) and len(links) <= 4 * 3 * len(v)
    root = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    groups, want = {}, {}
    for x, c in zip(v.view(np.int64).tolist(), brute.components(v, 3)):
        want.setdefault(c, set()).add(x)
        groups.setdefault(root.get(x, x), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (200, 199), (199, 200)]
    got = {r["node"]: r["root"] for r in
           connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 199: 199, 200: 199}
