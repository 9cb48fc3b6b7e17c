"""Collocations, toxicity scores and whitening against plain restatements."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from stagecraft.llm import phrases, toxicity, whitening
from tests.llm.common_rows import LONG, SF, documents, no_documents, odd_documents


def brute_phrases(rows, support=30, top=2000, covered=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f.setdefault(lang, Counter())[tuple(w[i:i + m])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= support}
        best, most = [], Counter()
        for q, b in cand.items():
            for m in range(2, len(q)):
                for i in range(len(q) - m + 1):
                    most[q[i:i + m]] = max(most[q[i:i + m]], b)
        for p, a in cand.items():
            score, _, left, right = min((2000000 * a // (c[p[:k]] + c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if p not in most or 100 * most[p] < covered * a:
                best.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def mined(docs, **kw):
    return sorted(tuple(r) for r in phrases.collocations(docs, **kw).select(*COLUMNS).collect())


def test_phrases_equal_brute_force(spark):
    docs = documents(spark)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    want = brute_phrases(rows, support=12, top=40)
    assert want and mined(docs.repartition(11), support=12, top=40) == want
    # a crowded filter lets more phrases be counted and changes nothing
    assert mined(docs, support=12, top=40, filter_bits=16) == want


def test_phrases_odd_rows(spark):
    rows = [("a b", None)] * 3 + [("A B. a\tb,c  A b\x0bb", "en"), (None, "en"), ("", "de"), (" .,", "de"),
                                  ("straße Äpfel straße Äpfel straße Äpfel", "de"), (LONG, "fr"), ("a b " * 9, "en")]
    docs = spark.createDataFrame(rows, "text string, lang string").selectExpr(
        "text", "lang", "'x' as phrase", "'y' as n", "'z' as piece")
    assert mined(docs, support=3) == brute_phrases([(lang, t) for t, lang in rows], support=3)
    assert phrases.collocations(no_documents(spark)).count() == 0
    assert mined(odd_documents(spark), support=2) == brute_phrases(
        [(r["lang"], r["text"]) for r in odd_documents(spark).collect()], support=2)


def test_blocks_keep_pieces_and_equal_hashes_are_told_apart():
    text = ("one two three. " * 50 + "x" * 300 + " y " * 40).encode()
    parts = list(phrases.blocks([text, b"tail"], size=64))
    cut = [[p.split() for p in re.split(rb"[.,;:!?\n]", t) if p.split()] for t in (text + b"\ntail", b"\n".join(parts))]
    assert cut[0] == cut[1] and len(parts) > 10
    block = phrases.Block(b"aa bb aa cc", "en")
    block.hash = np.zeros(4, np.uint64)  # as if all words shared a hash
    ids = block.word_ids(np.arange(4))
    assert ids[0] == ids[2] and len(set(ids.tolist())) == 3


def test_phrases_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(tuple(r) for r in con.sql(phrases.ORACLE).select(*COLUMNS).fetchall())
    assert want and sorted(tuple(r) for r in phrases.op11_phrases(spark, SF).select(*COLUMNS).collect()) == want


# --- toxicity

def toxic_rows(n=600):
    rng = np.random.default_rng(5)
    base = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su") for b in ("na", "ver", "dol", "kim", "pes")]
    docs, labels = [], []
    for i in range(n):
        words = rng.choice(base, 40).tolist()
        if i % 5 == 0:
            words[int(rng.integers(40))] = rng.choice(["horrid", "grumbler", "nasty"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return docs, labels


def test_toxicity_learns_and_scores_misspellings(spark):
    docs, labels = toxic_rows()
    more = [(10_001, "lona miver horrrid taver rekim " * 2), (10_002, "lona miver tadol rekim " * 2), (10_003, None),
            (10_004, ""), (10_005, " .. "), (None, "horrid"), (10_006, LONG), (10_006, LONG)]
    d = spark.createDataFrame([(*r, "x", 1.0) for r in docs + more], "doc_id long, text string, lang string, score double")
    lab = spark.createDataFrame([(*r, "x") for r in labels] + [(None, 1, "x"), (3, None, "x"), (999_999, 1, "x")],
                                "doc_id long, toxic int, text string")
    got = toxicity.assess(d, toxicity.learn(d, lab)).collect()
    assert len(got) == len(docs) + len(more)
    at = {r["doc_id"]: r for r in got}
    held = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(at[i]["held_out"] == (i in set(held)) for i, _ in docs) and at[None]["held_out"]
    assert np.mean([at[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    assert at[10_001]["score"] > 0.5 > at[10_002]["score"]
    assert at[10_003]["score"] == at[10_004]["score"] == at[10_005]["score"]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)


def test_toxicity_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.assess(d, toxicity.learn(d, none)).collect()] == [0.0, 0.0]
    one = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")
    assert [r["score"] for r in toxicity.assess(d, toxicity.learn(d, one)).collect()] == [1.0, 1.0]
    assert toxicity.assess(d.limit(0), toxicity.learn(d, none)).count() == 0


def test_toxicity_held_out_labels_change_nothing(spark):
    docs, labels = toxic_rows(200)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a, b = (toxicity.learn(d, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, flipped))
    assert a.share.tolist() == b.share.tolist() and a.bias == b.bias


def test_word_features_share_ngrams():
    at, sizes = toxicity.features(["abcdef", "abcdxf", "a", "日本"])
    parts = np.split(at, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [6 + 5 + 4 + 1, 16, 1 + 1, 2 + 1 + 1]
    assert len(set(parts[0]) & set(parts[1])) >= 6
    alone = [toxicity.features([w])[0] for w in ("abcdef", "abcdxf", "a", "日本")]
    assert all(sorted(p.tolist()) == sorted(q.tolist()) for p, q in zip(parts, alone))


# --- whitening

def brute_whitening(vectors, components=16):
    x = np.floor(np.array(vectors, np.float64) * 64).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = fit - s / n
    values, v = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    w = (x - s / n) @ v[:, order] / np.sqrt(values[order])
    return n, ((n * x - s) ** 2).sum(axis=1), w, values[order] / values.sum()


def whitened(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, n string, x int")
    return whitening.whiten(df, **kw).collect()


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 20)) @ np.diag(np.geomspace(50, 0.5, 20)) + 7
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(50)]
    bad = [(2000, None), (2001, [float("nan")] * 20), (2002, [float("inf")] + [0.0] * 19), (2003, [None] + [1.0] * 19),
           (2004, [1e300] + [0.0] * 19)]
    got = whitened(spark, rows + bad)
    n, deviation, w, explained = brute_whitening([v for _, v in rows])
    assert len(got) == 16 * len(rows) and {r["vec_id"] for r in got} == {i for i, _ in rows}
    by = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(16):
        mine = np.array([by[i, c + 1]["whitened"] for i, _ in rows])
        assert np.abs(mine * np.sign(mine @ w[:, c]) - w[:, c]).max() < 1e-9
        assert abs(by[0, c + 1]["explained"] / explained[c] - 1) < 1e-9
    assert all(by[i, 1]["deviation"] == d and by[i, 1]["n"] == n for (i, _), d in zip(rows, deviation.tolist()))
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


def test_whitening_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (2, [1.0, 4.0, 3.0]), (2, [1.0, 4.0, 3.0]), (None, [1.0, 0.0, 3.0]),
            (4, [5.0]), (5, []), (6, [0.0, 0.0, 0.0])]
    got = whitened(spark, rows)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0) for r in got) == sorted(
        (i is None, i or 0) for i, v in rows for _ in v)
    one = [r for r in got if r["vec_id"] == 4][0]  # a fit list of one vector has no variance
    assert one["whitened"] is None and one["explained"] == 0.0 and one["identity_error"] == 0.0 and one["n"] == 1
    assert [r["whitened"] for r in got if r["vec_id"] == 2 and r["component"] == 3] == [None, None]
    assert whitened(spark, []) == []


def test_deviations_are_exact_beyond_doubles():
    c = whitening.Centre(3, [3 << 40, 5])
    y = np.array([[1 << 40, 2], [(1 << 55) + 1, -(1 << 55)]])
    want = [sum((3 * int(a) - s) ** 2 for a, s in zip(row, c.sums)) for row in y]
    assert c.deviation(y) == [w if w < 1 << 63 else None for w in want]


@pytest.mark.parametrize("values", [
    np.geomspace(1e6, 1e-6, 30), np.r_[np.full(8, 5.0), 5 + 1e-9 * np.arange(8), 1e-7 * np.arange(1, 9)], np.ones(12),
    np.r_[np.ones(3), np.zeros(5)], np.zeros(4), np.array([2.0]), np.r_[1e12, 1.0, 1.0 + 1e-8, 1e-3]])
def test_refined_eigenvectors(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((d, d)))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, x = whitening.refined_eigen(v)
    high, low = whitening.exact_product(x.T, x)
    top = max(np.abs(values).max(), 1e-300)
    assert np.abs((high - np.eye(d)) + low).max() < 4e-15
    assert np.abs(v @ x - x * got).max() <= 1e-14 * top and (np.diff(got) <= 1e-15 * top).all()
    assert np.abs(got - np.linalg.eigvalsh(v)[::-1]).max() <= 1e-14 * top


def test_exact_product():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((9, 70)) * np.geomspace(1, 1e8, 70), rng.standard_normal((70, 5))
    high, low = whitening.exact_product(a, b)
    want = a.astype(np.longdouble) @ b.astype(np.longdouble)
    assert np.abs((high.astype(np.longdouble) + low) - want).max() <= 1e-17 * np.abs(a).max() * 70
