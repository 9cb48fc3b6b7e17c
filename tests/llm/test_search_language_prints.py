"""Nearest neighbours, language identification and Order MinHash."""

import hashlib
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stagecraft.llm import language_id, neighbours, order_minhash

from .common_rows import SF, documents, no_documents, odd_documents, odd_rows, texts


# ------------------------------------------------------------------ nearest neighbours

def exact(vectors, queries, k):
    ids = np.array(sorted(vectors))
    base = np.array([vectors[i] for i in ids.tolist()], float)
    out = {}
    for q in queries:
        d = np.sqrt(((base - np.array(vectors[q], float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_against_brute_force(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in df.collect()}
    queries = [i for i in vectors if i % 10 == 0]
    got = found(neighbours.nearest(df, F.col("vec_id") % 10 == 0, cell_rows=60).collect())
    want = exact(vectors, queries, 10)
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in got[q]}) for q in queries)
    assert hits / (10 * len(queries)) >= 0.95
    for q in queries:
        near = dict(got[q])
        d = {i: math.dist(vectors[q], vectors[i]) for i in near}
        assert all(abs(d[i] - s) < 1e-9 for i, s in near.items()) and len(near) == 10
        assert [s for _, s in got[q]] == sorted(s for _, s in got[q])


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(40)]  # one vector, many rows
    rows += [(100 + i, rng.normal(size=3).tolist()) for i in range(30)]
    rows += [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, float("nan"), 1.0]), (203, [1.0, None, 1.0]),
             (204, [1.0, 2.0]), (205, [float("inf"), 0.0, 1.0]), (None, [1.0, 2.0, 3.0]), (100, rows[40][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, v string, cell int")
    vectors = {i: v for i, v in rows[:70]}
    got = found(neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, cell_rows=16, certainty=0.9999).collect())
    want = exact(vectors, [0, 20, 100, 120], 5)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = spark.createDataFrame(rows[38:42], "vec_id long, embedding array<double>")
    assert {len(v) for v in found(neighbours.nearest(few, F.lit(True)).collect()).values()} == {3}
    assert neighbours.nearest(df.where("false"), F.lit(True)).count() == 0


def test_stopping_factor():
    f = neighbours.stopping_factor(0.98, 8)
    assert abs(neighbours.chi_square_cdf(f * f, 8) - 0.98) < 1e-9
    draws = (np.random.default_rng(1).standard_normal((200_000, 8)) ** 2).sum(axis=1)
    assert abs((draws <= f * f).mean() - 0.98) < 0.003


# ------------------------------------------------------------------ language

def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs, language_id.learn(docs, sample_docs=60)).collect()
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [r for r in got if r["held_out"]]
    import zlib
    assert {r["doc_id"] for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_out_of_place_distance_equals_its_definition():
    model = language_id.RankModel({"b": [1, 2, 3, 4], "a": [3, 1, 97, 5]}, size=4)
    text = "aaa b"
    own = language_id.profile(language_id.letters_only(text), 4).tolist()
    for name, away in zip(model.names, model.distances(text)):
        p = {"b": [1, 2, 3, 4], "a": [3, 1, 97, 5]}[name]
        assert away * 4 * len(own) == sum(abs(i - p.index(g)) if g in p else 4 for i, g in enumerate(own))
    assert language_id.RankModel({"x": [1], "w": [1]}).judge("abc")[0] == "w"  # a tie goes by name


def test_profile_counts_whole_text_and_word_ends():
    code, n = language_id.grams(language_id.letters_only("Ab, ab2 B"))
    seen = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s): k for c, k in zip(code.tolist(), n.tolist())}
    assert seen == {"a": 2, "b": 3, " a": 2, "ab": 2, "b ": 3, " b": 1, " ab": 2, "ab ": 2, " b ": 1}


def test_language_on_odd_rows(spark):
    docs = odd_documents(spark)
    model = language_id.learn(docs)
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    assert {(3, "und", 0.0), (4, "und", 0.0), (5, "und", 0.0), (9, "und", 0.0)} <= got
    assert language_id.identify(docs, model).count() == len(odd_rows())
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 6, 7, 8, None, 10, 11, 12}
    empty = language_id.learn(no_documents(spark))
    assert language_id.identify(no_documents(spark), empty).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, empty).collect()} == {"und"}
    assert language_id.keep_identified(docs, empty).count() == 10


# ------------------------------------------------------------------ order minhash

MASK = (1 << 64) - 1
LOW = (1 << order_minhash.POSITION_BITS) - 1


def spark_hash(*values):
    h = 42
    for v in values:
        if isinstance(v, bytes):
            h = xxhash.xxh64_intdigest(v, h)
        elif isinstance(v, int):
            h = xxhash.xxh64_intdigest((v & MASK).to_bytes(8, "little"), h)
        elif isinstance(v, tuple):  # an int of 4 bytes
            h = xxhash.xxh64_intdigest(v[0].to_bytes(4, "little"), h)
    return h


def brute_signature(text):
    import re
    tok = [t.encode() for t in re.findall(r"[^ \t\n\x0b\f\r]{1,8}", text)]
    seen, marked = {}, []
    for i, t in enumerate(tok):
        h = (spark_hash(t, tok[i + 1]) if i + 1 < len(tok) else spark_hash(t)) & ~LOW & MASK
        n = seen.get(h, 0)
        seen[h] = n + 1
        marked.append(((spark_hash(h, (n,)) & ~LOW & MASK) if n else h, i))
    bins = {}
    for h, i in marked:
        bins.setdefault(h >> 64 - order_minhash.BIN_BITS, []).append((h, i))
    def signed(h):
        return h - (1 << 64 if h >> 63 else 0)

    kept = sorted((signed(h), i) for items in bins.values() for h, i in sorted(items)[:2])
    out, met = set(), set()
    for at, (h, i) in enumerate(kept):
        b = (h & MASK) >> 64 - order_minhash.BIN_BITS
        if b not in met:
            met.add(b)
            two = sorted({(h, i), kept[(at + 1) % len(kept)]}, key=lambda x: x[1])
            out.add(b << 16 | signed(spark_hash(*[x & MASK for x, _ in two])) % 65536)
    return out


def test_signatures_equal_brute_force(spark):
    some = ["", "one", "a b a b a b a b c", "x" * 100, "the cat the cat sat", " \n"] + list(texts(spark).values())[:40]
    df = spark.createDataFrame(list(enumerate(some)), "i long, text string")
    got = {r["i"]: set(r["sig"]) for r in order_minhash.signature(df, "text", "sig").collect()}
    assert got == {i: brute_signature(t) for i, t in enumerate(some)}


def expected(rows):
    order = sorted({(i if i is not None else -1 << 63, t or "") for i, t in rows})
    by_id = {i: t for i, t in order}
    out = {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        out[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited, nxt)
    assert len(by_id) == len(order)
    return out


def jaccard(a, b):
    bins = {v >> 16 for v in a} | {v >> 16 for v in b}
    return len(a & b) / len(bins) if bins else 1.0


def test_edits_and_likeness_equal_brute_force(spark):
    rows = sorted(texts(spark).items())
    want = expected(rows)
    by = dict(rows)
    prints = {}
    got = order_minhash.compare_edits(documents(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, sha, edited, nxt = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (n, sha)
        assert prints.setdefault(by[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        own = brute_signature(by[r["doc_id"]])
        assert r["near_edited"] == pytest.approx(jaccard(own, brute_signature(edited)))
        assert r["near_next"] == pytest.approx(jaccard(own, brute_signature(nxt)))
    long = [r for r in got if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95


def test_order_minhash_on_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = expected(rows)
    got = order_minhash.compare_edits(odd_documents(spark)).collect()
    assert sorted(map(str, [r["doc_id"] for r in got])) == sorted(str(i) for i, _ in rows)
    for r in got:
        assert (r["n_chars"], r["edited_sha256"]) == want[-1 << 63 if r["doc_id"] is None else r["doc_id"]][:2]
    empty = {r["doc_id"]: r for r in got if r["doc_id"] in (3, 4)}
    assert empty[3]["fingerprint"] == empty[4]["fingerprint"] == "" and empty[3]["near_next"] == 1.0
    assert order_minhash.compare_edits(no_documents(spark)).count() == 0
    alone = order_minhash.compare_edits(odd_documents(spark).where("doc_id = 8")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_order_matters(spark):
    words = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[200:] + words[:200]))], "a string, b string")
    sig = order_minhash.signature(order_minhash.signature(df, "a", "s"), "b", "t")
    near = sig.select(order_minhash.likeness("s", "t")).first()[0]
    assert 0.2 < near < 0.8  # nearly the same k-mers, but half of the pairs change places


def test_order_matters_in_short_texts(spark):
    for n in (20, 60, 100):
        rng = np.random.default_rng(n)
        words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(n)]
        df = spark.createDataFrame([(" ".join(words), " ".join(words[n // 2:] + words[:n // 2]))], "a string, b string")
        sig = order_minhash.signature(order_minhash.signature(df, "a", "s"), "b", "t")
        assert sig.select(order_minhash.likeness("s", "t")).first()[0] < 0.75


def unspaced_texts():
    rng = np.random.default_rng(5)
    def draw(alphabet, n):
        return "".join(alphabet[i] for i in rng.integers(0, len(alphabet), n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    han, thai = ("".join(map(chr, range(*r))) for r in ((0x4E00, 0x5200), (0x0E01, 0x0E2F)))
    return {
        "han": draw(han, 800), "thai": draw(thai, 800), "base64": draw(base64, 3000), "no cuts": draw("23", 800),
        "cyrillic": draw("".join(map(chr, range(0x430, 0x450))), 800), "one short run": draw(base64, 45),
        "han in words": "see " + draw(han, 40) + " and " + draw(han, 40), "link": "at " + draw(base64, 400) + " there",
        "wide": draw("".join(map(chr, range(0x1F600, 0x1F640))), 400)}


def test_an_edit_in_unspaced_text_changes_the_pieces_around_it_only(spark):
    some = unspaced_texts()
    rows = [(k, t, t[:5] + "#" + t[5:], t[:5] + t[6:]) for k, t in some.items()]
    df = spark.createDataFrame(rows, "name string, a string, b string, c string")
    for x in "abc":
        df = order_minhash.signature(df.withColumn(f"tok_{x}", F.expr(order_minhash.tokens(x))), x, f"s{x}")
    for r in df.withColumn("more", order_minhash.likeness("sa", "sb")).withColumn(
            "less", order_minhash.likeness("sa", "sc")).collect():
        kmers = {x: set(zip(r[f"tok_{x}"], r[f"tok_{x}"][1:])) for x in "abc"}
        assert all(len(kmers["a"] - kmers[x]) <= 18 for x in "bc"), r["name"]  # two pieces' length of characters
        low = 0.3 if r["name"] == "one short run" else 0.6
        assert min(r["more"], r["less"]) > low, (r["name"], r["more"], r["less"])


def test_tokens_hold_every_character_and_spaced_words_keep_their_cuts(spark):
    import re
    some = ["a word and internationalisation", "", "  ", "x" * 100, "y " + "z" * 49, *unspaced_texts().values()]
    df = spark.createDataFrame(list(enumerate(some)), "i long, t string")
    for r in df.withColumn("tok", F.expr(order_minhash.tokens("t"))).collect():
        assert all(0 < len(t) <= 8 for t in r["tok"]) and set("".join(r["tok"])) == set("".join(r["t"].split()))
        if r["i"] < 4:
            assert r["tok"] == re.findall(r"\S{1,8}", r["t"])
