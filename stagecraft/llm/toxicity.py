"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A text is composed (NFC) and lower-cased; its words are its runs of letters and digits.  A
word's features are the word itself and its 3- to 5-grams with a mark at either end, hashed
into ``BUCKETS`` rows of an embedding table.  A word is the mean of its features, a text the
mean of its different words, and a linear softmax over that mean gives the score.  Table and
softmax are trained jointly in numpy (mini-batches, Adam with decay), so a misspelt word that
was never seen still scores by the n-grams it shares.  Features of under ``LEAST_DOCS``
training documents are left out.

Training sees at most ``sample_docs`` labelled documents of each class, those whose id and text
hash lowest; the classes weigh as among the labelled rows, toxic ones ``TOXIC_WEIGHT`` times that.
Their bags of buckets
are made on the executors, and those alone come to the driver.  As the softmax is linear, a
bucket's share of the score is one number, so the model that goes to the tasks is one float a
bucket; what words score is kept in a bounded table per worker.

Defined cases: null, empty and wordless texts score what the bias alone gives; with labels
of one class only every score is that class's (0 without labels); a null ``doc_id``
counts as held out and never teaches; an id with several labels is toxic if one says so, an id
with several texts teaches by the one of the smallest hash; labels other than 0 and null mean
toxic, null ones are left out; rows are scored one by one, so equal rows each keep theirs; an
empty table gives no row.  Whole texts are read.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, slices

BUCKETS = 1 << 18
DIMS = 16
SAMPLE_DOCS = 2500
EPOCHS = 8
LEAST_STEPS = 600
RATE = 0.05
BATCH = 64
DECAY = 0.1
GAIN = 32.0  # a text's few telling words weigh little in its mean
LEAST_DOCS = 20
TOXIC_WEIGHT = 2.0
SEED = 20_240_602
KEPT_WORDS = 400_000
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(unicodedata.normalize("NFC", text).lower()))


def features(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all words one after another, how many each word has)."""
    marked = "<" + "><".join(words) + ">"
    cp = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    end = np.repeat(np.cumsum(length), length)  # where the word of each character ends
    at = np.arange(len(cp))
    start = np.concatenate([[0], np.cumsum(length)[:-1]])
    owner, found = [], []
    h = np.zeros(len(cp), np.uint64)
    word = np.repeat(np.arange(len(words)), length)
    for n in range(1, 6):
        h = h[:len(cp) - n + 1] * np.uint64(0x100000001B3) + cp[n - 1:] + np.uint64(1)
        if n >= 3:
            inside = at[:len(h)] + n <= end[:len(h)]
            found.append(h[inside] + np.uint64(n))
            owner.append(word[:len(h)][inside])
    power = np.cumprod(np.full(len(cp) + 1, 0x100000001B3, np.uint64))
    whole = np.add.reduceat((cp + np.uint64(7)) * power[at - start[word]], start)
    found.append(whole)
    owner.append(np.arange(len(words)))
    h, owner = np.concatenate(found), np.concatenate(owner)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(owner, kind="stable")
    return (h >> np.uint64(40)).astype(np.int64)[order] % buckets, np.bincount(owner, minlength=len(words))


def bag(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's words (each word once) and their weights, which sum to one."""
    at, sizes = features(words, buckets)
    place, number = np.unique(at, return_inverse=True)
    return place, np.bincount(number, np.repeat(1.0 / sizes / len(words), sizes))


class Bag:
    """Embeddings and softmax, trained jointly on bags."""

    def __init__(self, buckets: int = BUCKETS, dims: int = DIMS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.table = rng.uniform(-1 / dims, 1 / dims, (buckets, dims)).astype(np.float32)
        self.out = np.zeros((dims, 2), np.float32)
        self.out[:, 1] = rng.standard_normal(dims) / np.sqrt(dims)
        self.out[:, 0] = -self.out[:, 1]
        self.bias = np.zeros(2, np.float32)

    def train(self, bags: list, label: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> None:
        first, second = np.zeros_like(self.table), np.zeros(len(self.table), np.float32)
        moments = {k: [np.zeros_like(getattr(self, k)), np.zeros_like(getattr(self, k))] for k in ("out", "bias")}
        share = np.array([weight[label == c].sum() for c in (0, 1)]) / weight.sum()
        self.bias[:] = np.log(share)
        step = 0
        for epoch in range(epochs):
            order = self.rng.permutation(len(bags))
            for i in range(0, len(order), BATCH):
                rows = order[i:i + BATCH]
                place, number = np.unique(np.concatenate([bags[r][0] for r in rows]), return_inverse=True)
                x = np.zeros((len(rows), len(place)), np.float32)
                x[np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows]), number] = \
                    np.concatenate([bags[r][1] for r in rows])
                x *= GAIN
                table = self.table[place]
                mean = x @ table
                z = mean @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(rows)), label[rows]] -= 1
                p *= (weight[rows] / weight[rows].mean() / len(rows))[:, None]
                grad = {"out": mean.T @ p, "bias": p.sum(axis=0)}
                inner = x.T @ (p @ self.out.T)
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grad.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    getattr(self, k)[...] -= now * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
                first[place] = 0.9 * first[place] + 0.1 * inner
                second[place] = 0.99 * second[place] + 0.01 * (inner * inner).mean(axis=1)
                move = first[place] / (np.sqrt(second[place])[:, None] + 1e-6) + DECAY * table
                self.table[place] -= now * move

    def shares(self) -> tuple[np.ndarray, float]:
        """Each bucket's share of the toxic logit, and the bias."""
        return (self.table @ (self.out[:, 1] - self.out[:, 0]) * GAIN).astype(np.float32), float(self.bias[1] - self.bias[0])


class Scorer:
    """Scores texts; what a word adds is kept in a table per worker."""

    def __init__(self, share: np.ndarray, bias: float, name: str):
        self.share, self.bias, self.name = share, bias, name

    def known(self) -> dict[str, float]:
        if _known[0] != self.name:
            _known[:] = [self.name, {}]
        return _known[1]

    def score(self, texts: list) -> np.ndarray:
        table = self.known()
        words = [words_of(t) if t else set() for t in texts]
        new = list(set().union(*words) - table.keys())
        if new:
            if len(table) + len(new) > KEPT_WORDS:
                table.clear()
                new = list(set().union(*words))
            at, sizes = features(new, len(self.share))
            first = np.cumsum(sizes) - sizes
            table.update(zip(new, (np.add.reduceat(self.share[at].astype(np.float64), first) / sizes).tolist()))
        z = np.array([sum(sorted(map(table.__getitem__, w))) / len(w) if w else 0.0 for w in words]) + self.bias
        with np.errstate(over="ignore"):
            return 1.0 / (1.0 + np.exp(-z))


_known: list = ["", {}]


def _teaches() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, label_col: str = "toxic") -> Scorer:
    """Train on at most ``sample_docs`` labelled documents of each class."""
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label_col) != 0).alias("toxic"))
             .where(_teaches() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    marks = materialize(marks, "marks")
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}  # two rows
    if len(sizes) < 2:
        always = float("inf") if True in sizes else float("-inf")
        return Scorer(np.zeros(1, np.float32), always, f"constant {always}")
    place = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 40))
    picked = None
    for toxic, count in sorted(sizes.items()):
        share = min(1.0, 2.0 * sample_docs / count)  # thins the rows that the limit has to order
        some = (marks.where((F.col("toxic") == toxic) & (place <= int(share * (1 << 40))))
                .orderBy(place, "doc_id").limit(sample_docs))
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.struct(F.xxhash64("text").alias("h"), "text")
    sample = (rows.where("text is not null").join(F.broadcast(picked), "doc_id")  # 2 * sample_docs ids
              .groupBy("doc_id", "toxic").agg(F.min(text).alias("t")).select("doc_id", "toxic", "t.text"))

    def bags(batches):
        for batch in slices(batches, 256):
            found = [(i, y, *bag(sorted(w))) for i, y, t in zip(*(batch.column(c).to_pylist() for c in range(3)))
                     if (w := words_of(t))]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([f[0] for f in found], pa.int64()), "toxic": pa.array([f[1] for f in found], pa.bool_()),
                "bucket": pa.array([f[2] for f in found], pa.list_(pa.int32())),
                "weight": pa.array([f[3] for f in found], pa.list_(pa.float32()))})

    found = sample.mapInArrow(bags, "doc_id long, toxic boolean, bucket array<int>, weight array<float>").toArrow()
    found = found.sort_by([("toxic", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    return _trained(found, sizes)


def _trained(found: pa.Table, sizes: dict) -> Scorer:
    label = np.array(found.column("toxic").to_pylist(), bool).astype(np.int64)
    taken = np.bincount(label, minlength=2)
    if not taken.all():
        return Scorer(np.zeros(1, np.float32), float("inf") if taken[1] else float("-inf"), "constant")

    def lists(name):
        return [x.values.to_numpy(zero_copy_only=False) for x in found.column(name)]

    place, weight = lists("bucket"), lists("weight")
    docs_of = np.bincount(np.concatenate(place), minlength=BUCKETS)
    least = min(LEAST_DOCS, max(1, int(taken.min()) // 4))
    bags = [(p[k].astype(np.int64), w[k]) for p, w in zip(place, weight) for k in [docs_of[p] >= least]]
    class_weight = np.array([sizes[False] / taken[0], TOXIC_WEIGHT * sizes[True] / taken[1]])
    model = Bag()
    model.train(bags, label, class_weight[label], epochs=max(EPOCHS, -(-LEAST_STEPS * BATCH // len(bags))))
    share, bias = model.shares()
    share[docs_of < least] = 0.0
    import hashlib
    return Scorer(share, bias, hashlib.sha256(share.tobytes() + repr(bias).encode()).hexdigest())


def assess(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", (~_teaches()).alias("held_out"), "text")

    def judge(batches):
        for batch in slices(batches, 512):
            score = scorer.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "held_out": batch.column(1),
                                              "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32))})

    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double, predicted int")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by a model of the labelled four fifths."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assess(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
