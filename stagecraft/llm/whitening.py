"""Embedding whitening: principal components of a distributed covariance, refined to double.

Each entry c of a vector becomes the integer x = floor(64 * c) + 1000000.  The fit list holds
each distinct x vector once.  Its count n and its sums S per dimension are exact; the
covariance is accumulated on the executors from x - S/n, divisor n, one matrix per task.

The eigenvectors of that matrix are first found in float32 and then corrected by
Ogita-Aishima iterations: R = I - X'X and T = X'VX are formed in higher precision (products
of float64 slices that are exact, summed as pairs), and X + XE with
E_ij = (T_ij + l_j R_ij) / (l_j - l_i) is the next X.  Where eigenvalues are too close for the
quotient, the vectors are orthogonalised only, and each such cluster is resolved by the
eigenvectors of its own small matrix.  A matrix of a length that a machine can hold is all
that comes to the driver: one for each vector length, of length^2 numbers.

Defined cases: vectors that are null or hold null or non-finite entries, or entries whose x
does not fit a long, are dropped; vectors of different lengths are whitened apart, each length
by its own fit list; empty vectors have no component and give no row; repeated rows each keep
their rows and a null ``vec_id`` stays null; a component without variance (``e`` below
``length * 2^-48`` of the largest) has null ``whitened`` and ``explained`` 0; ``identity_error``
is over the components with variance, 0 without any; a ``deviation`` beyond 2^63-1 is null; an
empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

SHIFT = 1_000_000
SCALE = 64
COMPONENTS = 16
MATRICES = 512
LONGEST = 1 << 62


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, y): y = floor(64 * c), which is x - 1000000, of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    good = f"forall(v, c -> coalesce(not isnan(c) and abs(c) * {SCALE} < {float(LONGEST)}, false))"
    return rows.where(f"v is not null and {good}").selectExpr(
        "vec_id", f"transform(v, c -> cast(floor(c * {SCALE}) as bigint)) as y")


def _groups(batch: pa.RecordBatch, at: int):
    """(rows, matrix of longs) for each vector length in the batch."""
    lists = batch.column(at)
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for length in np.unique(sizes).tolist():
        if length:
            rows = np.flatnonzero(sizes == length)
            yield rows, flat[offsets[rows][:, None] + np.arange(length)]


@dataclass
class Centre:
    """Count and exact sums (of y) of the fit list of one length."""
    n: int
    sums: list[int]

    def __post_init__(self):
        mid = [round(s / self.n) for s in self.sums]
        #: y - base and n * base - sums keep n * y - sums = n * (y - base) + rest small
        self.base = np.array(mid, np.int64)
        self.rest = [self.n * m - s for m, s in zip(mid, self.sums)]

    def spread(self, y: np.ndarray):
        """n * x - S, exactly: longs where they fit, Python integers else."""
        # a long difference of longs wraps at most once; one of this size is told apart before
        away = y - self.base if np.abs(y).max(initial=0) < 1 << 61 and np.abs(self.base).max() < 1 << 61 else None
        most = LONGEST if away is None else int(np.abs(away).max(initial=0))
        if most * self.n + max(map(abs, self.rest)) < LONGEST:
            return away * self.n + np.array(self.rest, np.int64)
        wide = y.astype(object) - self.base.astype(object)
        return wide * self.n + np.array(self.rest, dtype=object)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """x - S/n in double, rounded once."""
        return (self.spread(y) / self.n).astype(np.float64)

    def deviation(self, y: np.ndarray) -> list:
        d = self.spread(y)
        if d.dtype != object and int(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 1 << 63:
            return (d * d).sum(axis=1).tolist()
        total = (d.astype(object) ** 2).sum(axis=1)
        return [int(t) if t < 1 << 63 else None for t in total]


def centres(fit: DataFrame) -> dict[int, Centre]:
    """Count and sums of each length, exact: two halves of each entry are summed apart."""
    def add(batches):
        found: dict[int, list] = {}
        for batch in batches:
            for rows, y in _groups(batch, 0):
                for i in range(0, len(rows), 1 << 20):
                    part = y[i:i + (1 << 20)]
                    high, low = (part >> 32).sum(axis=0), (part & 0xFFFFFFFF).sum(axis=0)
                    was = found.setdefault(y.shape[1], [0, 0, 0])
                    was[0] += len(part)
                    was[1] = was[1] + high
                    was[2] = was[2] + low
        for length, (n, high, low) in found.items():
            yield pa.RecordBatch.from_pydict({
                "length": pa.array([length] * length, pa.int32()), "dim": pa.array(range(length), pa.int32()),
                "n": pa.array([n] * length, pa.int64()), "high": pa.array(high, pa.int64()),
                "low": pa.array(low, pa.int64())})

    wide = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("n", "high", "low")]
    parts = fit.mapInArrow(add, "length int, dim int, n long, high long, low long")
    out: dict[int, list] = {}
    for r in parts.groupBy("length", "dim").agg(*wide).orderBy("length", "dim").collect():  # one row a dimension
        out.setdefault(r["length"], []).append((int(r["n"]), (int(r["high"]) << 32) + int(r["low"])))
    return {length: Centre(rows[0][0], [s for _, s in rows]) for length, rows in out.items()}


def _summed(fit: DataFrame, one, label: str) -> dict[int, np.ndarray]:
    """The sum over the fit list of ``one(length, y)``, a matrix for each length."""
    def add(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for rows, y in _groups(batch, 0):
                length = y.shape[1]
                for i in range(0, len(rows), 1 << 14):
                    part = one(length, y[i:i + (1 << 14)])
                    found[length] = found[length] + part if length in found else part
        for length, matrix in found.items():
            yield pa.RecordBatch.from_pydict({
                "length": pa.array([length] * len(matrix), pa.int32()), "i": pa.array(range(len(matrix)), pa.int32()),
                "line": pa.array(list(matrix), pa.list_(pa.float64()))})

    def join(part: pa.Table) -> pa.Table:
        lines = part.column("line").combine_chunks()
        values = lines.values.to_numpy(zero_copy_only=False).reshape(len(lines), -1)
        line = [math.fsum(values[:, j]) for j in range(values.shape[1])]  # the same in any order
        return pa.Table.from_pydict({"length": part.column("length")[:1], "i": part.column("i")[:1],
                                     "line": pa.array([line], pa.list_(pa.float64()))})

    schema = "length int, i int, line array<double>"
    few = fit.coalesce(MATRICES)  # at most so many matrices are shuffled
    lines = materialize(few.mapInArrow(add, schema).groupBy("length", "i").applyInArrow(join, schema), label)
    out: dict[int, list] = {}
    for r in lines.orderBy("length", "i").collect():  # one matrix for each length
        out.setdefault(r["length"], []).append(r["line"])
    return {length: np.array(rows) for length, rows in out.items()}


def exact_product(a: np.ndarray, b: np.ndarray, slices: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """a @ b as a pair (high, low): both are cut into slices so short that products of slices are exact."""
    bits = (53 - math.ceil(math.log2(max(2, a.shape[1])))) // 2

    def cut(m: np.ndarray, axis: int):
        rest, parts = m.astype(np.float64), []
        for _ in range(slices):
            top = np.abs(rest).max(axis=axis, keepdims=True)
            _, exponent = np.frexp(top)
            unit = np.ldexp(1.0, exponent - bits)  # entries are multiples of it, below 2^bits of them
            part = np.trunc(rest / unit) * unit
            parts.append(part)
            rest = rest - part
        return parts

    high, low = np.zeros((a.shape[0], b.shape[1])), np.zeros((a.shape[0], b.shape[1]))
    left, right = cut(a, 1), cut(b, 0)
    for total in range(2 * slices - 1):
        for i in range(max(0, total - slices + 1), min(total, slices - 1) + 1):
            term = left[i] @ right[total - i]
            new = high + term
            back = new - high
            low += (high - (new - back)) + (term - back)
            high = new
    return high, low


def _triple(x: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x' v x as a pair."""
    high, low = exact_product(v, x)
    a, b = exact_product(x.T, high)
    return a, b + x.T @ low


def refined_eigen(v: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    d = len(v)
    top = float(np.abs(v).max(initial=0.0))
    if top == 0.0:
        return np.zeros(d), np.eye(d)
    unit = math.ldexp(1.0, math.frexp(top)[1])
    v = v / unit
    _, x = np.linalg.eigh(v.astype(np.float32))
    x = x.astype(np.float64)
    eye, best, worse = np.eye(d), (np.inf, x, np.zeros(d)), 0
    for _ in range(rounds):
        high, low = exact_product(x.T, x)
        r = (eye - high) - low
        high, low = _triple(x, v)
        t = high + low
        value = np.diag(t) / (1.0 - np.diag(r))
        order = np.argsort(-value, kind="stable")
        x, value, r, t = x[:, order], value[order], r[np.ix_(order, order)], t[np.ix_(order, order)]
        off = t - np.diag(np.diag(t))
        error = float(max(np.linalg.norm(off), np.linalg.norm(r)))
        worse = 0 if error < best[0] / 2 else worse + 1
        if error < best[0]:
            best = (error, x, value)
        if worse == 3:  # what double holds is reached
            break
        limit = 2.0 * (np.linalg.norm(off, 2) + np.linalg.norm(v, 2) * np.linalg.norm(r, 2))
        gap = value[None, :] - value[:, None]
        far = np.abs(gap) > limit
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(far, (t + value[None, :] * r) / np.where(far, gap, 1.0), r / 2)
        x = x + x @ e
        start = 0  # clusters: runs of eigenvalues whose neighbours are too close
        for end in range(1, d + 1):
            if end < d and value[end - 1] - value[end] <= limit:
                continue
            if end - start > 1:
                part = x[:, start:end]
                middle = float(value[start:end].mean())
                high, low = _triple(part, v - middle * eye)
                small = high + low
                _, turn = np.linalg.eigh((small + small.T) / 2)
                x[:, start:end] = part @ turn[:, ::-1]
            start = end
    _, x, value = best
    x = x / np.sqrt((x * x).sum(axis=0))
    lead = np.abs(x).argmax(axis=0)
    return value * unit, x * np.where(x[lead, np.arange(d)] < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What whitens vectors of one length."""
    centre: Centre
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    has_spread: np.ndarray
    identity_error: float = 0.0

    def whiten(self, y: np.ndarray) -> np.ndarray:
        """One column a component; those without variance are zero."""
        out = self.centre.centred(y) @ self.directions
        return out / np.sqrt(np.where(self.has_spread, self.values, 1.0)) * self.has_spread


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """Whitening of each vector length from the distinct vectors ``fit`` (one column, y)."""
    centre = centres(fit)

    def products(length, y):
        z = centre[length].centred(y)
        return z.T @ z

    models = {}
    for length, total in _summed(fit, products, "covariance").items():
        v = (total + total.T) / 2 / centre[length].n
        values, x = refined_eigen(v)
        k = min(components, length)
        trace = math.fsum(np.diag(v))
        spread = values[:k] > length * 2.0 ** -48 * max(values[0], 0.0)
        share = np.where(spread, values[:k], 0.0) / trace if trace > 0 else np.zeros(k)
        models[length] = Whitening(centre[length], values[:k], x[:, :k], share, spread)

    def outer(length, y):
        w = models[length].whiten(y)
        return w.T @ w

    if models:
        for length, total in _summed(fit, outer, "whitened").items():
            m = models[length]
            away = np.abs(total / m.centre.n - np.eye(len(total)))[np.ix_(m.has_spread, m.has_spread)]
            m.identity_error = float(away.max(initial=0.0))
    return models


WHITENED = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
            "identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
           vec_col: str = "embedding") -> DataFrame:
    """Per usable row and component: its whitened value, with figures of the row and of the fit."""
    rows = usable(vectors, id_col, vec_col)
    fit = materialize(rows.where("size(y) > 0").select("y").distinct(), "fit-list")
    models = fit_whitening(fit, components)

    def apply(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(i, 1 << 13)
                for at, y in _groups(part, 1):
                    m = models[y.shape[1]]
                    w, k = m.whiten(y), len(m.values)
                    take = pa.array(np.repeat(np.arange(len(at)), k))
                    yield pa.RecordBatch.from_pydict({
                        "vec_id": part.column(0).take(pa.array(at)).take(take),
                        "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                        "n": pa.array(np.full(len(take), m.centre.n, np.int64)),
                        "deviation": pa.array(m.centre.deviation(y), pa.int64()).take(take),
                        "whitened": pa.array(w.ravel(), mask=np.tile(~m.has_spread, len(at))),
                        "explained": pa.array(np.tile(m.explained, len(at))),
                        "identity_error": pa.array(np.full(len(take), m.identity_error))})

    return rows.where("size(y) > 0").mapInArrow(apply, WHITENED)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings on the first 16 whitened components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
