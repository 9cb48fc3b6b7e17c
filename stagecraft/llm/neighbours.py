"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to ``DIMS`` dimensions by a fixed Gaussian (2-stable) matrix: for two
vectors at distance s, the squared projected distance is s^2 times a chi-square variable
with ``DIMS`` degrees of freedom.  The projected space is cut into cells by a kd-tree
fitted on a bounded sample (about ``SAMPLE`` rows, projected on the executors); every vector is indexed in its cell, and each
cell carries a kd-tree of its own.

A query takes its projected neighbours in growing distance and verifies each with the true
distance.  It stops at projected distance d when the chi-square probability of
d^2 / (k-th best distance)^2 reaches ``CERTAINTY``: a nearer vector not yet met would have
had a smaller projection with at least that probability, which is the recall to expect.
The search runs first in the query's own cell and then, with the k-th distance found there
as the bound, in the other cells that the stopping radius reaches.

Copies: of equal vectors only the ``k + 1`` smallest ids can be among a query's nearest,
so only those are indexed (exact, and no cell grows with a vector that many rows share).
Equal query vectors are one question: its ``k + 1`` nearest rows hold the ``k`` nearest of
each query that asks it, whose own row is then left out.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no
part, nor do rows with a null ``vec_id``; vectors of different lengths have no distance, so
each length is searched by itself; repeated rows count once; equal distances go to the
smaller id; with fewer than ``k`` candidates all are returned; without queries or vectors
there is no row; other columns are not read.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

DIMS = 8
CERTAINTY = 0.98
SAMPLE = 32_768
CELL_ROWS = 4096
LEAF_ROWS = 256
SEED = 20_240_601


def chi_square_cdf(x: float, dims: int) -> float:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, dims // 2):
        term *= half / i
        total += term
    return 1.0 - math.exp(-half) * total if half < 700 else 1.0


def stopping_factor(certainty: float = CERTAINTY, dims: int = DIMS) -> float:
    """Projected distance, in units of the k-th true distance, from which the test holds."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square_cdf(mid, dims) < certainty else (low, mid)
    return math.sqrt(high)


def projection(length: int, dims: int = DIMS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims))


class KdTree:
    """Points in buckets; ``visit`` yields buckets in growing distance from a point."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        self.points = points
        self.nodes: list = []
        if len(points):
            self._build(np.arange(len(points)), leaf_rows)

    def _build(self, rows: np.ndarray, leaf_rows: int) -> int:
        part = self.points[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        me = len(self.nodes)
        self.nodes.append(None)
        axis = int(np.argmax(high - low))
        if len(rows) <= leaf_rows or high[axis] == low[axis]:
            self.nodes[me] = (low, high, rows, -1, -1)
            return me
        order = np.argsort(part[:, axis], kind="stable")
        half = len(rows) // 2
        left = self._build(rows[order[:half]], leaf_rows)
        right = self._build(rows[order[half:]], leaf_rows)
        self.nodes[me] = (low, high, None, left, right)
        return me

    def _away(self, node: int, point: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        gap = np.maximum(np.maximum(low - point, point - high), 0.0)
        return math.sqrt(float(gap @ gap))

    def visit(self, point: np.ndarray):
        heap = [(self._away(0, point), 0)] if self.nodes else []
        while heap:
            away, node = heapq.heappop(heap)
            _, _, rows, left, right = self.nodes[node]
            if rows is not None:
                yield away, rows
            else:
                heapq.heappush(heap, (self._away(left, point), left))
                heapq.heappush(heap, (self._away(right, point), right))


class Cells:
    """A kd-tree of cut values; leaves are cells with (unbounded) boxes."""

    def __init__(self, points: np.ndarray, cells: int):
        self.axis: list[int] = []
        self.cut: list[float] = []
        self.child: list[tuple[int, int]] = []
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        dims = points.shape[1]
        self.root = self._build(points, max(1, cells), np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _build(self, points, cells, low, high) -> int:
        """A node number, or minus one minus the cell number."""
        spread = points.max(axis=0) - points.min(axis=0) if len(points) else np.zeros(1)
        if cells == 1 or len(points) < 2 or spread.max() == 0:
            self.low.append(low)
            self.high.append(high)
            return -len(self.low)
        axis, part = int(np.argmax(spread)), cells // 2
        values = np.sort(points[:, axis])
        cut = float(values[len(values) * part // cells])
        if cut == values[0]:
            cut = float(values[np.searchsorted(values, cut, "right")])
        me = len(self.axis)
        self.axis.append(axis)
        self.cut.append(cut)
        self.child.append((0, 0))
        below = points[:, axis] < cut
        high_left, low_right = high.copy(), low.copy()
        high_left[axis] = low_right[axis] = cut
        self.child[me] = (self._build(points[below], part, low, high_left),
                          self._build(points[~below], cells - part, low_right, high))
        return me

    def find(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            below = points[rows, self.axis[node]] < self.cut[node]
            todo.append((self.child[node][0], rows[below]))
            todo.append((self.child[node][1], rows[~below]))
        return out

    def within(self, point: np.ndarray, radius: float) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        return np.flatnonzero((gap * gap).sum(axis=1) <= radius * radius)


def search(tree: KdTree, vectors: np.ndarray, ids: np.ndarray, point: np.ndarray, vector: np.ndarray,
           k: int, bound: float, factor: float) -> list[tuple[float, int]]:
    """The k nearest of one cell, by incremental projected neighbours and the stopping test."""
    best_d, best_i = np.zeros(0), np.zeros(0, np.int64)
    for away, rows in tree.visit(point):
        radius = bound * factor * (1 + 1e-9) + 1e-9
        if away > radius:
            break
        near = rows if math.isinf(bound) else rows[
            np.sqrt(((tree.points[rows] - point) ** 2).sum(axis=1)) <= radius]
        if not len(near):
            continue
        d = np.sqrt(((vectors[near] - vector) ** 2).sum(axis=1))
        best_d, best_i = np.concatenate([best_d, d]), np.concatenate([best_i, ids[near]])
        if len(best_d) > k:
            keep = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[keep], best_i[keep]
        if len(best_d) == k:
            bound = min(bound, float(best_d.max()))
    return list(zip(best_d.tolist(), best_i.tolist()))


def _matrix(column, dtype=np.float64) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    bad = "exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    return rows.where(f"vec_id is not null and v is not null and size(v) > 0 and not {bad} and exists(v, x -> x <> 0)")


INDEXED = "cell int, vec_id long, v array<double>, p array<double>"
FOUND = "query_id long, vec_id long, score double"


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding",
            cell_rows: int = CELL_ROWS, certainty: float = CERTAINTY) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows of each query row.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows but the query's own.
    """
    rows = usable(vectors, id_col, vec_col)
    lengths = [r["n"] for r in rows.groupBy(F.size("v").alias("n")).count().orderBy("n").collect()]
    found = [_nearest(rows.where(F.size("v") == n), n, is_query, k, cell_rows, certainty) for n in lengths]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _nearest(rows: DataFrame, length: int, is_query, k: int, cell_rows: int, certainty: float) -> DataFrame:
    """The search among vectors of one length."""
    copies = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = rows.withColumn("c", copies).where(F.col("c") <= k + 1).select("vec_id", "v").dropDuplicates(["v", "vec_id"])
    kept = materialize(kept, "vectors")
    n = kept.count()
    matrix = projection(length)

    def project(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(_matrix(batch.column(0)) @ matrix), pa.list_(pa.float64()))], names=["p"])

    picked = F.pmod(F.xxhash64(F.lit("cells"), "vec_id"), F.lit(1 << 30)) < (1 << 30) * min(1.0, SAMPLE / n)
    sample = kept.where(picked).select("v").mapInArrow(project, "p array<double>").toArrow()  # about SAMPLE rows
    cells = Cells(_matrix(sample.column(0)) if sample.num_rows else np.zeros((0, DIMS)), -(-n // cell_rows))
    factor = stopping_factor(certainty)

    def place(batches):
        for batch in batches:
            if batch.num_rows:
                p = _matrix(batch.column(1)) @ matrix
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cells.find(p)), batch.column(0), batch.column(1),
                     pa.array(list(p), pa.list_(pa.float64()))], names=["cell", "vec_id", "v", "p"])

    index = materialize(kept.mapInArrow(place, INDEXED), "vector-index")
    askers = rows.where(is_query).dropDuplicates(["vec_id"])
    questions = materialize(askers.groupBy("v").agg(F.min("vec_id").alias("vec_id")).select("vec_id", "v"), "questions")
    asked_by = askers.join(questions.withColumnRenamed("vec_id", "query_id"), "v").select(
        F.col("vec_id").alias("own"), "query_id")
    queries = materialize(questions.mapInArrow(place, INDEXED), "queries")
    asked = queries.select("cell", F.col("vec_id").alias("query_id"), "v", "p", F.lit(float("inf")).alias("bound"))

    def in_cell(queries_of: pa.Table, cell: pa.Table) -> pa.Table:
        out: list[tuple[int, float, int]] = []
        if cell.num_rows and queries_of.num_rows:
            base, ids = _matrix(cell.column("v")), cell.column("vec_id").to_numpy()
            tree = KdTree(_matrix(cell.column("p")), LEAF_ROWS)
            for q, v, p, bound in zip(queries_of.column("query_id").to_pylist(), _matrix(queries_of.column("v")),
                                      _matrix(queries_of.column("p")), queries_of.column("bound").to_pylist()):
                out.extend((q, d, i) for d, i in search(tree, base, ids, p, v, k + 1, bound, factor))
        return pa.Table.from_pydict({"query_id": pa.array([o[0] for o in out], pa.int64()),
                                     "vec_id": pa.array([o[2] for o in out], pa.int64()),
                                     "score": pa.array([o[1] for o in out], pa.float64())})

    def look(at: DataFrame) -> DataFrame:
        return at.groupBy("cell").cogroup(index.groupBy("cell")).applyInArrow(in_cell, FOUND)

    home = materialize(look(asked), "home-cells")
    bounds = home.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) > k, F.max("score")).otherwise(F.lit(float("inf"))).alias("bound"))
    bounded = (queries.withColumnRenamed("vec_id", "query_id").join(bounds, "query_id", "left")
               .select("cell", "query_id", "v", "p", F.coalesce("bound", F.lit(float("inf"))).alias("bound")))

    def spread(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p, own = _matrix(batch.column(3)), batch.column(0).to_numpy()
            reach = [np.setdiff1d(cells.within(x, b * factor * (1 + 1e-9) + 1e-9 if not math.isinf(b) else math.inf), [o])
                     for x, b, o in zip(p, batch.column(4).to_pylist(), own)]
            rows_of = pa.array(np.repeat(np.arange(len(reach)), [len(r) for r in reach]))
            if len(rows_of):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(reach).astype(np.int32)), *(batch.column(i).take(rows_of) for i in (1, 2, 3, 4))],
                    names=["cell", "query_id", "v", "p", "bound"])

    others = look(bounded.mapInArrow(spread, "cell int, query_id long, v array<double>, p array<double>, bound double"))
    def first(df, by, n):
        rank = F.row_number().over(Window.partitionBy(by).orderBy("score", "vec_id"))
        return df.withColumn("rank", rank.cast("int")).where(F.col("rank") <= n)

    answers = materialize(first(home.unionByName(others).dropDuplicates(["query_id", "vec_id"]), "query_id", k + 1)
                          .drop("rank"), "answers")
    mine = asked_by.join(answers, "query_id").where("vec_id <> own").drop("query_id")
    return first(mine, "own", k).select(F.col("own").alias("query_id"), "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every hundredth vector, among all vectors."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)
