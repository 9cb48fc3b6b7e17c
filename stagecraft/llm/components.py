"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of an edge and the smallest node it is connected with.

    ``edges`` has two long columns (a, b), any order, repeats and loops allowed.  Each
    round links every node's larger neighbours to its smallest one and then its smaller
    neighbours to the smallest of them, until nothing changes.  What a step joins is a
    written table, so that adaptive execution can split a hub's rows; only three numbers
    per round come to the driver.
    """
    a, b = edges.columns
    cur = materialize(edges.where(F.col(a) != F.col(b))
                      .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m"))
                          .select("a", F.least("a", "m").alias("m")), "low")
        large = materialize(both.join(low, "a").where("b > a")
                            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a")
        cur = materialize(small.where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
                          .unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")),
                      F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
