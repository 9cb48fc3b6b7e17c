"""Running sums over ordered groups that stay parallel when one group is huge.

A plain ``sum().over(partitionBy(g).orderBy(t))`` sorts each group inside one
task; a group holding a third of all rows then runs on one core.  Here the
rows are range-partitioned on ``(group, order)`` -- the sampled range bounds
split a hot group into several consecutive blocks -- and

1. each block computes its local prefix sums (bounded by the block size),
2. a tiny per-(group, block) table carries each block's total forward
   (a window over at most #blocks rows per group),
3. the carries are joined back: ``S = carry + local prefix``.

Running minima of ``S`` are carried the same way.

The block id is the range-partition index.  Range bounds come from sampling,
so two evaluations of the same plan could cut blocks differently; the blocked
rows are therefore materialised once with a reliable ``checkpoint()`` (to the
cluster's ``spark.checkpoint.dir``) and every later step reads those files.
Blocks are contiguous runs of the ``(group, order)`` sort, so any sub-group
(a group further split by another column) can reuse them unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UNB = Window.unboundedPreceding
BLOCK = "_blk"


def assign_blocks(df: DataFrame, part: list[str], order: list[Column],
                  blocks: int | None = None) -> DataFrame:
    """Tag rows with ordered block ids (range partitions of ``(part, order)``)
    and materialise them once so the ids are fixed."""
    from ..session import ensure_checkpoint_dir

    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = (df.repartitionByRange(n, *[F.col(p) for p in part], *order)
         .withColumn(BLOCK, F.spark_partition_id()))
    return r.checkpoint(eager=True)


def running_sum(df: DataFrame, part: list[str], order: list[Column], value: Column,
                out: str, min_out: str | None = None, prev_min_out: str | None = None,
                blocks: int | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` per ``part`` in ``order``.

    ``min_out``: running minimum of ``out`` (inclusive); ``prev_min_out``: the
    minimum over the strictly earlier rows (null on a group's first row).
    ``order`` must be a total order within each group.  ``df`` may already
    carry block ids (``assign_blocks``) whose blocks are contiguous in
    ``order``; otherwise they are assigned here.  The block column is kept.
    """
    if BLOCK not in df.columns:
        df = assign_blocks(df, part, order, blocks)
    pcols = [F.col(p) for p in part]
    r = df.withColumn("_v", value)
    w_in = Window.partitionBy(*pcols, F.col(BLOCK)).orderBy(*order)
    r = r.withColumn("_ls", F.sum("_v").over(w_in.rowsBetween(_UNB, Window.currentRow)))
    if min_out or prev_min_out:
        r = r.withColumns({
            "_lmin": F.min("_ls").over(w_in.rowsBetween(_UNB, Window.currentRow)),
            "_lpmin": F.min("_ls").over(w_in.rowsBetween(_UNB, -1)),
        })
    blk = r.groupBy(*pcols, BLOCK).agg(F.sum("_v").alias("_bs"), F.min("_ls").alias("_bm"))
    wb = Window.partitionBy(*pcols).orderBy(BLOCK).rowsBetween(_UNB, -1)
    blk = (blk.withColumn("_carry", F.coalesce(F.sum("_bs").over(wb), F.lit(0)))
           .withColumn("_cmin", F.min(F.col("_carry") + F.col("_bm")).over(wb))
           .drop("_bs", "_bm"))
    j = r.join(blk, part + [BLOCK])
    j = j.withColumn(out, F.col("_carry") + F.col("_ls"))
    if min_out:
        j = j.withColumn(min_out, F.least(F.col("_cmin"), F.col("_carry") + F.col("_lmin")))
    if prev_min_out:
        j = j.withColumn(prev_min_out, F.least(F.col("_cmin"), F.col("_carry") + F.col("_lpmin")))
    return j.drop("_v", "_ls", "_lmin", "_lpmin", "_carry", "_cmin")


def number_rows(df: DataFrame, order: list[Column], out: str = "No.", part: list[str] | None = None,
                blocks: int | None = None) -> DataFrame:
    """P15 for tables of any size: ``out`` = 1, 2, ... in ``order``, overall or within ``part``.

    Range partitions are numbered by themselves and the counts of the earlier ones are carried
    forward, so no window holds the table, nor a large part.
    """
    return running_sum(df, part or [], order, F.lit(1).cast("bigint"), out, blocks=blocks).drop(BLOCK)
