"""Load order over several files ("first" in W1 means the order of the files).

Rows are numbered 0, 1, ... by file path, place of the block in its file, and place in the
block, whatever the splits.  The first pass counts the rows of every block (a block is the part
of a file that one task reads at a stretch) and carries the counts forward over one row per
block; the second adds each row's place in its block.  No row is sorted or shuffled.

Both passes read the same files with the same session settings, so they see the same blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import c


def number_by_file(df: DataFrame, name: str = "_seq") -> DataFrame:
    """``df``, read from files and not shuffled since, with its load order as ``name``."""
    placed = df.select("*", F.col("_metadata.file_path").alias("_file"),
                       F.col("_metadata.file_block_start").alias("_at"),
                       F.monotonically_increasing_id().alias("_id"))
    sizes = placed.groupBy("_file", "_at").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    # one row per block; files are numbered by themselves first, so no window holds all blocks
    inside = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.withColumn("_in_file", F.coalesce(F.sum("_rows").over(inside), F.lit(0)))
    files = sizes.groupBy("_file").agg(F.sum("_rows").alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    starts = blocks.join(files, "_file").select(
        "_file", "_at", (F.col("_before") + F.col("_in_file") - F.col("_first")).alias("_start"))
    # one row per block: sent to the tasks, or all rows of a file would meet in one of them
    return (placed.join(F.broadcast(starts), ["_file", "_at"])
            .withColumn(name, F.col("_start") + F.col("_id")).select(*[c(n) for n in df.columns], name))
