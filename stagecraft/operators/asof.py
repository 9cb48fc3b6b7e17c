"""As-of pick (J5) that stays parallel when one key holds much of the rows.

Both sides are united.  Keys that one task can hold are shuffled once, by key, and their last
earlier row is carried forward in time order.  The rows of the others are range-partitioned on
(key, time) into blocks, so a hot key spans many blocks and no task holds it whole: within a
block the last earlier row is carried forward; across blocks a table of one row per (key, block)
carries it.  Nothing is joined by ``<``: every row is sorted once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import c
from .sequences import BLOCK, assign_blocks
from .status import busy_keys


def asof_before(left: DataFrame, right: DataFrame, key: str, left_time: Column, right_time: Column,
                payload: Column, latest: list[Column] | None = None, out: str = "_asof",
                blocks: int | None = None) -> DataFrame:
    """Every row of ``left`` with ``out``: the payload of the last row of ``right`` of the same key
    whose time is strictly earlier, or null.

    ``latest`` orders rows of equal time (ascending, nulls first: the last one wins).  Rows of
    ``left`` without a key or a time are kept, without a match.  With ``blocks`` given, all keys
    are cut into that many blocks.
    """
    ties = latest or []
    names = [f"_o{i}" for i in range(len(ties))]
    row = F.struct(*[c(n) for n in left.columns])
    rtype = right.select(payload.alias("p")).schema["p"].dataType
    ttypes = [right.select(t.alias("t")).schema["t"].dataType for t in ties]
    lrow = left.select(c(key).alias("_key"), left_time.alias("_t"), F.lit(0).alias("_side"), row.alias("_row"),
                       *[F.lit(None).cast(t).alias(n) for n, t in zip(names, ttypes)],
                       F.lit(None).cast(rtype).alias("_p"))
    usable = F.col("_key").isNotNull() & F.col("_t").isNotNull()
    rrow = right.select(c(key).alias("_key"), right_time.alias("_t"), F.lit(1).alias("_side"),
                        F.lit(None).cast(lrow.schema["_row"].dataType).alias("_row"),
                        *[t.alias(n) for n, t in zip(names, ties)], payload.alias("_p")).where(usable)
    # a struct, so that a null payload of the last row is told from no row
    both = lrow.where(usable).unionByName(rrow).withColumn("_p", F.when(F.col("_side") == 1, F.struct("_p")))
    order = [F.col("_t").asc(), F.col("_side").asc(), *[F.col(n).asc_nulls_first() for n in names]]
    alone = lrow.where(~usable).select("_row", F.lit(None).cast(rtype).alias(out))
    if blocks is None:
        busy = busy_keys(both, "_key")
        so_far = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        calm = (both.where(~F.col("_key").isin(busy)) if busy else both).withColumn(
            "_here", F.last("_p", ignorenulls=True).over(so_far))
        alone = calm.where("_side = 0").select("_row", F.col("_here")["_p"].alias(out)).unionByName(alone)
        if not busy:
            return alone.select("_row.*", out)
        both = both.where(F.col("_key").isin(busy))
    both = assign_blocks(both, ["_key"], order, blocks)
    inside = (Window.partitionBy("_key", BLOCK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumn("_here", F.last("_p", ignorenulls=True).over(inside))
    newest = F.max(F.when(F.col("_side") == 1, F.struct("_t", *names, "_p")))
    carried = both.groupBy("_key", BLOCK).agg(newest.alias("_n")).withColumn("_carry", F.last(
        "_n", ignorenulls=True).over(Window.partitionBy("_key").orderBy(BLOCK)
                                     .rowsBetween(Window.unboundedPreceding, -1))["_p"]).drop("_n")
    found = (both.where("_side = 0").join(carried, ["_key", BLOCK])
             .select(F.col("_row"), F.coalesce("_here", "_carry")["_p"].alias(out)))
    return found.unionByName(alone).select("_row.*", out)
