"""Incremental merge of two snapshots past a high-water mark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import c
from .clean import map_category


def union_by_name(*dfs: DataFrame | None) -> DataFrame:
    """Append with an outer union of columns, first-seen order, duplicates kept.

    ``None`` stands for an empty frame without columns and is skipped.
    """
    live = [d for d in dfs if d is not None]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), live)


def watermark(df: DataFrame, col: str = "Created Date") -> Column | None:
    """A1: ``max(col)`` as a lazy scalar subquery; ``None`` if the column is absent.

    The subquery scans only ``col`` (column pruning), so reusing ``df`` here
    costs one narrow scan rather than a cached copy of the table.
    """
    if col not in df.columns:
        return None
    return df.select(F.max(c(col))).scalar()


def watermark_frame(df: DataFrame, col: str = "Created Date") -> DataFrame:
    """A1 as a one-row frame (null when all values are null or absent)."""
    if col not in df.columns:
        return df.sparkSession.range(1).select(F.lit(None).cast("timestamp_ntz").alias("watermark"))
    return df.agg(F.max(c(col)).alias("watermark"))


def filter_after_watermark(df: DataFrame, col: str, wm: Column | None) -> DataFrame | None:
    """rows with ``col`` strictly after the watermark.

    Column absent -> ``None`` (an empty frame without columns).  A null
    watermark lets nothing through; no watermark (``None``) lets every
    non-null value through.
    """
    if col not in df.columns:
        return None
    if wm is None:
        return df.filter(c(col).isNotNull())
    return df.filter(c(col) > wm)


def incremental_merge(p1rdb: DataFrame, p2rdb: DataFrame, dsr1rdb: DataFrame,
                      dsr2rdb: DataFrame, main: DataFrame | None = None,
                      wm: Column | None = None) -> dict[str, DataFrame]:
    """Q3: main = p1 + dsr1; watermark = max(main.Created Date);
    weekly = (p2 modified after it) + (dsr2 created after it); modified = main + weekly.

    A stored ``main`` and its watermark, where they are known already, are taken as given.
    """
    if main is None:
        main = union_by_name(p1rdb, dsr1rdb)
    if wm is None:
        wm = watermark(main)
    p2f = filter_after_watermark(p2rdb, "Modified Date", wm)
    dsr2f = filter_after_watermark(dsr2rdb, "Created Date", wm)
    weekly = union_by_name(p2f, dsr2f) if (p2f is not None or dsr2f is not None) else None
    modified = map_category(union_by_name(main, weekly))
    return {"main_rdb": main, "p2rdb_filtered": p2f, "dsr2rdb_filtered": dsr2f,
            "weekly_rdb": weekly, "modified_rdb": modified}
