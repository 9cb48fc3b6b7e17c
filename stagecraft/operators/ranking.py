"""Per-key "pick a row" operators (dedupe, latest, top-2).

Every pick ends in a total order: the named order column(s), then explicit
tie-break columns.  Ties on every column are resolved the same way on every
run, whatever the input partitioning.

``row_number() <= k`` plans as ``WindowGroupLimit`` with a *partial* pass
before the shuffle, so a key holding a third of all rows is cut down to ``k``
rows per map task before anything moves; the hot key never lands whole in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import KEY, c, present


def _desc(cols) -> list[Column]:
    return [c(n).desc_nulls_last() for n in cols]


def _asc(cols) -> list[Column]:
    return [c(n).asc_nulls_last() for n in cols]


def top_k_per_key(df: DataFrame, keys, order: list[Column], k: int,
                  rank_col: str = "_rn") -> DataFrame:
    """Rows ranked ``1..k`` per key by ``order`` (a total order); adds ``rank_col``."""
    w = Window.partitionBy(*[c(n) for n in keys]).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)


def dedupe_keep_first(df: DataFrame, key: str = KEY, order_by=("_seq",)) -> DataFrame:
    """One row per key, the first in load order; null keys form one group.

    ``order_by`` names the load-order column(s) (ascending); see
    :func:`with_load_order` for single-file sources without one.
    """
    order = present(df, order_by)
    if not order:
        raise ValueError("dedupe_keep_first needs a load-order column; see with_load_order()")
    return top_k_per_key(df, [key], _asc(order), 1).drop("_rn")


def with_load_order(df: DataFrame, name: str = "_seq") -> DataFrame:
    """Tag rows with a load-order number straight after reading one file."""
    return df.withColumn(name, F.monotonically_increasing_id())


def dedupe_latest(df: DataFrame, key: str = KEY, ts: str = "Modified Date",
                  tiebreak=()) -> DataFrame:
    """Per key the row with the newest ``ts`` (nulls last); skipped if ``ts`` is absent."""
    if ts not in df.columns:
        return df
    return top_k_per_key(df, [key], _desc([ts] + present(df, tiebreak)), 1).drop("_rn")


def latest_per_key(df: DataFrame, key: str = KEY, ts: str = "Modified Date",
                   tiebreak=()) -> DataFrame:
    """Top-1 by ``ts`` descending per key (the batch form of a one-key lookup)."""
    return dedupe_latest(df, key, ts, tiebreak)


def duplicate_keys(df: DataFrame, key: str = KEY) -> DataFrame:
    """The keys that occur more than once, as ``_dk`` (null keys count as equal)."""
    return df.groupBy(c(key).alias("_dk")).count().filter(F.col("count") > 1).select("_dk")


def duplicate_rows(df: DataFrame, key: str = KEY, keys: DataFrame | None = None) -> DataFrame:
    """All rows whose key occurs more than once (null keys count as equal).

    Counted with a map-side-combined aggregate, then semi-joined back, so a hot
    key is never gathered into one window partition.  Stored ``duplicate_keys`` may be
    given: their size is known then, and few of them are sent to the rows.
    """
    dup = duplicate_keys(df, key) if keys is None else keys
    return df.join(dup, c(key).eqNullSafe(F.col("_dk")), "left_semi")
