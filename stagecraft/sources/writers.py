"""Writers and exports.

The reference builds Excel workbooks in memory; here the data part of every
export is written by the cluster as table files (Parquet by default, CSV on
request), one directory per run.  Sheet-level layout (colours, frozen panes)
is presentation and not reproduced; column widths are computed (S9) so a
formatter can apply them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import EXPORT_FILTER_NAMES, KEY, WIDTH_CAP_REPORT, c
from ..functions.text import digits_only


def shared_dir(spark: SparkSession, sub: str = "stagecraft-io") -> str:
    """A fresh folder under the cluster's shared ``spark.checkpoint.dir``."""
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{sub}/{uuid.uuid4().hex}"


STORED_ROWS = 100_000  # rows a file


def stored_options(fmt: str = "parquet") -> dict:
    """Writer options of tables that later steps read whole.

    zstd needs fewer bytes.  Files of few rows bound what a task reads, since a file counts with
    at least ``spark.sql.files.openCostInBytes``: bytes alone would give a task more rows then.
    """
    return {"compression": "zstd", "maxRecordsPerFile": STORED_ROWS} if fmt == "parquet" else {}


def write_table(df: DataFrame, out_dir: str, name: str, fmt: str = "parquet",
                partition_by=None, options: dict | None = None) -> str:
    """S3: replace table ``name`` under ``out_dir`` with ``df`` (no index).  ``options``: the writer's."""
    path = f"{out_dir.rstrip('/')}/{name}"
    w = df.write.mode("overwrite").format(fmt).options(**(options or {}))
    if fmt == "csv":
        w = w.option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_by_key(df: DataFrame, out_dir: str, name: str, key: str = KEY, options: dict | None = None) -> str:
    """S3 in buckets by ``key``, as many as the session's shuffle partitions; read back with ``read_by_key``.

    Joins, windows and aggregates by the key then find its rows together and move none.  ``df``
    should lie by key already: otherwise every task writes a file for every bucket.
    """
    path = f"{out_dir.rstrip('/')}/{name}"
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.write.mode("overwrite").format("parquet").options(**(stored_options() | (options or {})))
     .option("path", path).bucketBy(buckets, key).saveAsTable(_table_of(path)))
    return path


def read_by_key(spark: SparkSession, path: str) -> DataFrame:
    """A table stored by ``write_by_key`` in this session."""
    return spark.table(_table_of(path))


def _table_of(path: str) -> str:
    return "stagecraft_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def filters_frame(spark: SparkSession, selected: dict, names=EXPORT_FILTER_NAMES,
                  label: str = "Filters") -> DataFrame:
    """The (filter, selected value) block written in front of a report."""
    rows = [(n, str(selected.get(n, "All"))) for n in names]
    return spark.createDataFrame(rows, f"`{label}` string, Selected string")


def report_export(df: DataFrame, out_dir: str, name: str, selected: dict,
                  fmt: str = "parquet", names=EXPORT_FILTER_NAMES) -> dict[str, str]:
    """Write a report and, beside it, its filter block (one row per name in ``names``)."""
    block = filters_frame(df.sparkSession, selected, names)
    return {"report": write_table(df, out_dir, name, fmt),
            "filters": write_table(block, out_dir, name + "_filters", fmt)}


WORKBOOK_SHEET_NAME = 31


def sheet_key(col=None, max_len: int | None = None):
    """Sheet name of a key: its digits, else ``Sheet1`` (X2); ``max_len`` for workbooks."""
    return digits_only(col if col is not None else c(KEY), max_len)


def history_export_by_key(history: DataFrame, out_dir: str, name: str = "history",
                          key: str = KEY, fmt: str = "parquet",
                          directory_per_sheet: bool = False) -> str:
    """History tagged with its sheet (the key's digits); keys whose digits
    coincide share a sheet, and the key column is kept to tell them apart.

    Written range-partitioned and sorted on (sheet, key, created): every file
    is a contiguous, ordered run of sheets, and a sheet with a huge history is
    split over several writer tasks instead of funnelling through one.  One
    directory per sheet (``directory_per_sheet``) mirrors the workbook layout,
    with its 31-character sheet names, but makes one small file set per key, so it is off by default.
    """
    df = history.withColumn("sheet", sheet_key(c(key), WORKBOOK_SHEET_NAME if directory_per_sheet else None))
    order = [c(n).asc_nulls_last() for n in
             ["sheet", key] + [n for n in ("Created Date",) if n in history.columns]]
    df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return write_table(df, out_dir, name, fmt,
                       partition_by=["sheet"] if directory_per_sheet else None)


def details_and_history_export(details: DataFrame, history: DataFrame, out_dir: str,
                               fmt: str = "parquet") -> dict[str, str]:
    """The details and the history of a batch of potentials, one run folder."""
    run = f"{out_dir.rstrip('/')}/run-{uuid.uuid4().hex[:12]}"
    return {"details": write_table(details, run, "potential_details", fmt),
            "history": write_table(history, run, "stage_history", fmt)}


def column_width_profile(df: DataFrame, cap: int = WIDTH_CAP_REPORT) -> DataFrame:
    """Per column ``min(max text length + 2, cap)`` in one aggregate pass.

    Nulls count as empty text (the reference measures 'nan'/'None').
    """
    cols = df.columns
    agg = df.agg(*[F.least(F.coalesce(F.max(F.length(c(n).cast("string"))), F.lit(0)) + 2,
                           F.lit(cap)).alias(f"w{i}") for i, n in enumerate(cols)])
    stack = F.explode(F.array(*[F.struct(F.lit(n).alias("column"),
                                         F.lit(i).cast("bigint").alias("position"),
                                         F.col(f"w{i}").cast("bigint").alias("width"))
                                for i, n in enumerate(cols)]))
    return agg.select(stack.alias("_w")).select("_w.*")
