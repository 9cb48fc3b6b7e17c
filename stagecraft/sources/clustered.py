"""Tables clustered on dates, with the date ranges of every file (data skipping for F8).

F8 keeps a row if any of twelve dates lies in a range.  On files in no order every file holds
dates of every year, and no row group can be skipped.  Here the table is written range-partitioned
and sorted on its leading dates, and a small table beside it has the smallest and largest value of
every date column in every file.  A range query reads the files whose ranges it touches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import c, present
from ..functions.periods import ntz_lit
from ..operators.filters import filter_any_date_in_range


def write_clustered(df: DataFrame, path: str, cluster_on, dates, files: int | None = None) -> str:
    """Write ``df`` in about ``files`` date-ordered files, and their date ranges beside them."""
    spark = df.sparkSession
    base = path.rstrip("/")
    order = [c(n).asc_nulls_last() for n in present(df, cluster_on)]
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{base}/data")
    stored = spark.read.schema(df.schema).parquet(f"{base}/data")
    held = present(df, dates)
    bounds = [f(c(name)).alias(f"{side}{i}") for i, name in enumerate(held)
              for side, f in (("low", F.min), ("high", F.max))]
    ranges = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(*bounds)
    per_column = F.array(*[F.struct(F.lit(name).alias("column"), F.col(f"low{i}").alias("low"),
                                    F.col(f"high{i}").alias("high")) for i, name in enumerate(held)])
    ranges.select("file", F.inline(per_column)).write.mode("overwrite").parquet(f"{base}/ranges")
    return base


def files_in_range(spark: SparkSession, path: str, dates, start, end) -> list[str]:
    """The files with a value of one of ``dates`` in ``[start, end)``, as the reader would list them."""
    ranges = spark.read.parquet(f"{path.rstrip('/')}/ranges").where(F.col("column").isin(list(dates)))
    touched = ranges.where((F.col("low") < ntz_lit(end)) & (F.col("high") >= ntz_lit(start)))
    return sorted(r["file"] for r in touched.select("file").distinct().collect())


def read_in_range(spark: SparkSession, path: str, dates, start, end) -> DataFrame:
    """F8 over a clustered table: rows with any of ``dates`` in the range, from the touched files."""
    base = path.rstrip("/")
    everything = spark.read.parquet(f"{base}/data")
    files = files_in_range(spark, base, dates, start, end)
    some = spark.read.schema(everything.schema).parquet(*files) if files else everything.limit(0)
    return filter_any_date_in_range(some, start, end, present(everything, dates))
