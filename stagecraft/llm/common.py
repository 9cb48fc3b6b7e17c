"""Shared helpers: the work folder, materialised intermediate tables, file access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the session's ``spark.checkpoint.dir``.

    All executors and the driver see that folder.  Only a single-machine session that
    names none (tests) gets a temporary folder; a cluster session must name one.
    """
    base = (spark.conf.get("spark.checkpoint.dir", None)
            or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
            or spark.sparkContext.getCheckpointDir())
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="stagecraft-work-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the work folder and return a frame that reads it.

    Cuts the lineage at a table that survives lost executors.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_columns(docs: DataFrame, binary: bool = False,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id long`` and ``text`` (null as empty), whatever else the table holds."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       (text.cast("binary") if binary else text).alias("text"))


def slices(batches: Iterator, rows: int) -> Iterator:
    """Arrow batches of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def file_system(path: str):
    """The pyarrow file system of a folder given as path or URI, and the path inside it."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)
