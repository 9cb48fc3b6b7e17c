"""Readers (S1, S2, S4, S5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..columns import CSV_NULL_TOKENS, FLAG, SRL_DATE_COLUMNS, c, present


def normalize_nulls(df: DataFrame, tokens=CSV_NULL_TOKENS) -> DataFrame:
    """The default CSV null tokens become null on every string column.

    Spark's ``nullValue`` takes a single token, so the rest is one projection.
    """
    toks = list(tokens)
    todo = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not todo:
        return df
    return df.withColumns({n: F.when(c(n).isin(toks), F.lit(None).cast("string"))
                           .otherwise(c(n)) for n in todo})


def scan_csv(spark: SparkSession, path: str, tokens=CSV_NULL_TOKENS,
             multi_line: bool = True) -> DataFrame:
    """A headed CSV file or a folder of them, every column as text, then S2.

    Quoted values may hold line breaks; a file is then read by one task, so give a large
    export as many files.  ``multi_line=False`` splits files over tasks: only for exports
    known to hold no line break inside quotes.
    """
    df = (spark.read.option("header", True).option("inferSchema", False)
          .option("multiLine", multi_line).option("escape", '"').csv(path))
    return normalize_nulls(df, tokens)


def scan_table_all(spark: SparkSession, path: str, fmt: str = "parquet",
                   date_columns=SRL_DATE_COLUMNS) -> DataFrame:
    """The whole status table; date columns as timestamps (P4 if stored as
    text); ``Flag`` defaults to ``'Existing'`` when absent."""
    from ..operators.clean import parse_dates_iso
    df = parse_dates_iso(spark.read.format(fmt).load(path), date_columns)
    if FLAG not in df.columns:
        df = df.withColumn(FLAG, F.lit("Existing"))
    return df


def scan_available_columns(df: DataFrame, wanted) -> DataFrame:
    """Project the wanted columns that exist, in the wanted order."""
    return df.select(*[c(n) for n in present(df, wanted)])
