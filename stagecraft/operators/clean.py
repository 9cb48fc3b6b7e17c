"""Projection / cleaning operators for potentials and activity logs.

Every operator checks ``df.columns`` at plan time and silently skips columns
that are absent, as the source tables have optional columns.  All work is
expressed as one projection or filter, so Catalyst collapses a whole cleaning
chain into a single codegen stage with the filters pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import (CATEGORY_MAPPING, DEFAULT_MIN_DATE, DSR_DATES, DSR_DROP,
                       DSR_RENAME, DSR_TYPE, DSR_TYPE_VALUE, KEY, P_DATES, P_DROP,
                       P_RENAME, STAGE_MAPPING, c, present)
from ..functions.dates import DAYFIRST_FORMATS, formats_for, parse_dayfirst
from ..functions.periods import ntz_lit
from ..functions.text import map_values, suffix_if_in


# ------------------------------------------------------------------ projections

def drop_columns_if_present(df: DataFrame, cols) -> DataFrame:
    """Drop the listed columns; missing names are ignored."""
    return df.drop(*present(df, cols))


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename source names to common names (missing sources ignored).

    Raises if a target name already exists and is not itself renamed away,
    since that would leave two columns with one name.
    """
    live = {k: v for k, v in mapping.items() if k in df.columns}
    if not live:
        return df
    staying = set(df.columns) - set(live)
    clash = sorted(v for v in live.values() if v in staying)
    if clash:
        raise ValueError(f"rename would duplicate column(s) {clash}")
    return df.withColumnsRenamed(live)


def parse_dates_dayfirst(df: DataFrame, cols, formats=DAYFIRST_FORMATS) -> DataFrame:
    """Parse the listed text columns day-first; bad text becomes null.

    ``formats`` holds the layouts tried in turn, for all columns or per column.
    """
    todo = present(df, cols)
    if not todo:
        return df
    return df.withColumns({n: parse_dayfirst(c(n), formats_for(n, formats)) for n in todo})


def parse_text_dates(df: DataFrame, cols, formats=DAYFIRST_FORMATS) -> DataFrame:
    """P3 on those of the listed columns that hold text; timestamps stay as they are."""
    return parse_dates_dayfirst(
        df, [n for n in present(df, cols) if df.schema[n].dataType.typeName() == "string"], formats)


def unparsed_dates(df: DataFrame, cols, formats=DAYFIRST_FORMATS) -> DataFrame:
    """Per listed text column, how many non-null texts fit no layout (one aggregate pass)."""
    todo = present(df, cols)
    bad = [F.count(F.when(c(n).isNotNull() & parse_dayfirst(c(n), formats_for(n, formats)).isNull(), True))
           .alias(f"n{i}") for i, n in enumerate(todo)]
    if not todo:
        return df.sparkSession.createDataFrame([], "`column` string, unparsed long")
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"n{i}").alias("unparsed"))
                     for i, n in enumerate(todo)])
    return df.agg(*bad).select(F.inline(rows))


def parse_dates_iso(df: DataFrame, cols) -> DataFrame:
    """Re-parse ISO text columns read back from text storage (no-op on timestamps)."""
    todo = [n for n in present(df, cols)
            if df.schema[n].dataType.typeName() not in ("timestamp_ntz", "timestamp")]
    if not todo:
        return df
    return df.withColumns({n: c(n).try_cast("timestamp_ntz") for n in todo})


def map_columns(df: DataFrame, cols, mapping: dict) -> DataFrame:
    """Whole-value replacement on each present column; unmatched kept."""
    todo = present(df, cols)
    if not todo or not mapping:
        return df
    return df.withColumns({n: map_values(c(n), mapping) for n in todo})


def map_stage(df: DataFrame, cols=("Stage", "Original Stage", "New Stage"),
              mapping: dict = STAGE_MAPPING) -> DataFrame:
    """P5: stage relabelling."""
    return map_columns(df, cols, mapping)


def map_category(df: DataFrame, mapping: dict = CATEGORY_MAPPING) -> DataFrame:
    """Category relabelling."""
    return map_columns(df, ["Category"], mapping)


def canonical_executive(df: DataFrame, aliases: dict | None = None,
                        suffix_names=None, col: str = "Executive") -> DataFrame:
    """Replace alias names, then suffix `` - (EX)`` on listed (replaced) names.

    Both lists are arguments (the staff directory is data, not code).
    """
    if col not in df.columns:
        return df
    out = map_values(c(col), aliases or {})
    return df.withColumn(col, suffix_if_in(out, suffix_names))


def map_owner(df: DataFrame, mapping, col: str = "Potential Owner") -> DataFrame:
    """Replace owner labels by addresses.

    ``mapping`` is a dict (a literal map) or a two-column DataFrame
    ``(label, address)``; a DataFrame map is left-joined and Spark/AQE picks
    broadcast only when its measured size is under the broadcast threshold.
    """
    if col not in df.columns or mapping is None:
        return df
    if isinstance(mapping, dict):
        return df.withColumn(col, map_values(c(col), mapping))
    label, addr = mapping.columns[:2]
    m = (mapping.select(F.col(label).alias("_owner_label"), F.col(addr).alias("_owner_addr"))
         .dropDuplicates(["_owner_label"]))
    cols = df.columns
    joined = df.join(m, c(col) == F.col("_owner_label"), "left")
    return joined.select(*[F.coalesce(F.col("_owner_addr"), c(n)).alias(n) if n == col else c(n)
                           for n in cols])


def coalesce_contact_mode(df: DataFrame, dsr_col: str = "Mode of Contact (DSR)",
                          col: str = "Mode of Contact") -> DataFrame:
    """The DSR value wins where present; else rename the DSR column."""
    if dsr_col in df.columns and col in df.columns:
        return df.withColumn(col, F.coalesce(c(dsr_col), c(col))).drop(dsr_col)
    if dsr_col in df.columns:
        return df.withColumnRenamed(dsr_col, col)
    return df


def backfill_new_stage(df: DataFrame, new: str = "New Stage",
                       orig: str = "Original Stage") -> DataFrame:
    """P10: null ``New Stage`` takes ``Original Stage``."""
    if new in df.columns and orig in df.columns:
        return df.withColumn(new, F.coalesce(c(new), c(orig)))
    return df


def add_constant(df: DataFrame, name: str = DSR_TYPE, value=DSR_TYPE_VALUE) -> DataFrame:
    """Constant column on every row."""
    return df.withColumn(name, F.lit(value))


def ensure_columns(df: DataFrame, cols, types: dict | None = None,
                   default_type: str = "string") -> DataFrame:
    """Create absent columns as typed nulls; existing values are kept."""
    types = types or {}
    missing = [n for n in cols if n not in df.columns]
    if not missing:
        return df
    return df.withColumns({n: F.lit(None).cast(types.get(n, default_type)) for n in missing})


# ---------------------------------------------------------------------- filters

def filter_min_date(df: DataFrame, min_date=DEFAULT_MIN_DATE,
                    created: str = "Created Date", modified: str = "Modified Date") -> DataFrame:
    """keep rows created or modified at/after ``min_date``.

    With one of the two columns present only that one is used; with neither the
    frame is unchanged.  Null compares false, so rows with no dates drop.
    """
    t = ntz_lit(min_date)
    has_c, has_m = created in df.columns, modified in df.columns
    if has_c and has_m:
        cond = (c(created) >= t) | (c(modified) >= t)
    elif has_c:
        cond = c(created) >= t
    elif has_m:
        cond = c(modified) >= t
    else:
        return df
    return df.filter(cond)   # null -> dropped, as NaT compares false


def filter_key_not_null(df: DataFrame, key: str = KEY) -> DataFrame:
    """drop rows without a key."""
    if key not in df.columns:
        return df
    return df.filter(c(key).isNotNull())


# ------------------------------------------------------------- composed cleaners

def clean_potentials(df: DataFrame, *, aliases=None, suffix_names=None, owner_map=None,
                     min_date=DEFAULT_MIN_DATE, date_formats=DAYFIRST_FORMATS) -> DataFrame:
    """Q1: P1 -> P2 -> P3 -> P5 -> P6 -> P7 -> P8 -> F1 on an opportunity snapshot."""
    df = drop_columns_if_present(df, P_DROP)
    df = rename_columns(df, P_RENAME)
    df = parse_dates_dayfirst(df, P_DATES, date_formats)
    df = map_stage(df, ["Stage"])
    df = map_category(df)
    df = canonical_executive(df, aliases, suffix_names)
    df = map_owner(df, owner_map)
    return filter_min_date(df, min_date)


def clean_activities(df: DataFrame, *, aliases=None, suffix_names=None, owner_map=None,
                     min_date=DEFAULT_MIN_DATE, date_formats=DAYFIRST_FORMATS) -> DataFrame:
    """Q2: P1 -> P2 -> F2 -> P3 -> P9 -> P5 -> P10 -> P7 -> P8 -> F1 -> P11 on an activity log.

    A raw ``Modified Date`` (not renamed for activities) is parsed too when
    present, so the date floor compares timestamps with timestamps.
    """
    df = drop_columns_if_present(df, DSR_DROP)
    df = rename_columns(df, DSR_RENAME)
    df = filter_key_not_null(df)
    df = parse_dates_dayfirst(df, DSR_DATES + ["Modified Date"], date_formats)
    df = coalesce_contact_mode(df)
    df = map_stage(df, ["Original Stage", "New Stage"])
    df = backfill_new_stage(df)
    df = canonical_executive(df, aliases, suffix_names)
    df = map_owner(df, owner_map)
    df = filter_min_date(df, min_date)
    return add_constant(df)
