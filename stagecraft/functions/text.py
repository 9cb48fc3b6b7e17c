"""String-valued column functions (all JVM-side expressions, no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Largest INT: the "no leading number" sort position of a stage (sorts last).
NO_STAGE_NUMBER = 2147483647


def map_values(col: Column, mapping: dict) -> Column:
    """Whole-value replacement; unmatched values (and nulls) are kept.

    The mapping becomes one literal map, so the lookup is a single hash probe
    inside generated code.  Mapping outputs are never re-mapped.
    """
    if not mapping:
        return col
    lit_map = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.coalesce(F.try_element_at(lit_map, col), col)


def stage_number(col: Column) -> Column:
    """Leading integer of a stage label; null when there is none."""
    digits = F.regexp_extract(col, r"^([0-9]+)", 1)
    return F.when(digits != "", digits.try_cast("int"))


def stage_sort_number(col: Column) -> Column:
    """``stage_number`` with "no number" (and null) mapped to +inf (INT max)."""
    return F.coalesce(stage_number(col), F.lit(NO_STAGE_NUMBER))


def digits_only(col: Column, max_len: int | None = None, fallback: str = "Sheet1") -> Column:
    """Keep the digits of a key; empty becomes ``fallback``.

    ``max_len`` cuts the result, as a workbook's sheet names need it (31); table files
    need no cut, which would join keys that differ after it.

    ``(?U)`` makes ``\\D`` Unicode-aware like Python's ``re``.
    """
    d = F.regexp_replace(col.cast("string"), r"(?U)\D+", "")
    if max_len is not None:
        d = F.substring(d, 1, max_len)
    return F.when(d == "", F.lit(fallback)).otherwise(d)


def is_blank(col: Column) -> Column:
    """Null or only spaces (SQL ``TRIM`` strips spaces only)."""
    return col.isNull() | (F.trim(col) == "")


def non_blank(col: Column) -> Column:
    """``x IS NOT NULL AND TRIM(x) <> ''`` (null rows drop)."""
    return col.isNotNull() & (F.trim(col) != "")


def suffix_if_in(col: Column, names, suffix: str = " - (EX)") -> Column:
    """Append ``suffix`` when the value is one of ``names``; null stays null."""
    names = list(names or [])
    if not names:
        return col
    return F.when(col.isin(names), F.concat(col, F.lit(suffix))).otherwise(col)
