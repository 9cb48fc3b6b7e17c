"""Row filters of the reporting layer.

Each filter is a predicate over columns; a chain of them is one ``Filter``
node after Catalyst's ``CombineFilters``, pushed into the Parquet scan where
the predicate allows it.  "Today" is the ``as_of`` argument.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import DSR_TYPE, KEY, SRL_DATE_COLUMNS, c, present
from ..functions.periods import TILL_DATE, in_range, period_range
from ..functions.text import is_blank, non_blank

ALL = "All"


def filter_in_keys_blank_report(df: DataFrame, keys: DataFrame, key: str = KEY,
                                report_col: str = "Report ID") -> DataFrame:
    """Rows whose key is in ``keys`` (semi-join) and whose report id is blank.

    An absent report column counts as null (blank).
    """
    kcol = keys.columns[0]
    k = keys.select(F.col(f"`{kcol}`").alias("_sk"))
    out = df.join(k, c(key) == F.col("_sk"), "left_semi")
    if report_col in df.columns:
        out = out.filter(is_blank(c(report_col)))
    return out


def filter_is_activity(df: DataFrame) -> DataFrame:
    """activity rows (``DSR Type`` set)."""
    if DSR_TYPE not in df.columns:
        return df.filter(F.lit(False))
    return df.filter(c(DSR_TYPE).isNotNull())


def filter_is_main(df: DataFrame) -> DataFrame:
    """main rows (``DSR Type`` null or absent)."""
    if DSR_TYPE not in df.columns:
        return df
    return df.filter(c(DSR_TYPE).isNull())


def filter_attributes(df: DataFrame, executive: str = ALL, region: str = ALL,
                      code: str = ALL) -> DataFrame:
    """equality on Executive / Region / Potential Code; ``'All'`` disables one."""
    for col, val in (("Executive", executive), ("Region", region), ("Potential Code", code)):
        if val != ALL and val is not None:
            df = df.filter(c(col) == F.lit(val))
    return df


def filter_role(df: DataFrame, user: str, selected_executive: str = ALL,
                team: dict | None = None, restricted=()) -> DataFrame:
    """row-level security for one user.

    ``team`` maps a lead to the executives they may see; a lead's pick inside
    the list narrows to it, a pick outside falls back to the lead's own rows.
    A ``restricted`` user sees only their own rows.  Everyone else may pick any
    executive or ``'All'``.
    """
    team = team or {}
    ex = c("Executive")
    if user in team:
        allowed = list(team[user])
        if selected_executive != ALL:
            who = selected_executive if selected_executive in allowed else user
            return df.filter(ex == F.lit(who))
        return df.filter(ex.isin(allowed))
    if user in set(restricted):
        return df.filter(ex == F.lit(user))
    if selected_executive != ALL:
        return df.filter(ex == F.lit(selected_executive))
    return df


ROLE_SALTS = 32


def filter_role_batch(df: DataFrame, policy: DataFrame, salts: int = ROLE_SALTS) -> DataFrame:
    """F6 batch form: ``policy(user, executive)`` -> every user's visible rows,
    tagged with ``user``.

    An equi-join on Executive and a salt: there are few executives, so each one's rows
    are dealt over ``salts`` parts by a hash of the row's key, and the policy is repeated
    for each part.  The policy is not assumed broadcastable (the planner decides from its
    measured size).
    """
    p = (policy.select(F.col("user").alias("user"), F.col("executive").alias("_pe"))
         .withColumn("_ps", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    salt = F.pmod(F.xxhash64(*[c(n) for n in present(df, [KEY, "Modified Date", "Created Date"])]), F.lit(salts))
    rows = df.withColumn("_rs", salt.cast("int"))
    return (rows.join(p, (c("Executive") == F.col("_pe")) & (F.col("_rs") == F.col("_ps")))
            .drop("_pe", "_ps", "_rs"))


def filter_forced_region(df: DataFrame, user: str, forced: dict | None = None,
                         selected_region: str = ALL) -> DataFrame:
    """users pinned to one region see only it; others use their pick."""
    region = (forced or {}).get(user, selected_region)
    return filter_attributes(df, region=region)


def any_date_in_range(df: DataFrame, lo, hi_excl, cols=SRL_DATE_COLUMNS) -> Column:
    """OR of range tests; a null date makes its test null, which a filter treats
    as false, so the plain OR (pushable to the Parquet scan) is exact."""
    cols = present(df, cols)
    if not cols:
        return F.lit(False)
    return reduce(or_, [in_range(c(n), lo, hi_excl) for n in cols])


def filter_any_date_in_range(df: DataFrame, lo, hi_excl, cols=SRL_DATE_COLUMNS) -> DataFrame:
    """F8: keep rows where any present date column lies in ``[lo, hi_excl)``."""
    if lo is None or hi_excl is None:
        return df
    return df.filter(any_date_in_range(df, lo, hi_excl, cols))


_REPORT_COLUMNS = {
    "Follow-up": ("Last Contact Date", "CS Contacted On Date"),
    "Planned": ("Next Followup Date", "CS Follow-up On Date"),
    "Closure": ("Closing Date", "CS Closure Date"),
}


def _report_in_range_or_present(df: DataFrame, pair, lo, hi_excl) -> DataFrame:
    if lo is not None and hi_excl is not None:
        return df.filter(any_date_in_range(df, lo, hi_excl, pair))
    cols = present(df, pair)
    if not cols:
        return df.filter(F.lit(False))
    return df.filter(reduce(or_, [c(n).isNotNull() for n in cols]))


def report_followup(df: DataFrame, lo=None, hi_excl=None) -> DataFrame:
    """contacted (last contact or CS contacted) in range, or at all without a range."""
    return _report_in_range_or_present(df, _REPORT_COLUMNS["Follow-up"], lo, hi_excl)


def report_pending(df: DataFrame, lo=None, hi_excl=None) -> DataFrame:
    """never contacted (both contact columns null); the range is not used."""
    cols = present(df, ("Last Contact Date", "CS Contacted On Date"))
    if not cols:
        return df
    return df.filter(reduce(lambda a, b: a & b, [c(n).isNull() for n in cols]))


def report_planned(df: DataFrame, lo=None, hi_excl=None) -> DataFrame:
    """follow-up planned (next follow-up or CS follow-up) in range / at all."""
    return _report_in_range_or_present(df, _REPORT_COLUMNS["Planned"], lo, hi_excl)


def report_closure(df: DataFrame, lo=None, hi_excl=None) -> DataFrame:
    """closing (closing or CS closure date) in range / at all."""
    return _report_in_range_or_present(df, _REPORT_COLUMNS["Closure"], lo, hi_excl)


REPORTS = {"Follow-up": report_followup, "Pending": report_pending,
           "Planned": report_planned, "Closure": report_closure}


def filter_report_chain(df: DataFrame, *, user: str | None = None, team=None, restricted=(),
                        forced_regions=None, executive: str = ALL, region: str = ALL,
                        code: str = ALL, criterion: str = TILL_DATE, as_of=None,
                        start=None, end=None, report: str = ALL):
    """role -> executive/region/code -> any date in period -> report.

    Returns ``(frame, lo, hi_excl)``; the bounds are ``None`` without a period.
    """
    if user is not None:
        df = filter_role(df, user, executive, team, restricted)
        region = (forced_regions or {}).get(user, region)
    elif executive != ALL:
        df = filter_attributes(df, executive=executive)
    df = filter_attributes(df, region=region, code=code)
    lo, hi = period_range(criterion, as_of, start, end)
    df = filter_any_date_in_range(df, lo, hi)
    if report != ALL:
        df = REPORTS[report](df, lo, hi)
    return df, lo, hi


def filter_non_blank(df: DataFrame, col: str) -> DataFrame:
    """F16: ``col IS NOT NULL AND TRIM(col) <> ''``."""
    return df.filter(non_blank(c(col)))
