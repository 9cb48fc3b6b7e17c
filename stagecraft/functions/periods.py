"""Reporting periods ("criterion dates").

Every period is a closed range of whole days ``[start, end]``; rows match when
``start <= ts < end + 1 day`` (the same as ``<= end 23:59:59.999999``).  "Today"
is always an ``as_of`` argument or column, never ``current_date()``, so results
repeat.

Two forms are offered:

* column form (``period_start_col`` / ``period_end_col`` / ``period_label_col``)
  for computing periods of a date column on the cluster, and
* scalar form (``period_range``) that turns filter arguments into two literal
  bounds on the driver (no data involved).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_WEEK = "Last Week"
CURRENT_WEEK = "Current Week"
CURRENT_MONTH = "Current Month"
LAST_MONTH = "Last Month"
CURRENT_QUARTER = "Current Quarter"
CURRENT_FY = "Current FY"
TILL_DATE = "Till date"
CUSTOM = "Custom"

# The criterion choices, in picker order.
CRITERIA = [LAST_WEEK, CURRENT_WEEK, CURRENT_MONTH, LAST_MONTH, CURRENT_QUARTER,
            CURRENT_FY, TILL_DATE, CUSTOM]
# Periods that depend only on the as_of date.
CALENDAR_CRITERIA = CRITERIA[:6]

FY_START_MONTH = 4  # April


# ----------------------------------------------------------------- column form

def last_sunday_col(d: Column) -> Column:
    """Most recent Sunday on or before ``d`` (``d`` itself on a Sunday)."""
    d = F.to_date(d)
    return F.date_sub(d, F.dayofweek(d) - 1)


def _fy_start(d: Column) -> Column:
    return F.add_months(F.trunc(F.add_months(d, -(FY_START_MONTH - 1)), "YEAR"),
                        FY_START_MONTH - 1)


def period_start_col(criterion: str, as_of: Column) -> Column:
    d = F.to_date(as_of)
    if criterion == LAST_WEEK:
        return F.date_sub(last_sunday_col(d), 7)
    if criterion == CURRENT_WEEK:
        return last_sunday_col(d)
    if criterion == CURRENT_MONTH:
        return F.trunc(d, "MM")
    if criterion == LAST_MONTH:
        return F.trunc(F.add_months(d, -1), "MM")
    if criterion == CURRENT_QUARTER:
        return F.trunc(d, "quarter")
    if criterion == CURRENT_FY:
        return _fy_start(d)
    return F.lit(None).cast("date")


def period_end_col(criterion: str, as_of: Column) -> Column:
    """Last day (inclusive) of the period."""
    d = F.to_date(as_of)
    if criterion == LAST_WEEK:
        return last_sunday_col(d)
    if criterion == CURRENT_WEEK:
        return F.date_add(last_sunday_col(d), 7)
    if criterion == CURRENT_MONTH:
        return F.last_day(d)
    if criterion == LAST_MONTH:
        return F.date_sub(F.trunc(d, "MM"), 1)
    if criterion == CURRENT_QUARTER:
        return F.date_sub(F.add_months(F.trunc(d, "quarter"), 3), 1)
    if criterion == CURRENT_FY:
        return F.date_sub(F.add_months(_fy_start(d), 12), 1)
    return F.lit(None).cast("date")


def period_label_col(criterion: str, as_of: Column, start=None, end=None) -> Column:
    """Label of a period; ``Custom`` shows its own ``start`` and ``end`` dates."""
    ymd = "yyyy-MM-dd"
    if criterion == CUSTOM and isinstance(start, Column):  # a period of its own for every row
        return F.concat(F.lit("From: "), F.date_format(start, ymd), F.lit(" To: "), F.date_format(end, ymd))
    if criterion == CUSTOM:
        s, e = period_days(criterion, start=start, end=end)
        return F.lit(f"From: {s.isoformat()} To: {e.isoformat()}")
    d = F.to_date(as_of)
    s, e = period_start_col(criterion, d), period_end_col(criterion, d)
    if criterion in (LAST_WEEK, CURRENT_WEEK):
        return F.concat(F.lit(criterion + ": "), F.date_format(s, ymd), F.lit(" to "),
                        F.date_format(e, ymd))
    if criterion in (CURRENT_MONTH, LAST_MONTH):
        return F.concat(F.lit(criterion + ": "), F.date_format(s, "MMMM yyyy"))
    if criterion == CURRENT_QUARTER:
        return F.concat(F.lit("Current Quarter: Q"), F.quarter(d).cast("string"),
                        F.lit(" ("), F.date_format(s, "MMMM"), F.lit(" - "),
                        F.date_format(F.add_months(s, 2), "MMMM"), F.lit(") "),
                        F.year(d).cast("string"))
    if criterion == CURRENT_FY:
        return F.concat(F.lit("Current Financial Year: "), F.year(s).cast("string"),
                        F.lit("-"), (F.year(s) + 1).cast("string"))
    return F.lit("All Data")


# ----------------------------------------------------------------- scalar form

def _as_date(x) -> _dt.date:
    if isinstance(x, _dt.datetime):
        return x.date()
    if isinstance(x, _dt.date):
        return x
    return _dt.date.fromisoformat(str(x))


def _last_sunday(d: _dt.date) -> _dt.date:
    return d - _dt.timedelta(days=(d.weekday() + 1) % 7)


def _month_start(y: int, m: int) -> _dt.date:
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    return _dt.date(y, m, 1)


def period_days(criterion: str, as_of=None, start=None, end=None):
    """``(first_day, last_day)`` of a period, or ``(None, None)`` for no bounds.

    ``Custom`` takes ``start``/``end`` and raises ``ValueError`` when
    ``start > end``; ``Till date`` and unknown criteria have no bounds.
    """
    if criterion == CUSTOM:
        s, e = _as_date(start), _as_date(end)
        if s > e:
            raise ValueError("Start Date must be before or equal to End Date.")
        return s, e
    if criterion not in CALENDAR_CRITERIA:
        return None, None
    d = _as_date(as_of)
    if criterion == LAST_WEEK:
        ls = _last_sunday(d)
        return ls - _dt.timedelta(days=7), ls
    if criterion == CURRENT_WEEK:
        ls = _last_sunday(d)
        return ls, ls + _dt.timedelta(days=7)
    if criterion == CURRENT_MONTH:
        s = _dt.date(d.year, d.month, 1)
        return s, _month_start(d.year, d.month + 1) - _dt.timedelta(days=1)
    if criterion == LAST_MONTH:
        e = _dt.date(d.year, d.month, 1) - _dt.timedelta(days=1)
        return _dt.date(e.year, e.month, 1), e
    if criterion == CURRENT_QUARTER:
        m = 3 * ((d.month - 1) // 3) + 1
        return _dt.date(d.year, m, 1), _month_start(d.year, m + 3) - _dt.timedelta(days=1)
    # CURRENT_FY
    y = d.year if d.month >= FY_START_MONTH else d.year - 1
    return _dt.date(y, FY_START_MONTH, 1), _dt.date(y + 1, FY_START_MONTH, 1) - _dt.timedelta(days=1)


def period_range(criterion: str, as_of=None, start=None, end=None):
    """Half-open timestamp bounds ``[start 00:00, end + 1 day 00:00)`` or Nones."""
    s, e = period_days(criterion, as_of, start, end)
    if s is None:
        return None, None
    return (_dt.datetime.combine(s, _dt.time.min),
            _dt.datetime.combine(e + _dt.timedelta(days=1), _dt.time.min))


def in_range(col: Column, lo: _dt.datetime, hi_excl: _dt.datetime) -> Column:
    """``lo <= col < hi_excl`` with literal NTZ bounds (null col -> null).

    Bounds go through text so no session time zone is involved.
    """
    return (col >= ntz_lit(lo)) & (col < ntz_lit(hi_excl))


def ntz_lit(ts) -> Column:
    """A ``timestamp_ntz`` literal for a wall-clock datetime/date/ISO text."""
    if isinstance(ts, _dt.datetime):
        text = ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    elif isinstance(ts, _dt.date):
        text = ts.isoformat() + " 00:00:00"
    else:
        text = str(ts)
    return F.lit(text).cast("timestamp_ntz")
