"""Date/time column functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default day-first layout; one- or two-digit day, month and hour are accepted.
DAYFIRST_FORMAT = "d/M/yyyy H:mm"
# Layouts tried in turn where none is given: with minutes, with seconds, date only.
DAYFIRST_FORMATS = (DAYFIRST_FORMAT, "d/M/yyyy H:mm:ss", "d/M/yyyy")


def formats_for(name: str, formats) -> tuple:
    """The layouts of one column: ``formats`` is a sequence for all or column -> sequence."""
    if isinstance(formats, dict):
        return tuple(formats.get(name, DAYFIRST_FORMATS))
    return tuple(formats)


_FIELD = {"d": "day", "dd": "day", "M": "month", "MM": "month", "yyyy": "year", "H": "hour", "HH": "hour",
          "m": "minute", "mm": "minute", "s": "second", "ss": "second"}


def full_width(layout: str) -> tuple[str, dict] | None:
    """For layouts of numbers with separators: the pattern of a text whose numbers all have two
    digits (the year four), and the place and length of each number in it.  Else ``None``."""
    parts = re.findall(r"[A-Za-z]+|[^A-Za-z]+", layout)
    shape, places, at = "", {}, 1
    for i, part in enumerate(parts):
        if i % 2 == 0:
            name = _FIELD.get(part)
            if name is None or name in places:
                return None
            size = 4 if name == "year" else 2
            places[name] = (at, size)
            shape += f"[0-9]{{{size}}}"
        else:
            if not re.fullmatch(r"[-/.: ]+", part):
                return None
            size = len(part)
            shape += "".join(f"[{x}]" for x in part)
        at += size
    known = (["year", "month", "day"], ["year", "month", "day", "hour", "minute"],
             ["year", "month", "day", "hour", "minute", "second"])
    return (rf"\A{shape}\z", places) if len(parts) % 2 and sorted(places) in map(sorted, known) else None


def _parse_one(text: Column, layout: str) -> Column:
    """``text`` by one layout, or null.

    Full-width text is put into the order of a plain timestamp and cast: a fraction of the time of
    a pattern parser, which accepts the same days and times there.
    """
    parsed = F.when(F.try_to_timestamp(text, F.lit(layout)).isNotNull(), F.to_timestamp_ntz(text, F.lit(layout)))
    known = full_width(layout)
    if known is None:
        return parsed
    shape, places = known
    put = {name: text.substr(*place) for name, place in places.items()}
    iso = [put["year"], F.lit("-"), put["month"], F.lit("-"), put["day"]]
    for name, mark in (("hour", " "), ("minute", ":"), ("second", ":")):
        if name in put:
            iso += [F.lit(mark), put[name]]
    return F.when(text.rlike(shape), F.concat(*iso).try_cast("timestamp_ntz")).otherwise(parsed)


def parse_dayfirst(col: Column, formats=DAYFIRST_FORMATS) -> Column:
    """Parse text day-first; text that fits none of ``formats`` becomes null.

    Strict per format; several formats are tried in order with ``coalesce``.
    The result is a ``timestamp_ntz`` (source stamps carry no zone) produced by
    ``to_timestamp_ntz``, so no session time zone is involved (a wall-clock
    time inside a daylight-saving gap stays as written).  ``to_timestamp_ntz``
    raises on bad text under ANSI mode, so it only runs where the non-raising
    ``try_to_timestamp`` has accepted the text with the same format.

    The steps are a function over a one-value array: written out for each date column of a
    table they make generated code too long for the JVM to compile, and a text that is itself
    computed is computed once.  Texts with every number of a layout in full width, the most usual
    ones, do not reach the pattern parser (``full_width``).
    """
    def by_layout(text: Column) -> Column:
        parsed = [_parse_one(text, f) for f in formats]
        return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)

    return F.transform(F.array(col.cast("string")), by_layout)[0]


def format_date(col: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(col, fmt)


IST_OFFSET_MINUTES = 330  # +05:30, no daylight saving


def to_ist(utc_ts: Column) -> Column:
    """Wall-clock time at the fixed +05:30 offset of a UTC wall-clock stamp.

    A fixed-offset shift of a zone-less value, so the session time zone plays
    no part.
    """
    return F.timestamp_add("MINUTE", F.lit(IST_OFFSET_MINUTES), utc_ts.cast("timestamp_ntz"))


def ist_stamp(utc_ts: Column) -> Column:
    """``YYYY-mm-dd HH:MM:SS`` text of the +05:30 wall-clock time."""
    return F.date_format(to_ist(utc_ts), "yyyy-MM-dd HH:mm:ss")
