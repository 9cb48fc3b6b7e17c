"""P3 with one layout per column, chosen from the column's first text in load order.

The reference reads a date column by the layout its first non-null value shows, day first
where that is possible, and nulls every value of another layout.  Here one aggregate finds the
first text of every column (``min_by`` over the load order, combined in the map tasks), and
string functions name its layout:

* ``15/03/2024`` (also with ``.`` or ``-``) is day first if its second number can be a month,
  month first (``04/13/2024``) else;
* ``2024-03-04`` is year, day, month if its last number can be a month (day first holds there
  as well), year, month, day (``2024-03-15``) else;
* behind the date nothing, ``H:mm`` or ``H:mm:ss`` after a blank or a ``T``, or ``h:mm a``.

A column without a text, or whose first text shows none of these, has a null layout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import c, present
from ..functions.dates import DAYFIRST_FORMATS, parse_dayfirst

_DAY_FIRST = r"^(\d{1,2})([/.-])(\d{1,2})([/.-])(\d{4})(.*)$"
_YEAR_FIRST = r"^(\d{4})([/.-])(\d{1,2})([/.-])(\d{1,2})(.*)$"


def _time_layout(rest: Column) -> Column:
    mark = F.when(rest.startswith("T"), F.lit("'T'")).otherwise(F.lit(" "))
    return (F.when(rest == "", F.lit(""))
            .when(rest.rlike(r"^[ T]\d{1,2}:\d{2}$"), F.concat(mark, F.lit("H:mm")))
            .when(rest.rlike(r"^[ T]\d{1,2}:\d{2}:\d{2}$"), F.concat(mark, F.lit("H:mm:ss")))
            .when(rest.rlike(r"^ \d{1,2}:\d{2} [AP]M$"), F.lit(" h:mm a")))


def layout_of(text: Column) -> Column:
    """The layout a text shows, day first where it can be; null if it shows none."""
    def part(pattern, i):
        return F.regexp_extract(text, pattern, i)

    def number(pattern, i):
        return part(pattern, i).try_cast("int")

    def ordered(pattern, first, second, names):
        """Layout with ``names`` for the day-month pair, whose days and months must be possible."""
        day, month = number(pattern, first), number(pattern, second)
        straight, turned = names
        return (F.when(day.between(1, 31) & month.between(1, 12), F.lit(straight))
                .when(month.between(1, 31) & day.between(1, 12), F.lit(turned)))

    def layout(pattern, shape):
        mark = part(pattern, 2)
        date = F.replace(shape, F.lit("-"), mark)
        return F.when(mark == part(pattern, 4), F.concat(date, _time_layout(part(pattern, 6))))

    short = ordered(_DAY_FIRST, 1, 3, ("d-M-yyyy", "M-d-yyyy"))
    year = ordered(_YEAR_FIRST, 3, 5, ("yyyy-d-M", "yyyy-M-d"))
    return (F.when(text.rlike(_DAY_FIRST), layout(_DAY_FIRST, short))
            .when(text.rlike(_YEAR_FIRST), layout(_YEAR_FIRST, year)))


def infer_layouts(df: DataFrame, cols, load_order=("_seq",)) -> DataFrame:
    """(column, first_text, layout): one row for each listed text column, in one aggregate."""
    todo = present(df, cols)
    order = F.struct(*[c(n) for n in load_order])
    firsts = [F.min_by(F.trim(c(n)), F.when(c(n).isNotNull(), order)).alias(f"t{i}") for i, n in enumerate(todo)]
    if not todo:
        return df.sparkSession.createDataFrame([], "`column` string, first_text string, layout string")
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"t{i}").alias("first_text"))
                     for i, n in enumerate(todo)])
    return df.agg(*firsts).select(F.inline(rows)).withColumn("layout", layout_of(F.col("first_text")))


def inferred_formats(df: DataFrame, cols, load_order=("_seq",), default=DAYFIRST_FORMATS) -> dict[str, tuple]:
    """column -> layouts for ``parse_dates_dayfirst``: the inferred one, else ``default``.

    Runs the aggregate; one short row for each column comes back, so that the layouts are
    literals of the plans that parse.
    """
    return {r["column"]: (r["layout"],) if r["layout"] else tuple(default)
            for r in infer_layouts(df, cols, load_order).collect()}


def layout_report(df: DataFrame, cols, load_order=("_seq",)) -> DataFrame:
    """(column, first_text, layout, parsed, refused): texts that fit their column's layout or not."""
    layouts = infer_layouts(df, cols, load_order)
    known = {r["column"]: r["layout"] for r in layouts.collect()}
    counts = []
    for i, (n, layout) in enumerate(known.items()):
        fits = parse_dayfirst(F.trim(c(n)), (layout,)).isNotNull() if layout else F.lit(False)
        counts += [F.count(F.when(c(n).isNotNull() & fits, True)).alias(f"p{i}"),
                   F.count(F.when(c(n).isNotNull() & ~fits, True)).alias(f"r{i}")]
    if not known:
        return layouts.selectExpr("*", "0L as parsed", "0L as refused")
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"p{i}").alias("parsed"), F.col(f"r{i}").alias("refused"))
                     for i, n in enumerate(known)])
    return layouts.join(df.agg(*counts).select(F.inline(rows)), "column")
