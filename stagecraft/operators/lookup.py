"""Lookups over the merged table.

The reference answers these for one key at a time (one SQL query per row in
places).  Each is written here for a *set* of keys at once -- a semi-join
with a key frame, or all keys -- so a batch of lookups is one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..columns import (DETAIL_DATE_COLUMNS, DETAIL_GROUPS, DETAIL_READ_COLUMNS,
                       DRILL_COLUMNS, DRILL_DATE_COLUMNS, DRILL_HIDDEN, HISTORY_COLUMNS,
                       HISTORY_READ_COLUMNS, KEY, c, present)
from ..functions.text import non_blank
from .filters import filter_in_keys_blank_report, filter_is_activity, filter_is_main
from .ranking import dedupe_latest
from .sequences import number_rows
from .status import busy_keys


def _restrict(df: DataFrame, keys: DataFrame | None, key: str = KEY) -> DataFrame:
    if keys is None:
        return df
    kcol = keys.columns[0]
    return df.join(keys.select(F.col(f"`{kcol}`").alias("_lk")), c(key) == F.col("_lk"),
                   "left_semi")


def to_date_columns(df: DataFrame, cols) -> DataFrame:
    """P13 on each present column."""
    todo = present(df, cols)
    return df.withColumns({n: F.to_date(c(n)) for n in todo}) if todo else df


def latest_details(modified: DataFrame, keys: DataFrame | None = None, key: str = KEY,
                   tiebreak=()) -> DataFrame:
    """Newest main row per key by ``Modified Date`` (all keys, or ``keys``)."""
    main = filter_is_main(_restrict(modified, keys, key))
    main = main.select(*[c(n) for n in present(main, DETAIL_READ_COLUMNS + list(tiebreak))])
    return dedupe_latest(main, key, "Modified Date", tiebreak)


def potential_details(modified: DataFrame, keys: DataFrame | None = None, key: str = KEY,
                      tiebreak=(), grouped: bool = False) -> DataFrame:
    """The 19 display fields of the latest main row, dates as dates.

    The key is kept so a batch of lookups stays addressable.  ``grouped``
    folds the fields into the seven display groups as struct columns.
    """
    d = latest_details(modified, keys, key, tiebreak)
    fields = [n for _, grp in DETAIL_GROUPS for n in grp]
    d = to_date_columns(d.select(c(key), *[c(n) for n in present(d, fields)]), DETAIL_DATE_COLUMNS)
    if not grouped:
        return d
    return d.select(c(key), *[F.struct(*[c(n) for n in present(d, grp)]).alias(g)
                              for g, grp in DETAIL_GROUPS if present(d, grp)])


def stage_history(modified: DataFrame, keys: DataFrame | None = None, key: str = KEY,
                  tiebreak=(), ordered: bool = True) -> DataFrame:
    """Q10: activity rows of each key -- Created Date, Original/New Stage,
    Closing Date, Description -- ordered by key, then Created Date (nulls last).

    The order is a global sort (range-partitioned), so a key with a huge
    history is split over several tasks rather than sorted in one.
    """
    act = filter_is_activity(_restrict(modified, keys, key))
    act = act.select(*[c(n) for n in present(act, HISTORY_READ_COLUMNS + list(tiebreak))])
    if "Description (Potential Details)" in act.columns:
        act = act.withColumnRenamed("Description (Potential Details)", "Description")
    out_cols = [c(key)] + [c(n) for n in present(act, HISTORY_COLUMNS)]
    order = [c(key).asc_nulls_last()]
    if "Created Date" in act.columns:
        order.append(c("Created Date").asc_nulls_last())
    order += [c(n).asc_nulls_last() for n in present(act, tiebreak)]
    return (act.orderBy(*order) if ordered else act).select(*out_cols)


def history_for_export(modified: DataFrame, keys: DataFrame | None = None, key: str = KEY,
                       tiebreak=()) -> DataFrame:
    """History with Created / Closing Date reduced to dates (export form).

    Unsorted: the export writer range-partitions and sorts it anyway, so a
    second global sort (and its sampling pass) would be wasted.
    """
    return to_date_columns(stage_history(modified, keys, key, tiebreak, ordered=False),
                           ["Created Date", "Closing Date"])


def bookmark_flag(df: DataFrame, bookmarks: DataFrame, user: str, key: str = KEY) -> DataFrame:
    """``BM`` = the key (as text) is bookmarked by ``user``.

    One left join against the user's distinct bookmarked keys (the reference
    issues one query per row).
    """
    bm = (bookmarks.filter(F.col("user") == F.lit(user))
          .select(F.col("potential_no").cast("string").alias("_bk")).distinct()
          .withColumn("_bm", F.lit(True)))
    j = df.join(bm, c(key).cast("string") == F.col("_bk"), "left")
    return j.withColumn("BM", F.col("_bm").isNotNull()).drop("_bk", "_bm")


def drill_down_details(modified: DataFrame, keys: DataFrame, bookmarks: DataFrame | None,
                       user: str | None, key: str = KEY, tiebreak=()) -> DataFrame:
    """Q8: drilled keys -> blank-report rows of the merged table -> latest per key
    -> hide columns -> dates as dates -> ``BM`` flag; key and BM first.
    """
    rows = filter_in_keys_blank_report(modified, keys, key)
    rows = rows.select(*[c(n) for n in present(rows, DRILL_COLUMNS + list(tiebreak))])
    rows = dedupe_latest(rows, key, "Modified Date", tiebreak)
    rows = rows.drop(*present(rows, ["Report ID"] + DRILL_HIDDEN + list(tiebreak)))
    rows = to_date_columns(rows, DRILL_DATE_COLUMNS)
    if bookmarks is not None and user is not None:
        rows = bookmark_flag(rows, bookmarks, user, key)
        first = [key, "BM"]
    else:
        first = [key]
    return rows.select(*[c(n) for n in first + [x for x in rows.columns if x not in first]])


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A10: sorted distinct non-null values of a column (picker lists)."""
    return df.select(c(col)).filter(c(col).isNotNull()).distinct().orderBy(c(col))


def facet(df: DataFrame, target: str, filters: dict | None = None) -> DataFrame:
    """Distinct non-blank ``target`` values under equality ``filters``, sorted."""
    for col, val in (filters or {}).items():
        df = df.filter(c(col) == F.lit(val))
    return df.select(c(target)).filter(non_blank(c(target))).distinct().orderBy(c(target))


def facet_cascade(df: DataFrame, state=None, company=None, code=None) -> dict[str, DataFrame]:
    """A11 chain: State -> Company (by state) -> Code (by company only) ->
    Potential No. (by company and code)."""
    out = {"State/UT": facet(df, "State/UT")}
    if state is not None:
        out["Company Name"] = facet(df, "Company Name", {"State/UT": state})
    if company is not None:
        out["Potential Code"] = facet(df, "Potential Code", {"Company Name": company})
        if code is not None:
            out[KEY] = facet(df, KEY, {"Company Name": company, "Potential Code": code})
    return out


def facets_at_once(df: DataFrame, state=None, company=None, code=None,
                   pickers=("Region", "Executive", "Potential Code")) -> DataFrame:
    """A10 and A11 in one aggregate: (facet, value) of every list and picker.

    The four lists of ``facet_cascade`` (named ``State/UT``, ``Company Name``, ``Potential
    Code`` and the key) and the pickers (named ``pick `` and their column) are grouping sets
    of one pass, each over its column where the picks before it hold.
    """
    def held(name, **picks):
        keep = non_blank(c(name))
        for col, value in picks.values():
            keep = keep & (c(col) == F.lit(value))
        return F.when(keep, c(name))

    lists = {"State/UT": held("State/UT")}
    if state is not None:
        lists["Company Name"] = held("Company Name", s=("State/UT", state))
    if company is not None:
        lists["Potential Code"] = held("Potential Code", o=("Company Name", company))
        if code is not None:
            lists[KEY] = held(KEY, o=("Company Name", company), p=("Potential Code", code))
    lists |= {f"pick {n}": c(n) for n in present(df, pickers)}
    names = [f"_f{i}" for i in range(len(lists))]
    flat = df.select(*[col.cast("string").alias(n) for n, col in zip(names, lists.values())])
    sets = flat.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(
        *[F.grouping(n).alias(f"_g{n}") for n in names])
    mine = [(F.col(f"_g{n}") == 0, F.lit(title), F.col(n)) for n, title in zip(names, lists)]
    facet_name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for is_set, title, col in mine:
        facet_name, value = F.when(is_set, title).otherwise(facet_name), F.when(is_set, col).otherwise(value)
    return sets.select(facet_name.alias("facet"), value.alias("value")).where("value is not null")


def numbered_history(modified: DataFrame, keys: DataFrame | None = None, key: str = KEY,
                     tiebreak=(), out: str = "No.") -> DataFrame:
    """Q10 with P15: each key's activities numbered from 1 in the order of ``stage_history``.

    Keys that one task can hold (``busy_keys``: a job) are numbered in a window by key; only the
    rows of busy ones go through the blocks of ``number_rows``.
    """
    act = filter_is_activity(_restrict(modified, keys, key))
    order = [c(n).asc_nulls_last() for n in present(act, ["Created Date", *tiebreak])]
    act = act.select(*[c(n) for n in present(act, HISTORY_READ_COLUMNS + list(tiebreak))], c(key).alias("_key"))
    act = act.filter(F.col("_key").isNotNull())
    busy = busy_keys(act, "_key")
    calm = act.filter(~F.col("_key").isin(busy)) if busy else act
    numbered = calm.withColumn(out, F.row_number().over(Window.partitionBy("_key").orderBy(*order)).cast("bigint"))
    if busy:
        rest = number_rows(act.filter(F.col("_key").isin(busy)), order, out, ["_key"])
        numbered = numbered.unionByName(rest.select(*[c(n) for n in numbered.columns]))
    act = numbered
    if "Description (Potential Details)" in act.columns:
        act = act.withColumnRenamed("Description (Potential Details)", "Description")
    return act.select(c(key), c(out), *[c(n) for n in present(act, HISTORY_COLUMNS)])


def find_potential(srl: DataFrame, modified: DataFrame, state: str | None = None,
                   company: str | None = None, code: str | None = None, key: str = KEY,
                   tiebreak=(), history_tiebreak=()) -> tuple[DataFrame, DataFrame]:
    """Q11: potentials matching the facet picks -> (details, history), batch form.

    A state only narrows the list of companies to pick from (``facet_cascade``); with a
    company picked, its potentials in every state match.
    """
    sel = srl
    picks = [("Company Name", company), ("Potential Code", code)]
    if company is None:
        picks.append(("State/UT", state))
    for col, val in picks:
        if val is not None:
            sel = sel.filter(c(col) == F.lit(val))
    keys = sel.select(c(key).alias("_fk")).filter(non_blank(F.col("_fk"))).distinct()
    return (potential_details(modified, keys, key, tiebreak),
            stage_history(modified, keys, key, history_tiebreak))


def bookmarked_history(state: DataFrame, modified: DataFrame, key: str = KEY) -> DataFrame:
    """The stage history of every user's bookmarked potentials, dates as dates."""
    marks = state.select("user", F.col("potential_no").cast("string").alias("_bk")).distinct()
    hist = to_date_columns(stage_history(modified, None, key, ordered=False),
                           ["Created Date", "Closing Date"])
    return marks.join(hist, F.col("_bk") == c(key)).drop("_bk")


def bookmarked_details(state: DataFrame, modified: DataFrame, key: str = KEY,
                       tiebreak=()) -> DataFrame:
    """Each user's bookmarks with the first bookmark time and the latest details.

    ``state`` is the live bookmark table (``bookmark_state``); every user is
    answered at once.
    """
    first = (state.groupBy("user", "potential_no")
             .agg(F.min(F.struct("timestamp", "seq")).alias("_f"))
             .select("user", "potential_no", F.col("_f.timestamp").alias("bookmarked_at")))
    det = potential_details(modified, None, key, tiebreak)
    return first.join(det, first.potential_no == det[f"`{key}`"], "left").drop(det[f"`{key}`"])
