"""Previous / current status of every opportunity.

The reference walks the status table row by row and looks up two groups per
row.  Here the same rule is a handful of per-key aggregates joined back to the
status table once:

* activity side (``D``): one map-side-combined aggregate per (key, contact
  day) holding the day's row count and its latest row by contact time, plus a
  top-2-by-creation pick per (key, day) (``WindowGroupLimit`` partial before
  the shuffle).  Only these day summaries meet the status table, so a hot key
  shuffles one row per day, not its raw rows.
* main side (``M``): per-key row count plus top-2 by ``Modified Date``.

Everything is keyed on the potential number, so the final joins are equi-joins
on one key; AQE splits a skewed partition if one appears.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..columns import (DSR_TYPE, FLAG, KEY, SRL_COLUMNS, STATUS_COLUMNS,
                       STATUS_DATE_COLUMNS, c, present)
from ..functions.dates import DAYFIRST_FORMATS
from .clean import parse_text_dates
from .ranking import top_k_per_key

_K = "_k"

# Fields copied from an activity row / a main row / the status row itself.
_D_FIELDS = {"new": "New Stage", "orig": "Original Stage", "contacted": "Contacted Date",
             "followup": "Next Followup Date", "closing": "Closing Date"}
_M_FIELDS = {"stage": "Stage", "contacted": "Last Contact Date",
             "followup": "Next Followup Date", "closing": "Closing Date"}
_TYPES = {"new": "string", "orig": "string", "stage": "string", "contacted": "timestamp_ntz",
          "followup": "timestamp_ntz", "closing": "timestamp_ntz"}


def _field(df: DataFrame, src: str, alias: str) -> Column:
    if src in df.columns:
        return c(src).cast(_TYPES[alias]).alias(alias)
    return F.lit(None).cast(_TYPES[alias]).alias(alias)


def _payload(df: DataFrame, fields: dict) -> Column:
    return F.struct(*[_field(df, src, a) for a, src in fields.items()])


def _tb(df: DataFrame, tiebreak) -> list[Column]:
    return [c(n).alias(f"_tb{i}") for i, n in enumerate(present(df, tiebreak))]


def _pivot_top2(ranked: DataFrame, keys, rank_col: str = "_rn") -> DataFrame:
    """Rows ranked 1..2 per key -> one row per key with ``_p1`` / ``_p2`` structs."""
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col(rank_col) == 1, F.col("_p"))).alias("_p1"),
        F.max(F.when(F.col(rank_col) == 2, F.col("_p"))).alias("_p2"))


BUSY_ROWS = 50_000  # rows of a key that one task may take as they are


def busy_keys(dsr: DataFrame, key: str = KEY, most: int | None = None) -> list:
    """The keys with more than ``most`` rows (at most rows / ``most`` of them).  Runs a job."""
    most = BUSY_ROWS if most is None else most
    counts = dsr.filter(c(key).isNotNull()).groupBy(c(key).alias(_K)).agg(F.count(F.lit(1)).alias("_n"))
    return [r[_K] for r in counts.filter(F.col("_n") > most).select(_K).collect()]


def crowded_key(*tables: DataFrame, key: str = KEY, most: int | None = None) -> bool:
    """Whether any key, null included, has more than ``most`` rows in one of the tables.  Runs a job."""
    most = BUSY_ROWS if most is None else most
    counts = [t.groupBy(c(key).alias(_K)).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).select(_K)
              for t in tables]
    return bool(reduce(DataFrame.unionAll, counts).head(1))


def activity_day_summary(dsr: DataFrame, key: str = KEY, tiebreak=(), busy: list | None = None) -> DataFrame:
    """Per (key, contact day): row count, latest row by full contact time (J5
    input) and the two newest rows by creation time (W5 input).

    Rows with no contact time form the day ``null``; they make the key "have
    activities" but never match a day.

    With the ``busy_keys`` known, the rows of all other keys are shuffled once, by key, and their
    days stay so for joins by key; only the busy ones are reduced before they are shuffled.
    """
    if busy is not None:
        calm = _days_by_key(dsr.filter(~c(key).isin(busy)) if busy else dsr, key, tiebreak)
        return calm.unionByName(activity_day_summary(dsr.filter(c(key).isin(busy)), key, tiebreak)) if busy else calm
    base, by_contact, order = _activity_rows(dsr, key, tiebreak)
    days = base.groupBy(_K, "_cd").agg(F.count(F.lit(1)).alias("_n"),
                                       F.max(by_contact).alias("_last"))
    top2 = _pivot_top2(top_k_per_key(base.filter(F.col("_cd").isNotNull()), [_K, "_cd"], order, 2),
                       [_K, "_cd"])
    return _last_known(days).join(top2, [_K, "_cd"], "left")


def _days_by_key(dsr: DataFrame, key: str, tiebreak) -> DataFrame:
    """``activity_day_summary`` from one shuffle by key, for keys that one task can hold."""
    base, by_contact, order = _activity_rows(dsr, key, tiebreak)
    w = Window.partitionBy(_K, "_cd").orderBy(*order)
    dated = F.col("_cd").isNotNull()
    ranked = base.repartition(F.col(_K)).withColumn("_rn", F.row_number().over(w))
    return _last_known(ranked.groupBy(_K, "_cd").agg(
        F.count(F.lit(1)).alias("_n"), F.max(by_contact).alias("_last"),
        F.max(F.when(dated & (F.col("_rn") == 1), F.col("_p"))).alias("_p1"),
        F.max(F.when(dated & (F.col("_rn") == 2), F.col("_p"))).alias("_p2")))


def _last_known(days: DataFrame) -> DataFrame:
    """A day's latest row is found, so its tie-break columns are done with (days differ in their time)."""
    return days.withColumn("_last", F.struct(F.col("_last._o").alias("_o"), F.col("_last._p").alias("_p")))


def _activity_rows(dsr: DataFrame, key: str, tiebreak) -> tuple[DataFrame, Column, list[Column]]:
    """Keyed activity rows with their day, and the orders by contact and by creation."""
    tb = _tb(dsr, tiebreak)
    tb_names = [f"_tb{i}" for i in range(len(tb))]
    base = dsr.filter(c(key).isNotNull()).select(
        c(key).alias(_K),
        (F.to_date(c("Contacted Date")) if "Contacted Date" in dsr.columns
         else F.lit(None).cast("date")).alias("_cd"),
        (c("Created Date") if "Created Date" in dsr.columns
         else F.lit(None).cast("timestamp_ntz")).alias("_cr"),
        *tb, _payload(dsr, _D_FIELDS).alias("_p"))
    # latest by contact time, ties by tie-break columns (all descending)
    by_contact = F.struct(F.col("_p.contacted").alias("_o"), *[F.col(n) for n in tb_names],
                          F.col("_p").alias("_p"))
    return base, by_contact, [F.col("_cr").desc_nulls_last()] + [F.col(n).desc_nulls_last() for n in tb_names]


def main_key_summary(main_rows: DataFrame, key: str = KEY, tiebreak=()) -> DataFrame:
    """Per key: number of main rows (A2) and the newest two by ``Modified Date``."""
    tb = _tb(main_rows, tiebreak)
    base = main_rows.filter(c(key).isNotNull()).select(
        c(key).alias(_K),
        (c("Modified Date") if "Modified Date" in main_rows.columns
         else F.lit(None).cast("timestamp_ntz")).alias("_mo"),
        *tb, _payload(main_rows, _M_FIELDS).alias("_p"))
    counts = base.groupBy(_K).agg(F.count(F.lit(1)).alias("_mn"))
    order = [F.col("_mo").desc_nulls_last()] + [F.col(f"_tb{i}").desc_nulls_last()
                                                for i in range(len(tb))]
    top2 = _pivot_top2(top_k_per_key(base, [_K], order, 2), [_K])
    return counts.join(top2, _K, "left").select(
        _K, "_mn", F.col("_p1").alias("_m1"), F.col("_p2").alias("_m2"))


def status_six_cases(srl: DataFrame, dsr: DataFrame, main_rows: DataFrame, *,
                     key: str = KEY, dsr_tiebreak=(), main_tiebreak=(),
                     days: DataFrame | None = None, mstat: DataFrame | None = None,
                     busy: list | None = None) -> DataFrame:
    """Fill the eight previous/current status columns of each status row.

    ``srl``: one row per key (the deduplicated snapshot); ``dsr``: every
    activity row of the new log (not cut at the watermark); ``main_rows``:
    non-activity rows of the merged table.  Cases:

    1. no activity, one main row: PS = CS = the row's own stage and dates;
    2. no activity, 2+ main rows: CS = newest main row, PS = second newest;
    3. exactly one activity contacted on the modified day: CS = its new stage +
       dates, PS stage = its original stage (PS dates untouched);
    4. 2+ such activities: CS = newest by creation, PS = second newest (new stages);
    5/6. none that day but some contacted earlier: CS = the row itself,
       PS = newest earlier activity by contact time;
    otherwise the columns keep their values.

    Stored summaries (``activity_day_summary``, ``main_key_summary``) may be given as ``days``
    and ``mstat``; ``dsr`` and ``main_rows`` are not read then.  ``busy``: see ``activity_day_summary``.
    """
    srl = srl.withColumns({n: F.lit(None).cast("timestamp_ntz" if n in STATUS_DATE_COLUMNS
                                                else "string")
                           for n in STATUS_COLUMNS if n not in srl.columns})
    keys = srl.filter(c(key).isNotNull()).select(
        c(key).alias(_K),
        (F.to_date(c("Modified Date")) if "Modified Date" in srl.columns
         else F.lit(None).cast("date")).alias("_md"))

    if days is None:
        days = activity_day_summary(dsr, key, dsr_tiebreak, busy)
    dstat = days.join(keys, _K).groupBy(_K).agg(
        F.count(F.lit(1)).alias("_dd"),
        F.max(F.when(F.col("_cd") == F.col("_md"), F.col("_n"))).alias("_sn"),
        F.max(F.when(F.col("_cd") == F.col("_md"), F.col("_p1"))).alias("_s1"),
        F.max(F.when(F.col("_cd") == F.col("_md"), F.col("_p2"))).alias("_s2"),
        F.max(F.when(F.col("_cd") < F.col("_md"), F.col("_last"))).alias("_b1o"),
    ).withColumn("_b1", F.col("_b1o._p")).drop("_b1o")
    if mstat is None:
        mstat = main_key_summary(main_rows, key, main_tiebreak)

    cols = srl.columns
    j = (srl.join(dstat, c(key) == F.col(_K), "left").drop(_K)
         .join(mstat, c(key) == F.col(_K), "left").drop(_K))

    has_d = F.col("_dd").isNotNull()
    mn = F.coalesce(F.col("_mn"), F.lit(0))
    case1 = ~has_d & (mn == 1)
    case2 = ~has_d & (mn >= 2)
    case3 = has_d & (F.col("_sn") == 1)
    case4 = has_d & (F.col("_sn") >= 2)
    case5 = has_d & F.col("_sn").isNull() & F.col("_b1").isNotNull()

    def own(name: str) -> Column:
        return c(name) if name in cols else F.lit(None)

    def pick(name, c1, c2, c3, c4, c5):
        return (F.when(case1, c1).when(case2, c2).when(case3, c3).when(case4, c4)
                .when(case5, c5).otherwise(c(name)))

    new = {
        "Previous Status Stage": pick("Previous Status Stage", own("Stage"), F.col("_m2.stage"),
                                      F.col("_s1.orig"), F.col("_s2.new"), F.col("_b1.new")),
        "PS Contacted On Date": pick("PS Contacted On Date", own("Last Contact Date"),
                                     F.col("_m2.contacted"), c("PS Contacted On Date"),
                                     F.col("_s2.contacted"), F.col("_b1.contacted")),
        "PS Follow-up On Date": pick("PS Follow-up On Date", own("Next Followup Date"),
                                     F.col("_m2.followup"), c("PS Follow-up On Date"),
                                     F.col("_s2.followup"), F.col("_b1.followup")),
        "PS Closure Date": pick("PS Closure Date", own("Closing Date"), F.col("_m2.closing"),
                                c("PS Closure Date"), F.col("_s2.closing"),
                                F.col("_b1.closing")),
        "Current Status Stage": pick("Current Status Stage", own("Stage"), F.col("_m1.stage"),
                                     F.col("_s1.new"), F.col("_s1.new"), own("Stage")),
        "CS Contacted On Date": pick("CS Contacted On Date", own("Last Contact Date"),
                                     F.col("_m1.contacted"), F.col("_s1.contacted"),
                                     F.col("_s1.contacted"), own("Last Contact Date")),
        "CS Follow-up On Date": pick("CS Follow-up On Date", own("Next Followup Date"),
                                     F.col("_m1.followup"), F.col("_s1.followup"),
                                     F.col("_s1.followup"), own("Next Followup Date")),
        "CS Closure Date": pick("CS Closure Date", own("Closing Date"), F.col("_m1.closing"),
                                F.col("_s1.closing"), F.col("_s1.closing"), own("Closing Date")),
    }
    return j.select(*[new[n].cast(srl.schema[n].dataType).alias(n) if n in new else c(n)
                      for n in cols])


# ------------------------------------------------------------------- flags

def flag_new_existing(df: DataFrame, p1: DataFrame, key: str = KEY) -> DataFrame:
    """``Flag = 'Existing'`` when the key is among p1's non-null keys, else ``'New'``."""
    p1k = (p1.select(c(key).alias("_fk")).filter(F.col("_fk").isNotNull()).distinct()
           .withColumn("_fm", F.lit(True)))
    j = df.join(p1k, c(key) == F.col("_fk"), "left")
    return j.withColumn(FLAG, F.when(F.col("_fm"), F.lit("Existing")).otherwise(F.lit("New"))) \
            .drop("_fk", "_fm")


def common_new_counts(p2: DataFrame, p1: DataFrame, key: str = KEY) -> DataFrame:
    """A3: rows of p2 whose key is / is not among p1's keys; null matches null here."""
    p1k = p1.select(c(key).alias("_ck")).distinct().withColumn("_cm", F.lit(1))
    j = p2.select(c(key).alias("_pk")).join(p1k, F.col("_pk").eqNullSafe(F.col("_ck")), "left")
    return j.agg(F.count(F.col("_cm")).alias("common_count"),
                 F.count(F.when(F.col("_cm").isNull(), F.lit(1))).alias("new_count"))


def sales_reporting(p2rdb: DataFrame, p1rdb: DataFrame, dsr2rdb: DataFrame,
                    modified_rdb: DataFrame, *, dsr_tiebreak=(), main_tiebreak=(),
                    date_formats=DAYFIRST_FORMATS, busy: list | None = None) -> DataFrame:
    """Q4 tail: status columns ensured, text dates parsed (P3), Flag, projection, W6.

    ``p2rdb`` is the cleaned, de-duplicated new snapshot (one row per key).
    """
    types = {n: "timestamp_ntz" for n in STATUS_DATE_COLUMNS}
    types.update({n: "timestamp_ntz" for n in ("Enquiry Date", "Last Contact Date",
                                               "Next Followup Date", "Created Date",
                                               "Modified Date", "Closing Date")})
    p2 = p2rdb.withColumns({n: F.lit(None).cast(types.get(n, "string"))
                            for n in SRL_COLUMNS if n not in p2rdb.columns})
    p2 = parse_text_dates(p2, [n for n in SRL_COLUMNS if types.get(n)], date_formats)
    flagged = flag_new_existing(p2, p1rdb)
    srl = flagged.select(*[c(n) for n in SRL_COLUMNS + [FLAG]])
    main_rows = (modified_rdb.filter(c(DSR_TYPE).isNull()) if DSR_TYPE in modified_rdb.columns
                 else modified_rdb)
    return status_six_cases(srl, dsr2rdb, main_rows, dsr_tiebreak=dsr_tiebreak,
                            main_tiebreak=main_tiebreak, busy=busy)


__all__ = ["activity_day_summary", "busy_keys", "crowded_key", "main_key_summary", "status_six_cases",
           "flag_new_existing", "common_new_counts", "sales_reporting"]
