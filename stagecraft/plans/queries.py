"""Query registrations: the batch build, cleaning steps, joins, aggregates,
windows and the grid.

Each registration pairs a Spark query with its DuckDB oracle (see
``stagecraft.oracle``).  Column names are identical on both sides.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..columns import (CATEGORY_MAPPING, KEY, P_DATES, P_RENAME, SRL_COLUMNS,
                       STAGE_MAPPING, c)
from ..operators import clean as CL
from ..operators import grid as G
from ..operators import merge as MG
from ..operators import ranking as RK
from ..operators import status as ST
from ..registry import PARAMS, register, tables
from ..sources import derived as dv
from . import build as B

TB = O.TB_DESC
SRL = "srl"

# ------------------------------------------------------------------ batch build


@register("clean_potentials", O.with_ctes("SELECT * FROM p1rdb"))
def q_clean_potentials(spark, sf_dir):
    return CL.clean_potentials(dv.p1(spark, sf_dir), **PARAMS.cleaning())


@register("clean_activities", O.with_ctes("SELECT * FROM dsr2rdb"))
def q_clean_activities(spark, sf_dir):
    return CL.clean_activities(dv.dsr2(spark, sf_dir), **PARAMS.cleaning())


@register("dedupe_keep_first", O.with_ctes("SELECT * FROM p2rdb"))
def q_dedupe_keep_first(spark, sf_dir):
    return RK.dedupe_keep_first(tables(spark, sf_dir)["p2rdb_all"], KEY, PARAMS.load_order)


_NOT_IN_P2 = [n for n in SRL_COLUMNS if n in ("Enquiry Date", "Potential Name", "Campaign Source", "Mobile",
                                              "Billing City", "Email", "Lead Source")]


@register("stored_snapshot", O.with_ctes(
    "SELECT p.*, " + ", ".join(f"CAST(NULL AS {'TIMESTAMP' if n == 'Enquiry Date' else 'VARCHAR'}) AS {O.qi(n)}"
                               for n in _NOT_IN_P2) +
    ', CASE WHEN "Potential No." IN (SELECT "Potential No." FROM p1rdb WHERE "Potential No." IS NOT NULL) '
    "THEN 'Existing' ELSE 'New' END AS \"Flag\" FROM p2rdb p"))
def q_stored_snapshot(spark, sf_dir):
    t = tables(spark, sf_dir)
    return B.stored_snapshot(t["p2rdb_deduped"], t["p1rdb"])


def _merged(spark, sf_dir):
    t = tables(spark, sf_dir)
    return MG.incremental_merge(t["p1rdb"], t["p2rdb_deduped"], t["dsr1rdb"], t["dsr2rdb"])


@register("incremental_merge", O.with_ctes("SELECT * FROM modified_rdb"))
def q_incremental_merge(spark, sf_dir):
    return _merged(spark, sf_dir)["modified_rdb"]


@register("union_by_name", O.with_ctes("SELECT * FROM main_rdb"))
def q_union_by_name(spark, sf_dir):
    t = tables(spark, sf_dir)
    return MG.union_by_name(t["p1rdb"], t["dsr1rdb"])


@register("weekly_rdb", O.with_ctes("SELECT * FROM weekly_rdb"))
def q_weekly(spark, sf_dir):
    return _merged(spark, sf_dir)["weekly_rdb"]


@register("filter_after_watermark", O.with_ctes("SELECT * FROM p2f"))
def q_filter_after_watermark(spark, sf_dir):
    return _merged(spark, sf_dir)["p2rdb_filtered"]


@register("watermark", O.with_ctes("SELECT watermark FROM wm"))
def q_watermark(spark, sf_dir):
    return B.stored_watermark(tables(spark, sf_dir)[B.METRICS])


@register("sales_reporting", O.with_ctes(f"SELECT * FROM {SRL}"))
def q_sales_reporting(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ST.sales_reporting(t["p2rdb_deduped"], t["p1rdb"], t["dsr2rdb"], t["modified_rdb"],
                              dsr_tiebreak=PARAMS.dsr_tiebreak, main_tiebreak=PARAMS.main_tiebreak,
                              busy=ST.busy_keys(t["dsr2rdb"]))


@register("status_six_cases", O.with_ctes(
    f'SELECT "Potential No.", "Previous Status Stage", "PS Contacted On Date", '
    f'"PS Follow-up On Date", "PS Closure Date", "Current Status Stage", '
    f'"CS Contacted On Date", "CS Follow-up On Date", "CS Closure Date" FROM {SRL}'))
def q_status_six_cases(spark, sf_dir):
    t = tables(spark, sf_dir)
    main = t["modified_rdb"].filter(c("DSR Type").isNull())
    cols = [KEY] + [n for n in SRL_COLUMNS if n.startswith(("PS ", "CS ", "Previous", "Current"))]
    return ST.status_six_cases(t["p2rdb"], t["dsr2rdb"], main, dsr_tiebreak=PARAMS.dsr_tiebreak,
                               main_tiebreak=PARAMS.main_tiebreak,
                               busy=ST.busy_keys(t["dsr2rdb"])).select(*[c(n) for n in cols])


@register("duplicate_rows", O.with_ctes(
    'SELECT * FROM p2c WHERE "Potential No." IN '
    '(SELECT "Potential No." FROM p2c GROUP BY 1 HAVING count(*) > 1)'))
def q_duplicate_rows(spark, sf_dir):
    return RK.duplicate_rows(tables(spark, sf_dir)["p2rdb_all"])


@register("record_counts", O.with_ctes(
    "SELECT 'main_rdb' AS \"table\", count(*) AS n FROM main_rdb UNION ALL "
    "SELECT 'weekly_rdb', count(*) FROM weekly_rdb UNION ALL "
    "SELECT 'modified_rdb', count(*) FROM modified_rdb UNION ALL "
    f"SELECT 'sales_reporting_logic', count(*) FROM {SRL}"))
def q_record_counts(spark, sf_dir):
    return B.stored_counts(tables(spark, sf_dir)[B.METRICS])


@register("common_new_counts", O.with_ctes(
    'SELECT count(*) FILTER (WHERE m) AS common_count, count(*) FILTER (WHERE NOT m) AS new_count '
    'FROM (SELECT EXISTS (SELECT 1 FROM p1rdb q WHERE q."Potential No." IS NOT DISTINCT FROM '
    'p."Potential No.") AS m FROM p2rdb p)'))
def q_common_new_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    return B.existing_new_counts(t["p2rdb"], t["p1rdb"])


@register("flag_new_existing", O.with_ctes(f'SELECT "Potential No.", "Flag" FROM {SRL}'))
def q_flag_new_existing(spark, sf_dir):
    t = tables(spark, sf_dir)
    return ST.flag_new_existing(t["p2rdb"], t["p1rdb"]).select(c(KEY), c("Flag"))


_DISC = f"""
a AS (SELECT DISTINCT "Potential No." FROM {SRL} WHERE "Potential No." IS NOT NULL),
b AS (SELECT DISTINCT "Potential No." FROM dsr2rdb WHERE "Potential No." IS NOT NULL)"""


@register("keys_only_left", O.with_ctes(
    "," + _DISC + '\nSELECT "Potential No." FROM a EXCEPT SELECT "Potential No." FROM b'))
def q_keys_only_left(spark, sf_dir):
    t = tables(spark, sf_dir)
    return (B.discrepancies(t["sales_reporting_logic"], t["dsr2rdb"])
            .filter(F.col("side") == "srl_only").select(c(KEY)))


@register("keys_only_right", O.with_ctes(
    "," + _DISC + '\nSELECT "Potential No." FROM b EXCEPT SELECT "Potential No." FROM a'))
def q_keys_only_right(spark, sf_dir):
    t = tables(spark, sf_dir)
    return (B.discrepancies(t["sales_reporting_logic"], t["dsr2rdb"])
            .filter(F.col("side") == "dsr2_only").select(c(KEY)))


@register("discrepancies", O.with_ctes(
    "," + _DISC + "\nSELECT 'srl_only' AS side, count(*) AS n FROM "
    '(SELECT "Potential No." FROM a EXCEPT SELECT "Potential No." FROM b) '
    "UNION ALL SELECT 'dsr2_only', count(*) FROM "
    '(SELECT "Potential No." FROM b EXCEPT SELECT "Potential No." FROM a)'))
def q_discrepancies(spark, sf_dir):
    t = tables(spark, sf_dir)
    return B.discrepancy_counts(t["sales_reporting_logic"], t["dsr2rdb"])


@register("set_difference", O.with_ctes(
    "," + _DISC + "\nSELECT 'srl_only' AS side, * FROM "
    '(SELECT "Potential No." FROM a EXCEPT SELECT "Potential No." FROM b) '
    "UNION ALL SELECT 'dsr2_only', * FROM "
    '(SELECT "Potential No." FROM b EXCEPT SELECT "Potential No." FROM a)'))
def q_set_difference(spark, sf_dir):
    t = tables(spark, sf_dir)
    return B.discrepancies(t["sales_reporting_logic"], t["dsr2rdb"])


# -------------------------------------------------------------- cleaning steps

@register("drop_columns_if_present", O.with_ctes("SELECT * EXCLUDE (k, ck) FROM v_p2"))
def q_drop_columns(spark, sf_dir):
    return CL.drop_columns_if_present(dv.p2(spark, sf_dir), ["Record Id", "k", "ck"])


_RENAMED_P2 = ("SELECT * RENAME (\"Sales handled by\" AS \"Executive\", "
               "\"Created Time\" AS \"Created Date\", \"Modified Time\" AS \"Modified Date\", "
               "\"Company Name (Company Name)\" AS \"Company Name\") FROM v_p2")


@register("rename_columns", O.with_ctes(_RENAMED_P2))
def q_rename_columns(spark, sf_dir):
    return CL.rename_columns(dv.p2(spark, sf_dir), P_RENAME)


def _parsed_p2_sql():
    cols = ", ".join(f'{O.parse(O.qi(n))} AS {O.qi(n)}' for n in P_DATES if n != "Enquiry Date")
    return f"SELECT * REPLACE ({cols}) FROM ({_RENAMED_P2})"


@register("parse_dates_dayfirst", O.with_ctes(_parsed_p2_sql()))
def q_parse_dates_dayfirst(spark, sf_dir):
    return CL.parse_dates_dayfirst(CL.rename_columns(dv.p2(spark, sf_dir), P_RENAME), P_DATES)


@register("parse_dates_iso", O.with_ctes(
    'SELECT "Potential No.", "Modified Date", "Closing Date" FROM p2rdb'))
def q_parse_dates_iso(spark, sf_dir):
    p2 = tables(spark, sf_dir)["p2rdb"].select(
        c(KEY), c("Modified Date").cast("string").alias("Modified Date"),
        c("Closing Date").cast("string").alias("Closing Date"))
    return CL.parse_dates_iso(p2, ["Modified Date", "Closing Date"])


@register("filter_min_date", O.with_ctes(
    f'SELECT * FROM ({_parsed_p2_sql()}) WHERE "Created Date" >= {O.T_MIN} '
    f'OR "Modified Date" >= {O.T_MIN}'))
def q_filter_min_date(spark, sf_dir):
    df = CL.parse_dates_dayfirst(CL.rename_columns(dv.p2(spark, sf_dir), P_RENAME), P_DATES)
    return CL.filter_min_date(df, dv.MIN_DATE)


@register("map_stage", O.with_ctes(
    f"SELECT * REPLACE ({O.case_map(chr(34) + 'Original Stage' + chr(34), STAGE_MAPPING)} "
    f"AS \"Original Stage\", {O.case_map(chr(34) + 'New Stage' + chr(34), STAGE_MAPPING)} "
    f"AS \"New Stage\") FROM v_dsr2"))
def q_map_stage(spark, sf_dir):
    return CL.map_stage(dv.dsr2(spark, sf_dir))


@register("map_category", O.with_ctes(
    f"SELECT * REPLACE ({O.case_map(chr(34) + 'Category' + chr(34), CATEGORY_MAPPING)} "
    f"AS \"Category\") FROM v_p2"))
def q_map_category(spark, sf_dir):
    return CL.map_category(dv.p2(spark, sf_dir))


@register("canonical_executive", O.with_ctes(
    f"SELECT * REPLACE ({O.exec_expr(chr(34) + 'Executive' + chr(34))} AS \"Executive\") "
    f"FROM ({_RENAMED_P2})"))
def q_canonical_executive(spark, sf_dir):
    df = CL.rename_columns(dv.p2(spark, sf_dir), P_RENAME)
    return CL.canonical_executive(df, dv.EXEC_ALIASES, dv.EXEC_SUFFIXED)


@register("suffix_concat", O.with_ctes(
    f"SELECT DISTINCT \"Sales handled by\" AS raw, "
    f"{O.exec_expr(chr(34) + 'Sales handled by' + chr(34))} AS \"Executive\" FROM v_p2"))
def q_suffix_concat(spark, sf_dir):
    df = dv.p2(spark, sf_dir).select(c("Sales handled by").alias("raw"),
                                     c("Sales handled by").alias("Executive"))
    return CL.canonical_executive(df, dv.EXEC_ALIASES, dv.EXEC_SUFFIXED).distinct()


@register("map_owner", O.with_ctes(
    f"SELECT * REPLACE ({O.case_map(chr(34) + 'Potential Owner' + chr(34), dv.OWNER_MAP)} "
    f"AS \"Potential Owner\") FROM v_p2"))
def q_map_owner(spark, sf_dir):
    return CL.map_owner(dv.p2(spark, sf_dir), dv.OWNER_MAP)


@register("map_owner_join", O.with_ctes(
    "SELECT * REPLACE (coalesce(m.addr, \"Potential Owner\") AS \"Potential Owner\") "
    "FROM v_p2 LEFT JOIN (SELECT DISTINCT 'Owner ' || CAST(c_custkey % 7 AS VARCHAR) AS lbl, "
    "'owner' || CAST(c_custkey % 7 AS VARCHAR) || '@example.org' AS addr FROM customer "
    ") m ON \"Potential Owner\" = m.lbl")
    .replace("SELECT * REPLACE", "SELECT v_p2.* REPLACE"))
def q_map_owner_join(spark, sf_dir):
    cu = dv.read_table(spark, sf_dir, "customer")
    n = (F.col("c_custkey") % 7).cast("string")
    mapping = cu.select(F.concat(F.lit("Owner "), n).alias("label"),
                        F.concat(F.lit("owner"), n, F.lit("@example.org")).alias("address"))
    return CL.map_owner(dv.p2(spark, sf_dir), mapping)


@register("coalesce_contact_mode", O.with_ctes(
    "SELECT * EXCLUDE (\"Mode of Contact (DSR)\") REPLACE (coalesce(\"Mode of Contact (DSR)\", "
    "\"Mode of Contact\") AS \"Mode of Contact\") FROM v_dsr2"))
def q_coalesce_contact_mode(spark, sf_dir):
    return CL.coalesce_contact_mode(dv.dsr2(spark, sf_dir))


@register("backfill_new_stage", O.with_ctes(
    "SELECT * REPLACE (coalesce(\"New Stage\", \"Original Stage\") AS \"New Stage\") FROM v_dsr2"))
def q_backfill_new_stage(spark, sf_dir):
    return CL.backfill_new_stage(dv.dsr2(spark, sf_dir))


@register("add_constant", O.with_ctes("SELECT *, 'DSR' AS \"DSR Type\" FROM v_dsr2"))
def q_add_constant(spark, sf_dir):
    return CL.add_constant(dv.dsr2(spark, sf_dir))


@register("filter_key_not_null", O.with_ctes(
    'SELECT * FROM v_dsr2 WHERE "Potential No." IS NOT NULL'))
def q_filter_key_not_null(spark, sf_dir):
    return CL.filter_key_not_null(dv.dsr2(spark, sf_dir))


@register("ensure_columns", O.with_ctes(
    "SELECT *, CAST(NULL AS VARCHAR) AS \"Potential Name\", CAST(NULL AS VARCHAR) AS \"Mobile\", "
    "CAST(NULL AS TIMESTAMP) AS \"Enquiry Date\" FROM p1rdb"))
def q_ensure_columns(spark, sf_dir):
    return CL.ensure_columns(tables(spark, sf_dir)["p1rdb"],
                             ["Potential Name", "Mobile", "Enquiry Date", "Stage"],
                             {"Enquiry Date": "timestamp_ntz"})


@register("to_date_part", O.with_ctes(
    f'SELECT "Potential No.", CAST("Modified Date" AS DATE) AS "Modified Date", '
    f'CAST("CS Contacted On Date" AS DATE) AS "CS Contacted On Date" FROM {SRL}'))
def q_to_date_part(spark, sf_dir):
    srl = tables(spark, sf_dir)["sales_reporting_logic"]
    return srl.select(c(KEY), F.to_date(c("Modified Date")).alias("Modified Date"),
                      F.to_date(c("CS Contacted On Date")).alias("CS Contacted On Date"))


@register("reorder_columns", O.with_ctes(f'SELECT "Potential No.", "Flag", * EXCLUDE ("Potential No.", "Flag") FROM {SRL}'))
def q_reorder_columns(spark, sf_dir):
    srl = tables(spark, sf_dir)["sales_reporting_logic"]
    first = [KEY, "Flag"]
    return srl.select(*[c(n) for n in first + [x for x in srl.columns if x not in first]])


# ------------------------------------------------------- per-key aggregates / windows

@register("dedupe_latest", O.with_ctes(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY \"Potential No.\" "
    f"ORDER BY \"Modified Date\" DESC NULLS LAST, _seq DESC NULLS LAST, {TB}) AS rn "
    "FROM modified_rdb) WHERE rn = 1"))
def q_dedupe_latest(spark, sf_dir):
    return RK.dedupe_latest(tables(spark, sf_dir)["modified_rdb"], KEY, "Modified Date",
                            dv.MERGED_TIEBREAK)


@register("count_per_key", O.with_ctes(f"""
, mc AS (SELECT "Potential No." AS k1, count(*) AS n_main FROM modified_rdb
         WHERE "DSR Type" IS NULL AND "Potential No." IS NOT NULL GROUP BY 1),
ac AS (SELECT "Potential No." AS k2, count(*) AS n_activity FROM dsr2rdb
       WHERE "Potential No." IS NOT NULL GROUP BY 1),
sc AS (SELECT d."Potential No." AS k3, count(*) AS n_same_day FROM dsr2rdb d JOIN {SRL} r
       ON d."Potential No." = r."Potential No."
       AND CAST(d."Contacted Date" AS DATE) = CAST(r."Modified Date" AS DATE) GROUP BY 1)
SELECT r."Potential No.", CAST(coalesce(n_main, 0) AS BIGINT) AS n_main,
       CAST(coalesce(n_activity, 0) AS BIGINT) AS n_activity,
       CAST(coalesce(n_same_day, 0) AS BIGINT) AS n_same_day
FROM {SRL} r LEFT JOIN mc ON r."Potential No." = k1 LEFT JOIN ac ON r."Potential No." = k2
     LEFT JOIN sc ON r."Potential No." = k3"""))
def q_count_per_key(spark, sf_dir):
    t = tables(spark, sf_dir)
    srl = t["sales_reporting_logic"]
    keys = srl.select(c(KEY).alias("_k"), F.to_date(c("Modified Date")).alias("_md"))
    days = ST.activity_day_summary(t["dsr2rdb"], KEY, dv.DSR_TIEBREAK)
    act = days.join(keys, "_k").groupBy("_k").agg(
        F.sum("_n").alias("n_activity"),
        F.sum(F.when(F.col("_cd") == F.col("_md"), F.col("_n"))).alias("n_same_day"))
    main = ST.main_key_summary(t["modified_rdb"].filter(c("DSR Type").isNull()), KEY,
                               dv.MAIN_TIEBREAK).select("_k", F.col("_mn").alias("n_main"))
    j = srl.select(c(KEY)).join(main, c(KEY) == F.col("_k"), "left").drop("_k") \
        .join(act, c(KEY) == F.col("_k"), "left").drop("_k")
    return j.select(c(KEY), *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
                              for n in ("n_main", "n_activity", "n_same_day")])


def _flat(prefix_struct: str, fields):
    return [F.col(f"{prefix_struct}.{f}").alias(f) for f in fields]


@register("top2_main", O.with_ctes(f"""
SELECT pk AS "Potential No.", CAST(rn AS BIGINT) AS rank, st AS stage, lc AS contacted,
       fu AS followup, cl AS closing FROM mm WHERE rn <= 2 AND pk IN (SELECT pk FROM sk)"""))
def q_top2_main(spark, sf_dir):
    t = tables(spark, sf_dir)
    m = ST.main_key_summary(t["modified_rdb"].filter(c("DSR Type").isNull()), KEY,
                            dv.MAIN_TIEBREAK)
    keys = t["sales_reporting_logic"].select(c(KEY).alias("_k"))
    m = m.join(keys, "_k", "left_semi")
    fields = ["stage", "contacted", "followup", "closing"]
    one = m.select(F.col("_k").alias(KEY), F.lit(1).cast("bigint").alias("rank"),
                   *_flat("_m1", fields))
    two = m.filter(F.col("_m2").isNotNull()).select(
        F.col("_k").alias(KEY), F.lit(2).cast("bigint").alias("rank"), *_flat("_m2", fields))
    return one.unionByName(two)


@register("top2_same_day", O.with_ctes("""
SELECT pk AS "Potential No.", CAST(rn AS BIGINT) AS rank, CAST(sn AS BIGINT) AS n_same_day,
       nw AS new, og AS orig, ct AS contacted, fu AS followup, cl AS closing
FROM same WHERE rn <= 2"""))
def q_top2_same_day(spark, sf_dir):
    t = tables(spark, sf_dir)
    srl = t["sales_reporting_logic"]
    keys = srl.filter(c(KEY).isNotNull()).select(c(KEY).alias("_k"),
                                                 F.to_date(c("Modified Date")).alias("_md"))
    days = ST.activity_day_summary(t["dsr2rdb"], KEY, dv.DSR_TIEBREAK)
    same = days.join(keys, (days["_k"] == keys["_k"]) & (days["_cd"] == keys["_md"])) \
        .select(days["_k"], "_n", "_p1", "_p2")
    fields = ["new", "orig", "contacted", "followup", "closing"]
    one = same.select(F.col("_k").alias(KEY), F.lit(1).cast("bigint").alias("rank"),
                      F.col("_n").alias("n_same_day"), *_flat("_p1", fields))
    two = same.filter(F.col("_p2").isNotNull()).select(
        F.col("_k").alias(KEY), F.lit(2).cast("bigint").alias("rank"),
        F.col("_n").alias("n_same_day"), *_flat("_p2", fields))
    return one.unionByName(two)


@register("activity_same_day", O.with_ctes("""
SELECT pk AS "Potential No.", cr AS "Created Date", ct AS "Contacted Date", nw AS "New Stage",
       og AS "Original Stage", l_linenumber, l_partkey, l_suppkey FROM dd WHERE cd = md"""))
def q_activity_same_day(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = t["sales_reporting_logic"].filter(c(KEY).isNotNull()).select(
        c(KEY).alias("_k"), F.to_date(c("Modified Date")).alias("_md"))
    d = t["dsr2rdb"]
    j = d.join(keys, (c(KEY) == F.col("_k")) & (F.to_date(c("Contacted Date")) == F.col("_md")))
    return j.select(c(KEY), c("Created Date"), c("Contacted Date"), c("New Stage"),
                    c("Original Stage"), "l_linenumber", "l_partkey", "l_suppkey")


@register("activity_asof_before", O.with_ctes("""
SELECT pk AS "Potential No.", nw AS "New Stage", ct AS "Contacted Date", fu AS "Next Followup Date",
       cl AS "Closing Date" FROM b1"""))
def q_activity_asof_before(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = t["sales_reporting_logic"].filter(c(KEY).isNotNull()).select(
        c(KEY).alias("_k"), F.to_date(c("Modified Date")).alias("_md"))
    days = ST.activity_day_summary(t["dsr2rdb"], KEY, dv.DSR_TIEBREAK)
    b = (days.join(keys, "_k").filter(F.col("_cd") < F.col("_md")).groupBy("_k")
         .agg(F.max("_last").alias("_b")))
    return b.select(F.col("_k").alias(KEY), F.col("_b._p.new").alias("New Stage"),
                    F.col("_b._p.contacted").alias("Contacted Date"),
                    F.col("_b._p.followup").alias("Next Followup Date"),
                    F.col("_b._p.closing").alias("Closing Date"))


@register("main_per_potential", O.with_ctes(f"""
SELECT m."Potential No.", m."Modified Date", m."Stage", m._seq FROM modified_rdb m
WHERE m."DSR Type" IS NULL AND m."Potential No." IN (SELECT "Potential No." FROM {SRL})"""))
def q_main_per_potential(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = t["sales_reporting_logic"].select(c(KEY).alias("_k"))
    m = t["modified_rdb"].filter(c("DSR Type").isNull())
    return (m.join(keys, c(KEY) == F.col("_k"), "left_semi")
            .select(c(KEY), c("Modified Date"), c("Stage"), "_seq"))


# ------------------------------------------------------------------------- grid

GRID_ORACLE = O.with_ctes(O.grid_sql(SRL) + "\nSELECT * FROM grid")


@register("stage_movement_grid", GRID_ORACLE)
def q_stage_movement_grid(spark, sf_dir):
    return G.stage_movement_grid(tables(spark, sf_dir)["sales_reporting_logic"])


@register("grid_left_join", GRID_ORACLE)
def q_grid_left_join(spark, sf_dir):
    # J6 is subsumed by the single aggregation of A5 (every stage gets a row).
    return G.stage_movement_grid(tables(spark, sf_dir)["sales_reporting_logic"])


@register("stage_universe", O.with_ctes(O.grid_sql(SRL) + '\nSELECT sname AS "Stage Name" FROM uni'))
def q_stage_universe(spark, sf_dir):
    return G.stage_universe(tables(spark, sf_dir)["sales_reporting_logic"])


@register("grid_total_row", O.with_ctes(O.grid_sql(SRL) + f"""
SELECT * FROM grid UNION ALL
SELECT 'Total', CAST(sum("OB") AS BIGINT), CAST(sum("Added-New") AS BIGINT),
       CAST(sum("Added-Old") AS BIGINT), CAST(sum("Moved") AS BIGINT),
       CAST(sum("Dropped") AS BIGINT), CAST(sum("CB") AS BIGINT)
FROM grid WHERE "Stage Name" <> {O.s(G.CLOSED_STAGE)}"""))
def q_grid_total_row(spark, sf_dir):
    return G.grid_total_row(G.stage_movement_grid(tables(spark, sf_dir)["sales_reporting_logic"]))


@register("movement_report", O.with_ctes(O.grid_sql(SRL) + O.finish_grid_sql("grid")))
def q_movement_report(spark, sf_dir):
    srl = tables(spark, sf_dir)["sales_reporting_logic"]
    return G.finish_grid(G.stage_movement_grid(srl))


@register("sort_stage_number", O.with_ctes(
    O.grid_sql(SRL) + f'\nSELECT * FROM grid ORDER BY {O.stage_num_sql(chr(34) + "Stage Name" + chr(34))}, "Stage Name"'))
def q_sort_stage_number(spark, sf_dir):
    return G.sort_stage_number(G.stage_movement_grid(tables(spark, sf_dir)["sales_reporting_logic"]))


@register("limit_rows", O.with_ctes(O.grid_sql(SRL) + O.finish_grid_sql("grid", limit=20)))
def q_limit_rows(spark, sf_dir):
    g = G.grid_total_row(G.filter_exclude_stages(
        G.stage_movement_grid(tables(spark, sf_dir)["sales_reporting_logic"])))
    return G.limit_rows(g)


@register("filter_exclude_stages", O.with_ctes(
    O.grid_sql(SRL) + f'\nSELECT * FROM grid WHERE "Stage Name" NOT IN {O.in_list(G.GRID_EXCLUDED_STAGES)}'))
def q_filter_exclude_stages(spark, sf_dir):
    return G.filter_exclude_stages(G.stage_movement_grid(tables(spark, sf_dir)["sales_reporting_logic"]))


HIGHER = "60 - Value Proposition"


@register("filter_stage_at_least", O.with_ctes(
    O.grid_sql(SRL) + f'\nSELECT * FROM grid WHERE {O.stage_num_sql(chr(34) + "Stage Name" + chr(34))} >= 60'))
def q_filter_stage_at_least(spark, sf_dir):
    return G.filter_stage_at_least(
        G.stage_movement_grid(tables(spark, sf_dir)["sales_reporting_logic"]), HIGHER)


@register("movement_report_higher_stage",
          O.with_ctes(O.grid_sql(SRL) + O.finish_grid_sql("grid", HIGHER)))
def q_movement_report_higher(spark, sf_dir):
    srl = tables(spark, sf_dir)["sales_reporting_logic"]
    return G.finish_grid(G.stage_movement_grid(srl), HIGHER)


@register("grid_alerts", O.with_ctes(
    O.grid_sql(SRL) + O.finish_grid_sql("grid").replace(
        "SELECT * EXCLUDE (is_total) FROM g3",
        "SELECT * EXCLUDE (is_total), CASE WHEN \"Stage Name\" IN "
        f"{O.in_list(G.ALERT_PINK_STAGES)} AND \"Dropped\" >= 1 THEN 'lightpink' "
        f"WHEN \"Stage Name\" = {O.s(G.ALERT_RED_STAGE)} AND \"Dropped\" >= 1 THEN 'lightcoral' "
        "END AS dropped_alert, CASE WHEN \"Added-New\" >= 1 THEN 'lightgreen' END AS added_alert "
        "FROM g3")))
def q_grid_alerts(spark, sf_dir):
    srl = tables(spark, sf_dir)["sales_reporting_logic"]
    return G.grid_alerts(G.finish_grid(G.stage_movement_grid(srl)))


@register("row_number_display", O.with_ctes(
    O.grid_sql(SRL) + O.finish_grid_sql("grid").replace(
        "SELECT * EXCLUDE (is_total) FROM g3",
        "SELECT * EXCLUDE (is_total), row_number() OVER (ORDER BY is_total, "
        f"{O.stage_num_sql(chr(34) + 'Stage Name' + chr(34))}, \"Stage Name\") AS \"No.\" FROM g3")))
def q_row_number_display(spark, sf_dir):
    from pyspark.sql import Window
    srl = tables(spark, sf_dir)["sales_reporting_logic"]
    g = G.finish_grid(G.stage_movement_grid(srl))
    # one row per stage, so one ordered window partition is fine
    w = Window.orderBy(*G._display_order(F.col(G.STAGE_NAME)))
    return g.withColumn("No.", F.row_number().over(w).cast("bigint"))

