"""Report-layer query registrations: filters, drill-down, lookups, log folds,
periods, scalar functions and exports.

Fixed picks stand in for the dashboard's selections.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from .. import oracle as O
from ..columns import DETAIL_GROUPS, DRILL_COLUMNS, KEY, SRL_DATE_COLUMNS, c
from ..functions import periods as PD
from ..functions.dates import format_date, ist_stamp
from ..functions.text import digits_only, is_blank, stage_number
from ..operators import filters as FL
from ..operators import grid as G
from ..operators import logs as LG
from ..operators import lookup as LK
from ..operators import ranking as RK
from ..registry import register, tables
from ..sources import derived as dv
from ..sources import readers as RD
from ..sources import writers as WR

SRL = "srl"
AS_OF = "2000-03-05"          # a Sunday
AS_OF_MID = "2000-02-15"
PICK_STAGES = ["80 - Final Quote", "60 - Value Proposition"]
LEAD = "Exec 0"
TEAM = {"Exec 0": ["Exec 0", "Exec 2", "Exec 5"]}
RESTRICTED = ["Exec 7"]
FORCED_REGIONS = {"Exec 0": "EUROPE"}
BM_USER = "5"
STATE, COMPANY, CODE = "NATION_7", "Customer#000000095", "BUILDING"


def _srl(spark, sf_dir):
    return tables(spark, sf_dir)["sales_reporting_logic"]


def _ts(x: dt.datetime) -> str:
    return f"TIMESTAMP '{x.strftime('%Y-%m-%d %H:%M:%S')}'"


def _in_range_sql(cols, lo, hi):
    return "(" + " OR ".join(f'coalesce({O.qi(n)} >= {_ts(lo)} AND {O.qi(n)} < {_ts(hi)}, false)'
                             for n in cols) + ")"


# ------------------------------------------------------------------- filters

@register("filter_attributes", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE \"Executive\" = 'Exec 3' AND \"Region\" = 'ASIA'"))
def q_filter_attributes(spark, sf_dir):
    return FL.filter_attributes(_srl(spark, sf_dir), executive="Exec 3", region="ASIA")


@register("filter_role", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE \"Executive\" IN {O.in_list(TEAM[LEAD])}"))
def q_filter_role(spark, sf_dir):
    return FL.filter_role(_srl(spark, sf_dir), LEAD, "All", TEAM, RESTRICTED)


@register("filter_role_fallback", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE \"Executive\" = {O.s(LEAD)}"))
def q_filter_role_fallback(spark, sf_dir):
    # a lead picking an executive outside their team sees their own rows
    return FL.filter_role(_srl(spark, sf_dir), LEAD, "Exec 9", TEAM, RESTRICTED)


@register("filter_role_restricted", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE \"Executive\" = 'Exec 7'"))
def q_filter_role_restricted(spark, sf_dir):
    return FL.filter_role(_srl(spark, sf_dir), "Exec 7", "All", TEAM, RESTRICTED)


@register("filter_role_batch", O.with_ctes(f"""
, pol AS (SELECT DISTINCT 'lead ' || CAST(CAST(regexp_extract("Executive", '([0-9]+)', 1) AS INTEGER) % 3 AS VARCHAR) AS "user",
                 "Executive" AS ex FROM {SRL} WHERE "Executive" IS NOT NULL)
SELECT r.*, pol."user" FROM {SRL} r JOIN pol ON r."Executive" = pol.ex"""))
def q_filter_role_batch(spark, sf_dir):
    srl = _srl(spark, sf_dir)
    policy = (srl.select(c("Executive").alias("executive")).filter(F.col("executive").isNotNull())
              .distinct()
              .withColumn("user", F.concat(F.lit("lead "), (F.regexp_extract(
                  "executive", "([0-9]+)", 1).cast("int") % 3).cast("string"))))
    return FL.filter_role_batch(srl, policy)


@register("filter_forced_region", O.with_ctes(f"SELECT * FROM {SRL} WHERE \"Region\" = 'EUROPE'"))
def q_filter_forced_region(spark, sf_dir):
    return FL.filter_forced_region(_srl(spark, sf_dir), LEAD, FORCED_REGIONS, "ASIA")


_QLO, _QHI = PD.period_range(PD.CURRENT_QUARTER, AS_OF)


@register("filter_any_date_in_range", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE {_in_range_sql(SRL_DATE_COLUMNS, _QLO, _QHI)}"))
def q_filter_any_date_in_range(spark, sf_dir):
    return FL.filter_any_date_in_range(_srl(spark, sf_dir), _QLO, _QHI)


_MLO, _MHI = PD.period_range(PD.LAST_MONTH, AS_OF)


@register("report_followup", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE {_in_range_sql(['Last Contact Date', 'CS Contacted On Date'], _MLO, _MHI)}"))
def q_report_followup(spark, sf_dir):
    return FL.report_followup(_srl(spark, sf_dir), _MLO, _MHI)


@register("report_pending", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE \"Last Contact Date\" IS NULL AND \"CS Contacted On Date\" IS NULL"))
def q_report_pending(spark, sf_dir):
    return FL.report_pending(_srl(spark, sf_dir))


@register("report_planned", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE \"Next Followup Date\" IS NOT NULL OR \"CS Follow-up On Date\" IS NOT NULL"))
def q_report_planned(spark, sf_dir):
    return FL.report_planned(_srl(spark, sf_dir))


_FLO, _FHI = PD.period_range(PD.CURRENT_FY, AS_OF_MID)


@register("report_closure", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE {_in_range_sql(['Closing Date', 'CS Closure Date'], _FLO, _FHI)}"))
def q_report_closure(spark, sf_dir):
    return FL.report_closure(_srl(spark, sf_dir), _FLO, _FHI)


_CHAIN_SQL = (f"SELECT * FROM {SRL} WHERE \"Executive\" IN {O.in_list(TEAM[LEAD])} "
              f"AND \"Region\" = 'EUROPE' AND \"Potential Code\" = 'BUILDING' "
              f"AND {_in_range_sql(SRL_DATE_COLUMNS, _FLO, _FHI)} "
              f"AND {_in_range_sql(['Last Contact Date', 'CS Contacted On Date'], _FLO, _FHI)}")


def _chain(spark, sf_dir):
    df, _, _ = FL.filter_report_chain(
        _srl(spark, sf_dir), user=LEAD, team=TEAM, restricted=RESTRICTED,
        forced_regions=FORCED_REGIONS, code="BUILDING", criterion=PD.CURRENT_FY,
        as_of=AS_OF_MID, report="Follow-up")
    return df


@register("filter_report_chain", O.with_ctes(_CHAIN_SQL))
def q_filter_report_chain(spark, sf_dir):
    return _chain(spark, sf_dir)


@register("movement_report_filtered", O.with_ctes(
    f", fsrl AS ({_CHAIN_SQL})" + O.grid_sql("fsrl") + O.finish_grid_sql("grid")))
def q_movement_report_filtered(spark, sf_dir):
    return G.finish_grid(G.stage_movement_grid(_chain(spark, sf_dir)))


_CLO, _CHI = PD.period_range(PD.CUSTOM, start="1999-01-01", end="1999-06-30")


@register("custom_window", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE {_in_range_sql(SRL_DATE_COLUMNS, _CLO, _CHI)}"))
def q_custom_window(spark, sf_dir):
    return FL.filter_any_date_in_range(_srl(spark, sf_dir), _CLO, _CHI)


@register("filter_is_activity", O.with_ctes(
    'SELECT * FROM modified_rdb WHERE "DSR Type" IS NOT NULL'))
def q_filter_is_activity(spark, sf_dir):
    return FL.filter_is_activity(tables(spark, sf_dir)["modified_rdb"])


@register("filter_is_main", O.with_ctes('SELECT * FROM modified_rdb WHERE "DSR Type" IS NULL'))
def q_filter_is_main(spark, sf_dir):
    return FL.filter_is_main(tables(spark, sf_dir)["modified_rdb"])


@register("filter_non_blank", O.with_ctes(
    "SELECT * FROM modified_rdb WHERE \"Report ID\" IS NOT NULL AND trim(\"Report ID\", ' ') <> ''"))
def q_filter_non_blank(spark, sf_dir):
    return FL.filter_non_blank(tables(spark, sf_dir)["modified_rdb"], "Report ID")


@register("trim_blank", O.with_ctes(
    "SELECT \"Report ID\", \"Report ID\" IS NULL OR trim(\"Report ID\", ' ') = '' AS blank "
    "FROM dsr2rdb"))
def q_trim_blank(spark, sf_dir):
    d = tables(spark, sf_dir)["dsr2rdb"]
    return d.select(c("Report ID"), is_blank(c("Report ID")).alias("blank"))


# ----------------------------------------------------------------- drill-down

def _drill_sql_pred(metric: str) -> str:
    sel = O.in_list(PICK_STAGES)
    ps, cs, st = '"Previous Status Stage"', '"Current Status Stage"', '"Stage"'

    def isin(x):
        return f"coalesce({x} IN {sel}, false)"
    ex = "\"Flag\" IS NOT DISTINCT FROM 'Existing'"
    closed = f"{cs} IS NOT DISTINCT FROM {O.s(G.CLOSED_STAGE)}"
    return {
        "OB": f"{isin(ps)} AND {ex}",
        "Added-New": f"{isin(ps)} AND \"Flag\" IS NOT DISTINCT FROM 'New'",
        "Added-Old": f"{ex} AND {isin(cs)} AND NOT {isin(ps)}",
        "Moved": f"{ex} AND {isin(ps)} AND NOT {isin(cs)} AND NOT ({closed})",
        "Dropped": f"{isin(ps)} AND {closed}",
        "CB": f"{isin(st)} AND {ex}",
    }[metric]


_DRILL_SQL = " UNION ".join(
    f"SELECT DISTINCT '{m}' AS metric, \"Potential No.\" FROM {SRL} "
    f"WHERE \"Potential No.\" IS NOT NULL AND {_drill_sql_pred(m)}" for m in G.DRILL_METRICS)


@register("drill_down", O.with_ctes(_DRILL_SQL))
def q_drill_down(spark, sf_dir):
    return G.drill_down_by_metric(_srl(spark, sf_dir), PICK_STAGES)


_UNION_KEYS_SQL = (f"SELECT DISTINCT \"Potential No.\" FROM {SRL} WHERE \"Potential No.\" IS NOT NULL "
                   f"AND (({_drill_sql_pred('Moved')}) OR ({_drill_sql_pred('Dropped')}) "
                   f"OR ({_drill_sql_pred('Added-Old')}))")


@register("set_union_keys", O.with_ctes(_UNION_KEYS_SQL))
def q_set_union_keys(spark, sf_dir):
    return G.drill_down(_srl(spark, sf_dir), PICK_STAGES, ["Moved", "Dropped", "Added-Old"])


def _cb_keys(spark, sf_dir):
    return G.drill_down(_srl(spark, sf_dir), PICK_STAGES, ["CB"])


# the drilled stage and the flag are the snapshot's own, so the oracle needs no status rule
_CB_KEYS_SQL = (f"SELECT DISTINCT \"Potential No.\" AS dk FROM srl0 "
                f"WHERE \"Potential No.\" IS NOT NULL AND {_drill_sql_pred('CB')}")



@register("keys_semi_filter", O.with_ctes(
    f"SELECT * FROM modified_rdb WHERE \"Potential No.\" IN ({_CB_KEYS_SQL}) ORDER BY ALL"))
def q_keys_semi_filter(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = _cb_keys(spark, sf_dir)
    return t["modified_rdb"].join(keys.select(c(KEY).alias("_sk")),
                                  c(KEY) == F.col("_sk"), "left_semi")


@register("filter_in_keys_blank_report", O.with_ctes(
    f"SELECT * FROM modified_rdb WHERE \"Potential No.\" IN ({_CB_KEYS_SQL}) "
    "AND (\"Report ID\" IS NULL OR trim(\"Report ID\", ' ') = '') ORDER BY ALL"))
def q_filter_in_keys_blank_report(spark, sf_dir):
    return FL.filter_in_keys_blank_report(tables(spark, sf_dir)["modified_rdb"],
                                          _cb_keys(spark, sf_dir))


MODIFIED_COLUMNS = {
    "Potential No.", "Potential Code", "Potential Owner", "Executive", "Company Name",
    "Stage", "Created Date", "Last Contact Date", "Next Followup Date", "Closing Date",
    "Category", "Report ID", "Description (Potential Details)", "Modified Date", "Region",
    "State/UT", "Original Stage", "New Stage", "Contacted Date", "DSR Type"}
_DRILL_PRESENT = [n for n in DRILL_COLUMNS if n in MODIFIED_COLUMNS]


@register("scan_available_columns", O.with_ctes(
    "SELECT " + ", ".join(O.qi(n) for n in _DRILL_PRESENT) + " FROM modified_rdb"))
def q_scan_available_columns(spark, sf_dir):
    return RD.scan_available_columns(tables(spark, sf_dir)["modified_rdb"], DRILL_COLUMNS)


_BM_LOG = """bm_log AS (
  SELECT CAST(user_id AS VARCHAR) AS "user",
         CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) AS VARCHAR) AS potential_no,
         ts, CASE WHEN event_type = 'click' THEN 'add' ELSE 'remove' END AS action,
         event_id AS seq
  FROM events WHERE event_type IN ('click', 'error')),
bm_state AS (
  SELECT a."user", a.potential_no, a.ts AS "timestamp", a.seq FROM bm_log a
  WHERE a.action = 'add' AND a."user" IS NOT NULL AND a.potential_no IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM bm_log r WHERE r.action = 'remove' AND r."user" = a."user"
                    AND r.potential_no = a.potential_no
                    AND (r.ts > a.ts OR (r.ts = a.ts AND r.seq > a.seq))))"""


def _drill_details_sql():
    keep = [n for n in _DRILL_PRESENT if n not in
            ("Report ID", "Description (Potential Details)", "Modified Date", "Region",
             "Campaign Source", "Lead Source")]
    dates = ("Created Date", "Last Contact Date", "Next Followup Date", "Enquiry Date",
             "Closing Date")
    sel = ", ".join(f"CAST(x.{O.qi(n)} AS DATE) AS {O.qi(n)}" if n in dates else f"x.{O.qi(n)}"
                    for n in keep)
    return f""", {_BM_LOG},
drows AS (SELECT * FROM modified_rdb WHERE "Potential No." IN ({_CB_KEYS_SQL})
          AND ("Report ID" IS NULL OR trim("Report ID", ' ') = '')),
dlat AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Potential No."
           ORDER BY "Modified Date" DESC NULLS LAST, _seq DESC NULLS LAST, {O.TB_DESC}) AS rn
         FROM drows) WHERE rn = 1)
SELECT {sel}, x."Potential No." IN (SELECT potential_no FROM bm_state WHERE "user" = {O.s(BM_USER)}) AS "BM"
FROM dlat x"""


@register("drill_down_details", O.with_ctes(_drill_details_sql()))
def q_drill_down_details(spark, sf_dir):
    t = tables(spark, sf_dir)
    bm = LG.bookmark_state(dv.bookmark_log(spark, sf_dir))
    return LK.drill_down_details(t["modified_rdb"], _cb_keys(spark, sf_dir), bm, BM_USER,
                                 tiebreak=dv.MERGED_TIEBREAK)


@register("bookmark_flag", O.with_ctes(
    f", {_BM_LOG}\nSELECT \"Potential No.\", \"Potential No.\" IN (SELECT potential_no FROM bm_state "
    f"WHERE \"user\" = {O.s(BM_USER)}) AS \"BM\" FROM {SRL}"))
def q_bookmark_flag(spark, sf_dir):
    bm = LG.bookmark_state(dv.bookmark_log(spark, sf_dir))
    return LK.bookmark_flag(_srl(spark, sf_dir).select(c(KEY)), bm, BM_USER)


@register("bookmark_state", O.with_ctes(f", {_BM_LOG}\nSELECT * FROM bm_state"))
def q_bookmark_state(spark, sf_dir):
    return LG.bookmark_state(dv.bookmark_log(spark, sf_dir))


# --------------------------------------------------------------- detail lookups

_DETAIL_FIELDS = [n for _, g in DETAIL_GROUPS for n in g]
_DETAIL_PRESENT = [n for n in _DETAIL_FIELDS if n in MODIFIED_COLUMNS]
_DETAIL_DATES = ("Enquiry Date", "Created Date", "Modified Date", "Next Followup Date",
                 "Closing Date", "Last Contact Date")


def _latest_main_sql(src_filter: str = "") -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "Potential No."
           ORDER BY "Modified Date" DESC NULLS LAST, _seq DESC NULLS LAST) AS rn
         FROM modified_rdb WHERE "DSR Type" IS NULL {src_filter}) WHERE rn = 1"""


def _details_select(alias="x"):
    return ", ".join([f'{alias}."Potential No."'] + [
        f"CAST({alias}.{O.qi(n)} AS DATE) AS {O.qi(n)}" if n in _DETAIL_DATES
        else f"{alias}.{O.qi(n)}" for n in _DETAIL_PRESENT])


_READ_PRESENT = [n for n in ("Potential No.", "Potential Code", "Potential Owner",
                             "Billing City", "Executive", "Region", "Campaign Source",
                             "Lead Source", "Stage", "Probability (%)", "Full Name", "Mobile",
                             "Email", "Category", "Enquiry Date", "Created Date",
                             "Modified Date", "Next Followup Date", "Closing Date",
                             "Last Contact Date", "DSR Type") if n in MODIFIED_COLUMNS]


@register("latest_details", O.with_ctes(
    "SELECT " + ", ".join(O.qi(n) for n in _READ_PRESENT + ["_seq"]) +
    " FROM (" + _latest_main_sql() + ")"))
def q_latest_details(spark, sf_dir):
    return LK.latest_details(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.MAIN_TIEBREAK)


@register("latest_per_key", O.with_ctes(
    "SELECT " + ", ".join(O.qi(n) for n in _READ_PRESENT + ["_seq"]) +
    " FROM (" + _latest_main_sql() + ")"))
def q_latest_per_key(spark, sf_dir):
    main = FL.filter_is_main(tables(spark, sf_dir)["modified_rdb"])
    return RK.latest_per_key(main.select(*[c(n) for n in _READ_PRESENT + ["_seq"]]), tiebreak=dv.MAIN_TIEBREAK)


@register("potential_details", O.with_ctes(f"SELECT {_details_select()} FROM ({_latest_main_sql()}) x"))
def q_potential_details(spark, sf_dir):
    return LK.potential_details(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.MAIN_TIEBREAK)


@register("potential_details_projection", O.with_ctes(
    f"SELECT {_details_select()} FROM ({_latest_main_sql()}) x"))
def q_potential_details_projection(spark, sf_dir):
    return LK.potential_details(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.MAIN_TIEBREAK)


_HIST_SQL = """SELECT "Potential No.", "Created Date", "Original Stage", "New Stage", "Closing Date",
       "Description (Potential Details)" AS "Description"
FROM modified_rdb WHERE "DSR Type" IS NOT NULL"""


@register("stage_history", O.with_ctes(_HIST_SQL))
def q_stage_history(spark, sf_dir):
    return LK.stage_history(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.DSR_TIEBREAK)


@register("history_order", O.with_ctes(_HIST_SQL))
def q_history_order(spark, sf_dir):
    return LK.stage_history(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.DSR_TIEBREAK)


_FIND_KEYS = (f"SELECT DISTINCT \"Potential No.\" FROM p2rdb WHERE \"Company Name\" = {O.s(COMPANY)} "
              "AND trim(\"Potential No.\", ' ') <> ''")


@register("find_potential", O.with_ctes(
    f"SELECT {_details_select()} FROM ({_latest_main_sql(chr(10) + 'AND ' + chr(34) + 'Potential No.' + chr(34) + ' IN (' + _FIND_KEYS + ')')}) x"))
def q_find_potential(spark, sf_dir):
    t = tables(spark, sf_dir)
    det, _ = LK.find_potential(t["sales_reporting_logic"], t["modified_rdb"], STATE, COMPANY,
                               tiebreak=dv.MAIN_TIEBREAK)
    return det


@register("find_potential_history", O.with_ctes(
    _HIST_SQL + f" AND \"Potential No.\" IN ({_FIND_KEYS}) ORDER BY ALL"))
def q_find_potential_history(spark, sf_dir):
    t = tables(spark, sf_dir)
    _, hist = LK.find_potential(t["sales_reporting_logic"], t["modified_rdb"], STATE, COMPANY,
                                history_tiebreak=dv.DSR_TIEBREAK)
    return hist


def _facet_sql(target, where=""):
    cond = f"{O.qi(target)} IS NOT NULL AND trim({O.qi(target)}, ' ') <> ''"
    return f"SELECT DISTINCT {O.qi(target)} FROM {SRL} WHERE {cond} {where}"


@register("facet_state", O.with_ctes(_facet_sql("State/UT")))
def q_facet_state(spark, sf_dir):
    return LK.facet(_srl(spark, sf_dir), "State/UT")


@register("facet_cascade", O.with_ctes(_facet_sql("Company Name", f'AND "State/UT" = {O.s(STATE)}')))
def q_facet_cascade(spark, sf_dir):
    return LK.facet_cascade(_srl(spark, sf_dir), state=STATE)["Company Name"]


@register("facet_code", O.with_ctes(_facet_sql("Potential Code", f'AND "Company Name" = {O.s(COMPANY)}')))
def q_facet_code(spark, sf_dir):
    return LK.facet_cascade(_srl(spark, sf_dir), STATE, COMPANY)["Potential Code"]


@register("facet_potential", O.with_ctes(_facet_sql(
    "Potential No.", f'AND "Company Name" = {O.s(COMPANY)} AND "Potential Code" = {O.s(CODE)}')))
def q_facet_potential(spark, sf_dir):
    return LK.facet_cascade(_srl(spark, sf_dir), STATE, COMPANY, CODE)[KEY]


@register("distinct_values", O.with_ctes(
    f'SELECT DISTINCT "Executive" FROM {SRL} WHERE "Executive" IS NOT NULL'))
def q_distinct_values(spark, sf_dir):
    return LK.distinct_values(_srl(spark, sf_dir), "Executive")


@register("bookmarked_details", O.with_ctes(f""", {_BM_LOG},
first AS (SELECT "user", potential_no, "timestamp" AS bookmarked_at FROM (
            SELECT *, row_number() OVER (PARTITION BY "user", potential_no
                                         ORDER BY "timestamp", seq) AS rn FROM bm_state) WHERE rn = 1)
SELECT f."user", f.potential_no, f.bookmarked_at, {_details_select('x').replace('x."Potential No.", ', '')}
FROM first f LEFT JOIN ({_latest_main_sql()}) x ON f.potential_no = x."Potential No.\""""))
def q_bookmarked_details(spark, sf_dir):
    t = tables(spark, sf_dir)
    st = LG.bookmark_state(dv.bookmark_log(spark, sf_dir))
    return LK.bookmarked_details(st, t["modified_rdb"], tiebreak=dv.MAIN_TIEBREAK)


# ------------------------------------------------------------------ log folds

_LOGIN_SQL = """WITH RECURSIVE ev AS (
  SELECT CAST(user_id AS VARCHAR) AS username, ts, event_id AS seq,
         CASE WHEN event_type = 'signup' THEN 'login' ELSE 'logout' END AS action,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events WHERE event_type IN ('signup', 'purchase')),
walk(username, i, stack, login_time, logout_time) AS (
  SELECT DISTINCT username, CAST(0 AS BIGINT), CAST([] AS TIMESTAMP[]), CAST(NULL AS TIMESTAMP),
         CAST(NULL AS TIMESTAMP) FROM ev
  UNION ALL
  SELECT w.username, e.i,
         CASE WHEN e.action = 'login' THEN list_append(w.stack, e.ts)
              WHEN len(w.stack) > 0 THEN w.stack[1:len(w.stack) - 1]
              ELSE w.stack END,
         CASE WHEN e.action = 'logout' AND len(w.stack) > 0 THEN w.stack[len(w.stack)] END,
         CASE WHEN e.action = 'logout' AND len(w.stack) > 0 THEN e.ts END
  FROM walk w JOIN ev e ON e.username = w.username AND e.i = w.i + 1),
last AS (SELECT username, max(i) AS i FROM walk GROUP BY 1)
SELECT username, login_time, logout_time FROM walk WHERE logout_time IS NOT NULL
UNION ALL
SELECT username, unnest(stack) AS login_time, CAST(NULL AS TIMESTAMP) AS logout_time
FROM walk JOIN last USING (username, i)"""


@register("login_sessions", _LOGIN_SQL)
def q_login_sessions(spark, sf_dir):
    return LG.login_sessions(dv.login_log(spark, sf_dir))


# ---------------------------------------------------------- periods / scalars

_DATES_SQL = "dates AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS as_of FROM orders)"


def _dates(spark, sf_dir):
    return (dv.read_table(spark, sf_dir, "orders")
            .select(F.to_date("o_orderdate").alias("as_of")).distinct())


def _duck_period(criterion):
    d = "as_of"
    ls = f"({d} - CAST(dayofweek({d}) AS INTEGER))"
    fy = (f"make_date(CASE WHEN month({d}) >= 4 THEN year({d}) ELSE year({d}) - 1 END, 4, 1)")
    qs = f"CAST(date_trunc('quarter', {d}) AS DATE)"
    ms = f"CAST(date_trunc('month', {d}) AS DATE)"
    if criterion == PD.LAST_WEEK:
        s, e = f"({ls} - 7)", ls
    elif criterion == PD.CURRENT_WEEK:
        s, e = ls, f"({ls} + 7)"
    elif criterion == PD.CURRENT_MONTH:
        s, e = ms, f"CAST(last_day({d}) AS DATE)"
    elif criterion == PD.LAST_MONTH:
        s, e = f"CAST(date_trunc('month', {d} - INTERVAL 1 MONTH) AS DATE)", f"({ms} - 1)"
    elif criterion == PD.CURRENT_QUARTER:
        s, e = qs, f"CAST({qs} + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"
    else:
        s, e = fy, f"CAST({fy} + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE)"
    if criterion in (PD.LAST_WEEK, PD.CURRENT_WEEK):
        lab = f"'{criterion}: ' || strftime({s}, '%Y-%m-%d') || ' to ' || strftime({e}, '%Y-%m-%d')"
    elif criterion in (PD.CURRENT_MONTH, PD.LAST_MONTH):
        lab = f"'{criterion}: ' || strftime({s}, '%B %Y')"
    elif criterion == PD.CURRENT_QUARTER:
        lab = (f"'Current Quarter: Q' || CAST(quarter({d}) AS VARCHAR) || ' (' || strftime({s}, '%B') "
               f"|| ' - ' || strftime({s} + INTERVAL 2 MONTH, '%B') || ') ' || CAST(year({d}) AS VARCHAR)")
    else:
        lab = (f"'Current Financial Year: ' || CAST(year({s}) AS VARCHAR) || '-' || "
               f"CAST(year({s}) + 1 AS VARCHAR)")
    return s, e, lab


def _period_cols_spark(criterion, prefix):
    d = F.col("as_of")
    return [PD.period_start_col(criterion, d).alias(f"{prefix}_start"),
            PD.period_end_col(criterion, d).alias(f"{prefix}_end")]


def _period_cols_sql(criterion, prefix):
    s, e, _ = _duck_period(criterion)
    return f"{s} AS {prefix}_start, {e} AS {prefix}_end"


def _register_window(name, pairs):
    sql = ("WITH " + _DATES_SQL + " SELECT as_of, " +
           ", ".join(_period_cols_sql(cr, p) for cr, p in pairs) + " FROM dates")

    @register(name, sql)
    def _q(spark, sf_dir):
        cols = [x for cr, p in pairs for x in _period_cols_spark(cr, p)]
        return _dates(spark, sf_dir).select("as_of", *cols)
    return _q


_register_window("week_window", [(PD.LAST_WEEK, "last_week"), (PD.CURRENT_WEEK, "current_week")])
_register_window("month_window", [(PD.CURRENT_MONTH, "current_month"), (PD.LAST_MONTH, "last_month")])
_register_window("quarter_window", [(PD.CURRENT_QUARTER, "current_quarter")])
_register_window("fiscal_year_window", [(PD.CURRENT_FY, "current_fy")])


def _bounds_sql():
    parts = []
    for cr in PD.CALENDAR_CRITERIA:
        s, e, lab = _duck_period(cr)
        parts.append(f"SELECT as_of, '{cr}' AS period, {s} AS start_date, {e} AS end_date, "
                     f"{lab} AS label FROM dates")
    return "WITH " + _DATES_SQL + " " + " UNION ALL ".join(parts)


def _bounds(spark, sf_dir):
    d = F.col("as_of")
    arr = F.array(*[F.struct(F.lit(cr).alias("period"),
                             PD.period_start_col(cr, d).alias("start_date"),
                             PD.period_end_col(cr, d).alias("end_date"),
                             PD.period_label_col(cr, d).alias("label"))
                    for cr in PD.CALENDAR_CRITERIA])
    return _dates(spark, sf_dir).select("as_of", F.inline(arr))


@register("period_bounds", _bounds_sql())
def q_period_bounds(spark, sf_dir):
    return _bounds(spark, sf_dir)


_LABEL_SQL = "WITH " + _DATES_SQL + " " + " UNION ALL ".join(
    f"SELECT as_of, '{cr}' AS period, {_duck_period(cr)[2]} AS label FROM dates"
    for cr in PD.CALENDAR_CRITERIA)


@register("period_label", _LABEL_SQL)
def q_period_label(spark, sf_dir):
    return _bounds(spark, sf_dir).select("as_of", "period", "label")


@register("period_label_custom", "WITH " + _DATES_SQL +
          " SELECT as_of, 'From: ' || strftime(as_of - 10, '%Y-%m-%d') || ' To: ' || strftime(as_of, '%Y-%m-%d') "
          "AS label FROM dates")
def q_period_label_custom(spark, sf_dir):
    d = F.col("as_of")
    return _dates(spark, sf_dir).select("as_of", PD.period_label_col(PD.CUSTOM, d, F.date_sub(d, 10), d).alias("label"))


@register("format_date", O.with_ctes(
    f"SELECT \"Potential No.\", strftime(\"Modified Date\", '%Y-%m-%d') AS modified_ymd, "
    f"strftime(\"Modified Date\", '%d/%m/%Y') AS modified_dmy FROM {SRL}"))
def q_format_date(spark, sf_dir):
    srl = _srl(spark, sf_dir)
    return srl.select(c(KEY), format_date(c("Modified Date")).alias("modified_ymd"),
                      format_date(c("Modified Date"), "dd/MM/yyyy").alias("modified_dmy"))


@register("ist_now", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S') "
                     "AS ist FROM events")
def q_ist_now(spark, sf_dir):
    ev = dv.read_table(spark, sf_dir, "events")
    return ev.select("event_id", ist_stamp(F.col("ts")).alias("ist"))


@register("stage_number", O.with_ctes(O.grid_sql(SRL) + (
    "\nSELECT sname AS \"Stage Name\", TRY_CAST(NULLIF(regexp_extract(sname, '^([0-9]+)', 1), '') "
    "AS INTEGER) AS stage_number FROM uni")))
def q_stage_number(spark, sf_dir):
    u = G.stage_universe(_srl(spark, sf_dir))
    return u.select("Stage Name", stage_number(F.col("Stage Name")).alias("stage_number"))


def _sheet_sql(e, cut=""):
    d = f"substring(regexp_replace({e}, '[^0-9]+', '', 'g'), 1{cut})"
    return f"CASE WHEN {d} = '' THEN 'Sheet1' ELSE {d} END"


@register("digits_only", O.with_ctes(
    f"SELECT DISTINCT \"Company Name\", {_sheet_sql(chr(34) + 'Company Name' + chr(34), ', 31')} AS sheet "
    f"FROM {SRL}"))
def q_digits_only(spark, sf_dir):
    srl = _srl(spark, sf_dir)
    return srl.select(c("Company Name"), digits_only(c("Company Name"), 31).alias("sheet")).distinct()


# ------------------------------------------------------------------- sources

_P2_TEXT_COLS = ["Potential No.", "Potential Code", "Company Name (Company Name)", "State/UT",
                 "Region", "Sales handled by", "Category", "Potential Owner", "Stage",
                 "Created Time", "Modified Time", "Closing Date", "Last Contact Date",
                 "Next Followup Date"]


@register("scan_csv", O.with_ctes("SELECT " + ", ".join(O.qi(n) for n in _P2_TEXT_COLS) +
                                  " FROM v_p2"))
def q_scan_csv(spark, sf_dir):
    src = dv.p2(spark, sf_dir).select(*[c(n) for n in _P2_TEXT_COLS])
    path = WR.write_table(src, WR.shared_dir(spark), "p2_export", "csv")
    return RD.scan_csv(spark, path)


_DSR_TEXT_COLS = ["Potential No.", "Sales Person Name", "Original Stage", "New Stage",
                  "Contacted Date", "Mode of Contact (DSR)", "Mode of Contact", "Report ID"]


@register("normalize_nulls", O.with_ctes(
    "SELECT " + ", ".join(
        f"CASE WHEN {O.qi(n)} IN {O.in_list(RD.CSV_NULL_TOKENS)} THEN NULL ELSE {O.qi(n)} END "
        f"AS {O.qi(n)}" for n in _DSR_TEXT_COLS) + " FROM v_dsr2"))
def q_normalize_nulls(spark, sf_dir):
    return RD.normalize_nulls(dv.dsr2(spark, sf_dir).select(*[c(n) for n in _DSR_TEXT_COLS]))


@register("write_table", O.with_ctes(f"SELECT * FROM {SRL}"))
def q_write_table(spark, sf_dir):
    path = WR.write_table(_srl(spark, sf_dir), WR.shared_dir(spark), "sales_reporting_logic")
    return spark.read.parquet(path)


@register("scan_table_all", O.with_ctes(f"SELECT * REPLACE ('Existing' AS \"Flag\") FROM {SRL}"))
def q_scan_table_all(spark, sf_dir):
    srl = _srl(spark, sf_dir).drop("Flag")
    path = WR.write_table(srl, WR.shared_dir(spark), "srl_without_flag")
    return RD.scan_table_all(spark, path)


@register("report_export", O.with_ctes(O.grid_sql(SRL) + O.finish_grid_sql("grid")))
def q_report_export(spark, sf_dir):
    grid = G.finish_grid(G.stage_movement_grid(_srl(spark, sf_dir)))
    paths = WR.report_export(grid, WR.shared_dir(spark), "grid_table_form1", {})
    return spark.read.parquet(paths["report"])


@register("report_export_filters", O.with_ctes(O.grid_sql(SRL) + O.finish_grid_sql("grid").replace(
    "SELECT * EXCLUDE (is_total) FROM g3",
    "SELECT * EXCLUDE (is_total), 'Column=CB; Stage Name(s)=80 - Final Quote' AS selected FROM g3")))
def q_report_export_filters(spark, sf_dir):
    """An exported report read back, every row with the filter block that was written beside it."""
    grid = G.finish_grid(G.stage_movement_grid(_srl(spark, sf_dir)))
    paths = WR.report_export(grid, WR.shared_dir(spark), "drill_down",
                             {"Stage Name(s)": "80 - Final Quote", "Column": "CB"},
                             names=("Stage Name(s)", "Column"))
    pairs = F.sort_array(F.collect_list(F.concat_ws("=", "Filters", "Selected")))
    block = spark.read.parquet(paths["filters"]).agg(F.concat_ws("; ", pairs).alias("s")).scalar()
    return spark.read.parquet(paths["report"]).withColumn("selected", block)


@register("details_and_history_export_history", O.with_ctes(
    "SELECT \"Potential No.\", CAST(\"Created Date\" AS DATE) AS \"Created Date\", "
    "\"Original Stage\", \"New Stage\", CAST(\"Closing Date\" AS DATE) AS \"Closing Date\", "
    "\"Description (Potential Details)\" AS \"Description\" FROM modified_rdb "
    f"WHERE \"DSR Type\" IS NOT NULL AND \"Potential No.\" IN ({_CB_KEYS_SQL}) ORDER BY ALL"))
def q_details_and_history_export_history(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = _cb_keys(spark, sf_dir)
    det = LK.potential_details(t["modified_rdb"], keys, tiebreak=dv.MAIN_TIEBREAK)
    hist = LK.history_for_export(t["modified_rdb"], keys, tiebreak=dv.DSR_TIEBREAK)
    return spark.read.parquet(WR.details_and_history_export(det, hist, WR.shared_dir(spark))["history"])


@register("bookmarked_history", O.with_ctes(f""", {_BM_LOG}
SELECT DISTINCT ON (b."user", m.rid) b."user", m."Potential No.", m."Created Date", m."Original Stage",
       m."New Stage", m."Closing Date", m."Description"
FROM bm_state b JOIN (SELECT *, row_number() OVER () AS rid FROM (
  SELECT "Potential No.", CAST("Created Date" AS DATE) AS "Created Date", "Original Stage", "New Stage",
         CAST("Closing Date" AS DATE) AS "Closing Date", "Description (Potential Details)" AS "Description"
  FROM modified_rdb WHERE "DSR Type" IS NOT NULL)) m ON b.potential_no = m."Potential No.\""""))
def q_bookmarked_history(spark, sf_dir):
    st = LG.bookmark_state(dv.bookmark_log(spark, sf_dir))
    return LK.bookmarked_history(st, tables(spark, sf_dir)["modified_rdb"])


@register("history_export_by_key", O.with_ctes(
    f"SELECT *, {_sheet_sql(chr(34) + 'Potential No.' + chr(34))} AS sheet FROM ("
    "SELECT \"Potential No.\", CAST(\"Created Date\" AS DATE) AS \"Created Date\", "
    "\"Original Stage\", \"New Stage\", CAST(\"Closing Date\" AS DATE) AS \"Closing Date\", "
    "\"Description (Potential Details)\" AS \"Description\" FROM modified_rdb "
    f"WHERE \"DSR Type\" IS NOT NULL AND \"Potential No.\" IN ({_CB_KEYS_SQL})) ORDER BY ALL"))
def q_history_export_by_key(spark, sf_dir):
    t = tables(spark, sf_dir)
    hist = LK.history_for_export(t["modified_rdb"], _cb_keys(spark, sf_dir),
                                 tiebreak=dv.DSR_TIEBREAK)
    path = WR.history_export_by_key(hist, WR.shared_dir(spark))
    return spark.read.parquet(path)


@register("details_and_history_export", O.with_ctes(
    f"SELECT {_details_select()} FROM ({_latest_main_sql(' AND ' + chr(34) + 'Potential No.' + chr(34) + ' IN (' + _CB_KEYS_SQL + ')')}) x"))
def q_details_and_history_export(spark, sf_dir):
    t = tables(spark, sf_dir)
    keys = _cb_keys(spark, sf_dir)
    det = LK.potential_details(t["modified_rdb"], keys, tiebreak=dv.MAIN_TIEBREAK)
    hist = LK.history_for_export(t["modified_rdb"], keys, tiebreak=dv.DSR_TIEBREAK)
    paths = WR.details_and_history_export(det, hist, WR.shared_dir(spark))
    return spark.read.parquet(paths["details"])


def _width_sql():
    cols = ["Potential No."] + _DETAIL_PRESENT
    parts = []
    for i, n in enumerate(cols):
        parts.append(f"SELECT {O.s(n)} AS \"column\", CAST({i} AS BIGINT) AS position, "
                     f"CAST(least(coalesce(max(length(CAST({O.qi(n)} AS VARCHAR))), 0) + 2, 50) "
                     f"AS BIGINT) AS width FROM pd")
    return (f", pd AS (SELECT {_details_select()} FROM ({_latest_main_sql()}) x)\n" +
            " UNION ALL ".join(parts))


@register("column_width_profile", O.with_ctes(_width_sql()))
def q_column_width_profile(spark, sf_dir):
    det = LK.potential_details(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.MAIN_TIEBREAK)
    return WR.column_width_profile(det)

