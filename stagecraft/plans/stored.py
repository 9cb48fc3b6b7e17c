"""Registrations over stored forms of the tables: layouts found per column, load order over files,
loads by date, buckets, as-of carry, clustered files, all pickers at once, numbered rows and logs
folded day by day.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import oracle as O
from ..columns import DETAIL_GROUPS, KEY, SRL_DATE_COLUMNS, c
from ..operators import asof as AO
from ..operators import filters as FL
from ..operators import grid as G
from ..operators import layouts as LY
from ..operators import logs as LG
from ..operators import lookup as LK
from ..operators import sequences as SQ
from ..operators.ranking import dedupe_keep_first
from ..registry import PARAMS, register, stored_inputs, tables
from ..sources import clustered as CL
from ..sources import derived as dv
from ..sources import loads as LD
from ..sources import ordered as OD
from ..sources import readers as RD
from ..sources import writers as WR
from . import bucketed as BK
from . import build as B
from . import reports as R

SRL = R.SRL

# ------------------------------------------------------------ P3: a layout per column

_LAYOUT_COLUMNS = ["Day First", "Month First", "Year First", "Year Day Month"]
_LAYOUT_SQL = """WITH shown AS (
  SELECT o_orderkey AS _seq, o_orderdate AS od,
         date_trunc('month', o_orderdate) + to_days(CAST(13 + o_orderkey % 15 AS INTEGER)) AS late,
         date_trunc('month', o_orderdate) + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS early
  FROM orders),
texts AS (
  SELECT _seq, unnest(['Day First', 'Month First', 'Year First', 'Year Day Month']) AS "column",
         unnest([CASE WHEN _seq % 7 = 1 THEN NULL WHEN _seq % 13 = 5 THEN strftime(od, '%Y-%m-%d %H:%M')
                      ELSE strftime(od, '%d/%m/%Y %H:%M') END,
                 CASE WHEN _seq % 17 = 3 THEN strftime(late, '%d/%m/%Y') ELSE strftime(late, '%m/%d/%Y') END,
                 CASE WHEN _seq % 11 = 2 THEN '' ELSE strftime(late, '%Y-%m-%d') END,
                 strftime(early, '%Y-%m-%d')]) AS t
  FROM shown),
firsts AS (SELECT "column", arg_min(t, _seq) FILTER (WHERE t IS NOT NULL) AS first_text FROM texts GROUP BY 1),
parts AS (
  SELECT *, first_text LIKE '____-%' AS year_first,
         CAST(CASE WHEN first_text LIKE '____-%' THEN substr(first_text, 6, 2) ELSE substr(first_text, 1, 2) END AS INT) AS a,
         CAST(CASE WHEN first_text LIKE '____-%' THEN substr(first_text, 9, 2) ELSE substr(first_text, 4, 2) END AS INT) AS b,
         CASE WHEN length(first_text) > 10 THEN ' H:mm' ELSE '' END AS clock
  FROM firsts),
layouts AS (
  SELECT "column", first_text,
         CASE WHEN year_first AND b <= 12 THEN 'yyyy-d-M' WHEN year_first THEN 'yyyy-M-d'
              WHEN b <= 12 THEN 'd/M/yyyy' ELSE 'M/d/yyyy' END || clock AS layout
  FROM parts),
fits AS (
  SELECT t."column", t.t, CASE layout WHEN 'd/M/yyyy H:mm' THEN try_strptime(t.t, '%d/%m/%Y %H:%M')
         WHEN 'M/d/yyyy H:mm' THEN try_strptime(t.t, '%m/%d/%Y %H:%M') WHEN 'd/M/yyyy' THEN try_strptime(t.t, '%d/%m/%Y')
         WHEN 'M/d/yyyy' THEN try_strptime(t.t, '%m/%d/%Y') WHEN 'yyyy-d-M' THEN try_strptime(t.t, '%Y-%d-%m')
         WHEN 'yyyy-M-d' THEN try_strptime(t.t, '%Y-%m-%d') END AS p
  FROM texts t JOIN layouts USING ("column"))
SELECT "column", first_text, layout, count(p) AS parsed, count(*) FILTER (WHERE t IS NOT NULL AND p IS NULL) AS refused
FROM layouts JOIN fits USING ("column") GROUP BY ALL"""


def _layout_texts(spark, sf_dir):
    """Four columns of order dates as text, each with some values of another layout."""
    o = dv.read_table(spark, sf_dir, "orders")
    k, od = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
    month = F.trunc(od, "MM")
    late = F.date_add(month, (13 + k % 15).cast("int"))
    early = F.date_add(month, (k % 9).cast("int"))
    return o.select(
        k.alias("_seq"),
        F.when(k % 7 == 1, F.lit(None).cast("string")).when(k % 13 == 5, F.date_format(od, "yyyy-MM-dd HH:mm"))
        .otherwise(F.date_format(od, "dd/MM/yyyy HH:mm")).alias("Day First"),
        F.when(k % 17 == 3, F.date_format(late, "dd/MM/yyyy")).otherwise(F.date_format(late, "MM/dd/yyyy"))
        .alias("Month First"),
        F.when(k % 11 == 2, F.lit("")).otherwise(F.date_format(late, "yyyy-MM-dd")).alias("Year First"),
        F.date_format(early, "yyyy-MM-dd").alias("Year Day Month"))


@register("date_layouts", _LAYOUT_SQL)
def q_date_layouts(spark, sf_dir):
    return LY.layout_report(_layout_texts(spark, sf_dir), _LAYOUT_COLUMNS)


# ------------------------------------------------------- S1 with line breaks, T3 load order

_EXPORT_SQL = """SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                                l_shipdate) - 1 AS _seq,
       CAST(l_orderkey AS VARCHAR) AS "Potential No.",
       'line ' || CAST(l_linenumber AS VARCHAR) || chr(10) || 'said "' || CAST(l_partkey AS VARCHAR) || '", twice' AS "Description"
FROM lineitem"""


_EXPORT_ROWS = 250_000  # rows a file


def _exported(spark, sf_dir):
    """The line items as an export of several files whose text column holds line breaks and quotes.

    One task reads a file with line breaks, so there are more files with more rows.
    """
    li = dv.read_table(spark, sf_dir, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // _EXPORT_ROWS))
    rows = li.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
        F.col("l_orderkey").cast("string").alias("Potential No."),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit('\nsaid "'),
                 F.col("l_partkey").cast("string"), F.lit('", twice')).alias("Description"))
    folder = WR.shared_dir(spark)
    rows.write.option("header", True).option("escape", '"').csv(folder)
    return folder


@register("scan_csv_line_breaks", f'SELECT "Potential No.", "Description" FROM ({_EXPORT_SQL}) e')
def q_scan_csv_line_breaks(spark, sf_dir):
    return RD.scan_csv(spark, _exported(spark, sf_dir))


@register("load_order_over_files", _EXPORT_SQL)
def q_load_order_over_files(spark, sf_dir):
    return OD.number_by_file(RD.scan_csv(spark, _exported(spark, sf_dir)))


@register("dedupe_first_over_files", f"""SELECT * FROM ({_EXPORT_SQL}) e
QUALIFY row_number() OVER (PARTITION BY "Potential No." ORDER BY _seq) = 1""")
def q_dedupe_first_over_files(spark, sf_dir):
    return dedupe_keep_first(OD.number_by_file(RD.scan_csv(spark, _exported(spark, sf_dir))))


# ------------------------------------------------------------- Q3 / S3: loads by date

@register("dated_loads", O.with_ctes("SELECT * FROM modified_rdb ORDER BY ALL"))
def q_dated_loads(spark, sf_dir):
    t = tables(spark, sf_dir)
    path = WR.shared_dir(spark)
    LD.merge_load(t["p1rdb"], t["dsr1rdb"], path, "2000-01-01", first=True)
    for _ in range(2):  # the second time it replaces its own rows
        LD.merge_load(t["p2rdb_deduped"], t["dsr2rdb"], path, "2000-01-08")
    return LD.read_loads(spark, path).drop(LD.LOAD_DATE)


@register("dated_load_counts", O.with_ctes("""SELECT DATE '2000-01-01' AS load_date, count(*) AS n FROM main_rdb
UNION ALL SELECT DATE '2000-01-08', count(*) FROM weekly_rdb"""))
def q_dated_load_counts(spark, sf_dir):
    t = tables(spark, sf_dir)
    path = WR.shared_dir(spark)
    LD.merge_load(t["p1rdb"], t["dsr1rdb"], path, "2000-01-01", first=True)
    for _ in range(2):
        LD.merge_load(t["p2rdb_deduped"], t["dsr2rdb"], path, "2000-01-08")
    return LD.read_loads(spark, path).groupBy(LD.LOAD_DATE).agg(F.count(F.lit(1)).alias("n"))


def _two_loads(spark, sf_dir):
    """The build as two dated loads of the raw inputs, the second run twice."""
    raw, out = stored_inputs(spark, sf_dir), WR.shared_dir(spark)
    B.run_load({"p": raw["p1"], "dsr": raw["dsr1"]}, PARAMS, out, "2000-01-01", by_key=True)
    for _ in range(2):
        done = B.run_load({"p": raw["p2"], "dsr": raw["dsr2"]}, PARAMS, out, "2000-01-08", by_key=True)
    return done


@register("dated_build_merged", O.with_ctes("SELECT * FROM modified_rdb ORDER BY ALL"))
def q_dated_build_merged(spark, sf_dir):
    return _two_loads(spark, sf_dir)[B.MERGED].drop(LD.LOAD_DATE)


@register("dated_build_status", O.with_ctes(f"SELECT * FROM {SRL}"))
def q_dated_build_status(spark, sf_dir):
    return _two_loads(spark, sf_dir)[B.STATUS]


# ------------------------------------------------------------------ W6 over buckets

@register("sales_reporting_bucketed", O.with_ctes(f"SELECT * FROM {SRL}"))
def q_sales_reporting_bucketed(spark, sf_dir):
    t = tables(spark, sf_dir)
    return BK.sales_reporting_bucketed(BK.bucket_inputs(
        t["p2rdb_deduped"], t["p1rdb"], t["dsr2rdb"], t["modified_rdb"],
        dsr_tiebreak=PARAMS.dsr_tiebreak, main_tiebreak=PARAMS.main_tiebreak))


# ------------------------------------------------------------------- J5 carried forward

@register("activity_asof_carry", O.with_ctes("""
SELECT r."Potential No.", r."Modified Date", b1.nw AS "New Stage", b1.ct AS "Contacted Date",
       b1.fu AS "Next Followup Date", b1.cl AS "Closing Date"
FROM srl0 r LEFT JOIN b1 ON r."Potential No." = b1.pk"""))
def q_activity_asof_carry(spark, sf_dir):
    t = tables(spark, sf_dir)
    left = t["p2rdb_deduped"].select(c(KEY), c("Modified Date"))
    payload = F.struct(c("New Stage"), c("Contacted Date"), c("Next Followup Date"), c("Closing Date"))
    found = AO.asof_before(left, t["dsr2rdb"], KEY, F.to_date(c("Modified Date")), F.to_date(c("Contacted Date")),
                           payload, [c("Contacted Date"), *[c(n) for n in dv.DSR_TIEBREAK]])
    return found.select(c(KEY), c("Modified Date"), "_asof.*")


# --------------------------------------------------------------------- F8 over clustered files

@register("filter_any_date_clustered", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE {R._in_range_sql(SRL_DATE_COLUMNS, R._QLO, R._QHI)}"))
def q_filter_any_date_clustered(spark, sf_dir):
    srl = R._srl(spark, sf_dir)
    path = CL.write_clustered(srl, WR.shared_dir(spark), ["Created Date", "Modified Date"], SRL_DATE_COLUMNS)
    return CL.read_in_range(spark, path, SRL_DATE_COLUMNS, R._QLO, R._QHI)


# ------------------------------------------------------------------- A10 / A11 at once

def _facets_sql():
    lists = [("State/UT", "State/UT", ""), ("Company Name", "Company Name", f'AND "State/UT" = {O.s(R.STATE)}'),
             ("Potential Code", "Potential Code", f'AND "Company Name" = {O.s(R.COMPANY)}'),
             (KEY, KEY, f'AND "Company Name" = {O.s(R.COMPANY)} AND "Potential Code" = {O.s(R.CODE)}')]
    parts = [f"SELECT DISTINCT {O.s(name)} AS facet, {O.qi(col)} AS value FROM srl0 WHERE {O.qi(col)} IS NOT NULL "
             f"AND trim({O.qi(col)}, ' ') <> '' {where}" for name, col, where in lists]
    parts += [f"SELECT DISTINCT {O.s('pick ' + col)}, {O.qi(col)} FROM srl0 WHERE {O.qi(col)} IS NOT NULL"
              for col in ("Region", "Executive", "Potential Code")]
    return " UNION ALL ".join(parts)


@register("facets_at_once", O.with_ctes(_facets_sql()))
def q_facets_at_once(spark, sf_dir):
    return LK.facets_at_once(R._srl(spark, sf_dir), R.STATE, R.COMPANY, R.CODE)


# --------------------------------------------------------------- P15, O1, O2: positions

@register("row_number_details", O.with_ctes(R._drill_details_sql().replace(
    "FROM dlat x", 'row_number() OVER (ORDER BY x."Potential No." NULLS LAST) AS "No." FROM dlat x')
    .replace(') AS "BM"\n', ') AS "BM",\n')))
def q_row_number_details(spark, sf_dir):
    bm = LG.bookmark_state(dv.bookmark_log(spark, sf_dir))
    rows = LK.drill_down_details(tables(spark, sf_dir)["modified_rdb"], R._cb_keys(spark, sf_dir), bm, R.BM_USER,
                                 tiebreak=dv.MERGED_TIEBREAK)
    return SQ.number_rows(rows, [c(KEY).asc_nulls_last()])


_NUMBERED = f"""SELECT "Potential No.", row_number() OVER (PARTITION BY "Potential No." ORDER BY "Created Date" NULLS LAST,
       {", ".join(t + " NULLS LAST" for t in dv.DSR_TIEBREAK)}) AS "No.",
       "Created Date", "Original Stage", "New Stage", "Closing Date", "Description (Potential Details)" AS "Description"
FROM modified_rdb WHERE "DSR Type" IS NOT NULL"""


@register("row_number_history", O.with_ctes(_NUMBERED))
def q_row_number_history(spark, sf_dir):
    return LK.numbered_history(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.DSR_TIEBREAK)


@register("history_positions", O.with_ctes(f"""SELECT row_number() OVER (ORDER BY "Potential No." NULLS LAST,
  "Created Date" NULLS LAST, {", ".join(t + " NULLS LAST" for t in dv.DSR_TIEBREAK)}) AS position,
  "Potential No.", "Created Date", "Description (Potential Details)" AS "Description"
FROM modified_rdb WHERE "DSR Type" IS NOT NULL"""))
def q_history_positions(spark, sf_dir):
    """O2: the written order of the ordered history, read back by file and row."""
    hist = LK.stage_history(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.DSR_TIEBREAK)
    path = WR.write_table(hist, WR.shared_dir(spark), "ordered_history")
    rows = OD.number_by_file(spark.read.parquet(path), "position")
    return rows.select((F.col("position") + 1).alias("position"), c(KEY), c("Created Date"), c("Description"))


@register("stage_positions", O.with_ctes(O.grid_sql(SRL) + f"""
SELECT row_number() OVER (ORDER BY {O.stage_num_sql('"Stage Name"')}, "Stage Name") AS position, "Stage Name" FROM grid"""))
def q_stage_positions(spark, sf_dir):
    """O1: the written order of the sorted stage list, read back by file and row."""
    grid = G.sort_stage_number(G.stage_movement_grid(R._srl(spark, sf_dir)))
    path = WR.write_table(grid, WR.shared_dir(spark), "sorted_stages")
    rows = OD.number_by_file(spark.read.parquet(path), "position")
    return rows.select((F.col("position") + 1).alias("position"), c(G.STAGE_NAME))


# ----------------------------------------------------------------- logs, day by day

def _days(log):
    """The log cut at three moments of its own span: the earlier parts are folded first."""
    lo, hi = log.agg(F.min("ts"), F.max("ts")).first()
    cuts = [lo + (hi - lo) * i / 4 for i in (1, 2, 3)] if lo is not None else []
    bounds = [None, *cuts, None]
    for a, b in zip(bounds, bounds[1:]):
        part = log
        if a is not None:
            part = part.where(F.col("ts") >= F.lit(a).cast("timestamp_ntz"))
        if b is not None:
            part = part.where(F.col("ts") < F.lit(b).cast("timestamp_ntz"))
        yield part


def _kept(df, spark, name):
    """State is a stored table between days."""
    return spark.read.schema(df.schema).parquet(WR.write_table(df, WR.shared_dir(spark), name))


@register("bookmark_state_by_day", O.with_ctes(f", {R._BM_LOG}\nSELECT * FROM bm_state"))
def q_bookmark_state_by_day(spark, sf_dir):
    state = None
    for day in _days(dv.bookmark_log(spark, sf_dir)):
        state = _kept(LG.fold_bookmarks(state, day), spark, "bookmarks")
    return state


@register("login_sessions_by_day", R._LOGIN_SQL)
def q_login_sessions_by_day(spark, sf_dir):
    still_open, closed = None, None
    for day in _days(dv.login_log(spark, sf_dir)):
        done, left = LG.fold_sessions(still_open, day)
        done, still_open = _kept(done, spark, "sessions"), _kept(left, spark, "open_logins")
        closed = done if closed is None else closed.unionByName(done)
    return closed.unionByName(still_open.select(
        "username", F.col("ts").alias("login_time"), F.lit(None).cast("timestamp_ntz").alias("logout_time")))


# ------------------------------------------------------- second branches and grouped forms

def _either(a, b):
    return f'SELECT * FROM {SRL} WHERE "{a}" IS NOT NULL OR "{b}" IS NOT NULL'


@register("report_followup_till_date", O.with_ctes(_either("Last Contact Date", "CS Contacted On Date")))
def q_report_followup_till_date(spark, sf_dir):
    return FL.report_followup(R._srl(spark, sf_dir))


@register("report_planned_in_range", O.with_ctes(
    f"SELECT * FROM {SRL} WHERE {R._in_range_sql(['Next Followup Date', 'CS Follow-up On Date'], R._MLO, R._MHI)}"))
def q_report_planned_in_range(spark, sf_dir):
    return FL.report_planned(R._srl(spark, sf_dir), R._MLO, R._MHI)


@register("report_closure_till_date", O.with_ctes(_either("Closing Date", "CS Closure Date")))
def q_report_closure_till_date(spark, sf_dir):
    return FL.report_closure(R._srl(spark, sf_dir))


_GROUPS = [(g, [n for n in names if n in R._DETAIL_PRESENT]) for g, names in DETAIL_GROUPS]
_GROUPS = [(g, names) for g, names in _GROUPS if names]


@register("potential_details_grouped", O.with_ctes(
    "SELECT \"Potential No.\", " + ", ".join(
        "CAST(to_json(struct_pack(" + ", ".join(
            f"{O.qi(n)} := " + (f"strftime({O.qi(n)}, '%Y-%m-%d')" if n in R._DETAIL_DATES else O.qi(n)) for n in names)
        + f")) AS VARCHAR) AS {O.qi(g)}" for g, names in _GROUPS) + f" FROM ({R._latest_main_sql()}) x"))
def q_potential_details_grouped(spark, sf_dir):
    """P16's grouped form, its structs shown as JSON text."""
    d = LK.potential_details(tables(spark, sf_dir)["modified_rdb"], tiebreak=dv.MAIN_TIEBREAK, grouped=True)
    return d.select(c(KEY), *[F.to_json(c(g), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd"}).alias(g)
                              for g, _ in _GROUPS])

