"""DuckDB SQL oracles for the registered queries.

Each oracle is one SQL statement over the driver's pre-registered views
(``orders``, ``customer``, ``lineitem``, ...).  The statement restates the
derived CRM views and the reference semantics directly in SQL -- row-level
windows and CASE rules, no shared code path with the Spark plans -- so a match
checks the Spark strategy (aggregate-then-join, WindowGroupLimit, ...)
against the plain definition.
"""

from __future__ import annotations

from .columns import (CATEGORY_MAPPING, CLOSED_STAGE, GRID_EXCLUDED_STAGES, STAGE_MAPPING,
                      STATUS_COLUMNS, STATUS_DATE_COLUMNS)
from .sources.derived import (CATEGORY_SEEDS, DSR_TIEBREAK, EXEC_ALIASES, EXEC_SUFFIXED,
                              MIN_DATE, OLD_SNAPSHOT_BEFORE, OWNER_MAP, STAGE_SEEDS)

FMT = "'%d/%m/%Y %H:%M'"


def s(x: str) -> str:
    """SQL string literal."""
    return "'" + str(x).replace("'", "''") + "'"


def qi(name: str) -> str:
    """Double-quoted identifier."""
    return '"' + name.replace('"', '""') + '"'


def lst(xs) -> str:
    return "[" + ", ".join(s(x) for x in xs) + "]"


def in_list(xs) -> str:
    return "(" + ", ".join(s(x) for x in xs) + ")"


def case_map(expr: str, mapping: dict) -> str:
    if not mapping:
        return expr
    whens = " ".join(f"WHEN {s(k)} THEN {s(v)}" for k, v in mapping.items())
    return f"CASE {expr} {whens} ELSE {expr} END"


def exec_expr(expr: str) -> str:
    e2 = case_map(expr, EXEC_ALIASES)
    return f"CASE WHEN {e2} IN {in_list(EXEC_SUFFIXED)} THEN {e2} || ' - (EX)' ELSE {e2} END"


def fmt(e: str) -> str:
    return f"strftime({e}, {FMT})"


def parse(e: str) -> str:
    return f"try_strptime({e}, {FMT})"


STAGES = lst(STAGE_SEEDS)
CATS = lst(CATEGORY_SEEDS)
T_MIN = f"TIMESTAMP '{MIN_DATE}'"
T_OLD = f"TIMESTAMP '{OLD_SNAPSHOT_BEFORE}'"
TB_DESC = ", ".join(f"{t} DESC NULLS LAST" for t in DSR_TIEBREAK)

# ----------------------------------------------------------------- derived views

VIEWS = f"""
v_base AS (
  SELECT o_orderkey AS k, o_custkey AS ck, o_orderdate AS od,
         CAST(o_orderkey AS VARCHAR) AS "Potential No.", c_mktsegment AS "Potential Code",
         c_name AS "Company Name (Company Name)", n_name AS "State/UT",
         CASE WHEN o_orderkey % 97 = 5 THEN NULL ELSE r_name END AS "Region",
         'Exec ' || CAST(o_custkey % 12 AS VARCHAR) AS "Sales handled by",
         {CATS}[CAST(o_orderkey % 5 AS INTEGER) + 1] AS "Category",
         'Owner ' || CAST(o_custkey % 7 AS VARCHAR) AS "Potential Owner"
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey),
v_p1 AS (
  SELECT *, k * 2 AS _seq, {STAGES}[CAST(k % 8 AS INTEGER) + 1] AS "Stage",
         {fmt('od')} AS "Created Time",
         {fmt('od + to_days(5)')} AS "Modified Time",
         {fmt('od + to_days(60)')} AS "Closing Date",
         CASE WHEN k % 6 <> 0 THEN {fmt('od + to_days(2)')} END AS "Last Contact Date",
         CASE WHEN k % 7 <> 3 THEN {fmt('od + to_days(9)')} END AS "Next Followup Date"
  FROM v_base WHERE od < {T_OLD}),
v_p2_once AS (
  SELECT *, od + to_days(CAST(CASE WHEN k % 5 = 0 THEN (k % 13) * 100
                                   ELSE (k % 8) * 15 - 15 END AS INTEGER)) AS md
  FROM v_base WHERE k % 7 <> 0 OR od >= {T_OLD}),
v_p2 AS (
  SELECT * EXCLUDE (md, copy), k * 2 + copy AS _seq,
         {STAGES}[CAST((k * 3 + ck + copy) % 8 AS INTEGER) + 1] AS "Stage",
         {fmt('od')} AS "Created Time",
         {fmt('md')} AS "Modified Time",
         {fmt('md + to_days(45)')} AS "Closing Date",
         CASE WHEN k % 6 <> 0 THEN {fmt('md - to_days(1)')} END AS "Last Contact Date",
         CASE WHEN k % 7 <> 3 THEN {fmt('md + to_days(7)')} END AS "Next Followup Date"
  FROM v_p2_once CROSS JOIN (VALUES (0), (1)) d(copy) WHERE copy = 0 OR k % 50 = 1),
v_dsr AS (
  SELECT k, od, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
         "Potential No.", "Sales handled by" AS "Sales Person Name",
         {STAGES}[CAST(l_linenumber % 8 AS INTEGER) + 1] AS "Original Stage",
         CASE WHEN l_partkey % 9 <> 4 THEN {STAGES}[CAST(l_partkey % 8 AS INTEGER) + 1] END AS "New Stage",
         {fmt('ct')} AS "Contacted Date",
         {fmt('ct + to_hours(l_linenumber)')} AS "Created Time",
         {fmt('ct + to_days(14)')} AS "Next Followup Date (Potential Details)",
         {fmt('ct + to_days(40)')} AS "Closing Date",
         CASE WHEN l_suppkey % 3 = 0 THEN 'Visit' END AS "Mode of Contact (DSR)",
         'Phone' AS "Mode of Contact",
         CASE WHEN l_suppkey % 4 = 0 THEN 'R-' || CAST(l_suppkey AS VARCHAR)
              WHEN l_suppkey % 4 = 1 THEN '  ' END AS "Report ID",
         'Call ' || CAST(l_linenumber AS VARCHAR) || ' on order ' || CAST(l_orderkey AS VARCHAR)
           AS "Description (Potential Details)"
  FROM (SELECT *, od + to_days(CAST((l_linenumber // 2) * 30 AS INTEGER)) AS ct
        FROM lineitem JOIN v_base ON l_orderkey = k)),
v_dsr1 AS (SELECT * FROM v_dsr WHERE od < {T_OLD}),
v_dsr2 AS (SELECT * FROM v_dsr WHERE k % 5 <> 0 OR od >= {T_OLD})"""


def _clean_p(src: str, with_status: bool) -> str:
    status = ""
    if with_status:
        status = ", " + ", ".join(
            f"CAST(NULL AS {'TIMESTAMP' if n in STATUS_DATE_COLUMNS else 'VARCHAR'}) AS {qi(n)}"
            for n in STATUS_COLUMNS)
    return f"""SELECT * FROM (
  SELECT k, ck, od, "Potential No.", "Potential Code",
         "Company Name (Company Name)" AS "Company Name", "State/UT", "Region",
         {exec_expr('"Sales handled by"')} AS "Executive",
         {case_map('"Category"', CATEGORY_MAPPING)} AS "Category",
         {case_map('"Potential Owner"', OWNER_MAP)} AS "Potential Owner",
         _seq, {case_map('"Stage"', STAGE_MAPPING)} AS "Stage",
         {parse('"Created Time"')} AS "Created Date",
         {parse('"Modified Time"')} AS "Modified Date",
         {parse('"Closing Date"')} AS "Closing Date",
         {parse('"Last Contact Date"')} AS "Last Contact Date",
         {parse('"Next Followup Date"')} AS "Next Followup Date"{status}
  FROM {src})
WHERE "Created Date" >= {T_MIN} OR "Modified Date" >= {T_MIN}"""


def _clean_dsr(src: str) -> str:
    orig = case_map('"Original Stage"', STAGE_MAPPING)
    new = case_map('"New Stage"', STAGE_MAPPING)
    return f"""SELECT * FROM (
  SELECT k, od, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
         "Potential No.", {exec_expr('"Sales Person Name"')} AS "Executive",
         {orig} AS "Original Stage", coalesce({new}, {orig}) AS "New Stage",
         {parse('"Contacted Date"')} AS "Contacted Date",
         {parse('"Created Time"')} AS "Created Date",
         {parse('"Next Followup Date (Potential Details)"')} AS "Next Followup Date",
         {parse('"Closing Date"')} AS "Closing Date",
         coalesce("Mode of Contact (DSR)", "Mode of Contact") AS "Mode of Contact",
         "Report ID", "Description (Potential Details)", 'DSR' AS "DSR Type"
  FROM {src} WHERE "Potential No." IS NOT NULL)
WHERE "Created Date" >= {T_MIN}"""


def _srl_select() -> str:
    ts_null = ("Enquiry Date",)
    str_null = ("Potential Name", "Campaign Source", "Mobile", "Billing City", "Email",
                "Lead Source")
    cols = []
    from .columns import SRL_COLUMNS
    for n in SRL_COLUMNS:
        if n in ts_null:
            cols.append(f"CAST(NULL AS TIMESTAMP) AS {qi(n)}")
        elif n in str_null:
            cols.append(f"CAST(NULL AS VARCHAR) AS {qi(n)}")
        else:
            cols.append(qi(n))
    return ", ".join(cols)


def _status_case(c1, c2, c3, c4, c5, col):
    return (f"CASE WHEN c1 THEN {c1} WHEN c2 THEN {c2} WHEN c3 THEN {c3} WHEN c4 THEN {c4} "
            f"WHEN c5 THEN {c5} ELSE r.{qi(col)} END AS {qi(col)}")


def _status_sql() -> str:
    rows = [
        ("Previous Status Stage", 'r."Stage"', "m2_st", "s1_og", "s2_nw", "b1_nw"),
        ("PS Contacted On Date", 'r."Last Contact Date"', "m2_lc", 'r."PS Contacted On Date"',
         "s2_ct", "b1_ct"),
        ("PS Follow-up On Date", 'r."Next Followup Date"', "m2_fu", 'r."PS Follow-up On Date"',
         "s2_fu", "b1_fu"),
        ("PS Closure Date", 'r."Closing Date"', "m2_cl", 'r."PS Closure Date"', "s2_cl", "b1_cl"),
        ("Current Status Stage", 'r."Stage"', "m1_st", "s1_nw", "s1_nw", 'r."Stage"'),
        ("CS Contacted On Date", 'r."Last Contact Date"', "m1_lc", "s1_ct", "s1_ct",
         'r."Last Contact Date"'),
        ("CS Follow-up On Date", 'r."Next Followup Date"', "m1_fu", "s1_fu", "s1_fu",
         'r."Next Followup Date"'),
        ("CS Closure Date", 'r."Closing Date"', "m1_cl", "s1_cl", "s1_cl", 'r."Closing Date"'),
    ]
    repl = ",\n         ".join(_status_case(a, b, cc, d, e, n) for n, a, b, cc, d, e in rows)
    return f"""
sk AS (SELECT "Potential No." AS pk, CAST("Modified Date" AS DATE) AS md
       FROM srl0 WHERE "Potential No." IS NOT NULL),
dd AS (SELECT d."Potential No." AS pk, CAST(d."Contacted Date" AS DATE) AS cd,
              d."Created Date" AS cr, d."Contacted Date" AS ct, d."New Stage" AS nw,
              d."Original Stage" AS og, d."Next Followup Date" AS fu, d."Closing Date" AS cl,
              {", ".join("d." + t for t in DSR_TIEBREAK)}, sk.md
       FROM dsr2rdb d JOIN sk ON d."Potential No." = sk.pk),
dhas AS (SELECT DISTINCT pk FROM dd),
same AS (SELECT *, count(*) OVER (PARTITION BY pk) AS sn,
                row_number() OVER (PARTITION BY pk ORDER BY cr DESC NULLS LAST, {TB_DESC}) AS rn
         FROM dd WHERE cd = md),
s1 AS (SELECT * FROM same WHERE rn = 1),
s2 AS (SELECT * FROM same WHERE rn = 2),
bef AS (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY ct DESC NULLS LAST, {TB_DESC}) AS rn
        FROM dd WHERE cd < md),
b1 AS (SELECT * FROM bef WHERE rn = 1),
mm AS (SELECT "Potential No." AS pk, "Stage" AS st, "Last Contact Date" AS lc,
              "Next Followup Date" AS fu, "Closing Date" AS cl,
              count(*) OVER (PARTITION BY "Potential No.") AS mn,
              row_number() OVER (PARTITION BY "Potential No."
                                 ORDER BY "Modified Date" DESC NULLS LAST, _seq DESC NULLS LAST) AS rn
       FROM modified_rdb WHERE "DSR Type" IS NULL AND "Potential No." IS NOT NULL),
m1 AS (SELECT * FROM mm WHERE rn = 1),
m2 AS (SELECT * FROM mm WHERE rn = 2),
srlc AS (SELECT r.*, dhas.pk IS NULL AND coalesce(m1.mn, 0) = 1 AS c1,
                dhas.pk IS NULL AND coalesce(m1.mn, 0) >= 2 AS c2,
                dhas.pk IS NOT NULL AND s1.sn = 1 AS c3,
                dhas.pk IS NOT NULL AND s1.sn >= 2 AS c4,
                dhas.pk IS NOT NULL AND s1.sn IS NULL AND b1.pk IS NOT NULL AS c5,
                m1.st AS m1_st, m1.lc AS m1_lc, m1.fu AS m1_fu, m1.cl AS m1_cl,
                m2.st AS m2_st, m2.lc AS m2_lc, m2.fu AS m2_fu, m2.cl AS m2_cl,
                s1.nw AS s1_nw, s1.og AS s1_og, s1.ct AS s1_ct, s1.fu AS s1_fu, s1.cl AS s1_cl,
                s2.nw AS s2_nw, s2.ct AS s2_ct, s2.fu AS s2_fu, s2.cl AS s2_cl,
                b1.nw AS b1_nw, b1.ct AS b1_ct, b1.fu AS b1_fu, b1.cl AS b1_cl
         FROM srl0 r LEFT JOIN dhas ON r."Potential No." = dhas.pk
              LEFT JOIN s1 ON r."Potential No." = s1.pk
              LEFT JOIN s2 ON r."Potential No." = s2.pk
              LEFT JOIN b1 ON r."Potential No." = b1.pk
              LEFT JOIN m1 ON r."Potential No." = m1.pk
              LEFT JOIN m2 ON r."Potential No." = m2.pk),
srl AS (SELECT r.* EXCLUDE (c1, c2, c3, c4, c5, m1_st, m1_lc, m1_fu, m1_cl, m2_st, m2_lc,
                            m2_fu, m2_cl, s1_nw, s1_og, s1_ct, s1_fu, s1_cl, s2_nw, s2_ct,
                            s2_fu, s2_cl, b1_nw, b1_ct, b1_fu, b1_cl)
               REPLACE ({repl})
        FROM srlc r)"""


def build_ctes() -> str:
    """Every derived and built table as CTEs (unreferenced ones cost nothing)."""
    return f"""WITH {VIEWS},
p1rdb AS ({_clean_p("v_p1", False)}),
p2c AS ({_clean_p("v_p2", True)}),
p2rdb AS (SELECT * EXCLUDE (rn) FROM (
            SELECT *, row_number() OVER (PARTITION BY "Potential No." ORDER BY _seq) AS rn
            FROM p2c) WHERE rn = 1),
dsr1rdb AS ({_clean_dsr("v_dsr1")}),
dsr2rdb AS ({_clean_dsr("v_dsr2")}),
main_rdb AS (SELECT * FROM p1rdb UNION ALL BY NAME SELECT * FROM dsr1rdb),
wm AS (SELECT max("Created Date") AS watermark FROM main_rdb),
p2f AS (SELECT * FROM p2rdb WHERE "Modified Date" > (SELECT watermark FROM wm)),
dsr2f AS (SELECT * FROM dsr2rdb WHERE "Created Date" > (SELECT watermark FROM wm)),
weekly_rdb AS (SELECT * FROM p2f UNION ALL BY NAME SELECT * FROM dsr2f),
modified_rdb AS (SELECT * REPLACE ({case_map('"Category"', CATEGORY_MAPPING)} AS "Category")
                 FROM (SELECT * FROM main_rdb UNION ALL BY NAME SELECT * FROM weekly_rdb)),
srl0 AS (SELECT {_srl_select()},
                CASE WHEN "Potential No." IN (SELECT "Potential No." FROM p1rdb
                                              WHERE "Potential No." IS NOT NULL)
                     THEN 'Existing' ELSE 'New' END AS "Flag"
         FROM p2rdb),{_status_sql()}"""


def with_ctes(final_select: str) -> str:
    return build_ctes() + "\n" + final_select


# Grid helpers -----------------------------------------------------------------

def grid_sql(src: str) -> str:
    """Stage-movement grid over a status-table relation ``src`` (a CTE name)."""
    closed = s(CLOSED_STAGE)
    return f""",
uni AS (SELECT DISTINCT x AS sname FROM (
          SELECT "Stage" AS x FROM {src} UNION ALL SELECT "Previous Status Stage" FROM {src}
          UNION ALL SELECT "Current Status Stage" FROM {src}) WHERE x IS NOT NULL),
ob AS (SELECT "Previous Status Stage" AS sname, count(*) AS n FROM {src}
       WHERE "Flag" = 'Existing' AND "Previous Status Stage" IS NOT NULL GROUP BY 1),
an AS (SELECT "Previous Status Stage" AS sname, count(*) AS n FROM {src}
       WHERE "Flag" = 'New' AND "Previous Status Stage" IS NOT NULL GROUP BY 1),
mv AS (SELECT "Previous Status Stage" AS sname, count(*) AS n FROM {src}
       WHERE "Flag" = 'Existing' AND "Previous Status Stage" IS NOT NULL
         AND "Current Status Stage" IS NOT NULL
         AND "Previous Status Stage" <> "Current Status Stage"
         AND "Current Status Stage" <> {closed} GROUP BY 1),
ao AS (SELECT "Current Status Stage" AS sname, count(*) AS n FROM {src}
       WHERE "Flag" = 'Existing' AND "Previous Status Stage" IS NOT NULL
         AND "Current Status Stage" IS NOT NULL
         AND "Previous Status Stage" <> "Current Status Stage"
         AND "Current Status Stage" <> {closed} GROUP BY 1),
dr AS (SELECT "Previous Status Stage" AS sname, count(*) AS n FROM {src}
       WHERE "Previous Status Stage" IS NOT NULL AND "Current Status Stage" = {closed}
         AND "Previous Status Stage" <> "Current Status Stage" GROUP BY 1),
grid AS (SELECT u.sname AS "Stage Name",
                CAST(coalesce(ob.n, 0) AS BIGINT) AS "OB",
                CAST(coalesce(an.n, 0) AS BIGINT) AS "Added-New",
                CAST(coalesce(ao.n, 0) AS BIGINT) AS "Added-Old",
                CAST(coalesce(mv.n, 0) AS BIGINT) AS "Moved",
                CAST(coalesce(dr.n, 0) AS BIGINT) AS "Dropped",
                CAST(coalesce(ob.n, 0) + coalesce(an.n, 0) + coalesce(ao.n, 0)
                     - coalesce(mv.n, 0) - coalesce(dr.n, 0) AS BIGINT) AS "CB"
         FROM uni u LEFT JOIN ob USING (sname) LEFT JOIN an USING (sname)
              LEFT JOIN ao USING (sname) LEFT JOIN mv USING (sname) LEFT JOIN dr USING (sname))"""


def stage_num_sql(e: str) -> str:
    return (f"coalesce(TRY_CAST(NULLIF(regexp_extract({e}, '^([0-9]+)', 1), '') AS INTEGER), "
            f"2147483647)")


def finish_grid_sql(grid: str, higher_stage: str = "All", limit: int | None = None) -> str:
    """F14 -> F15 -> total -> order (-> limit) over a grid relation; returns a SELECT."""
    import re
    cond = f'"Stage Name" NOT IN {in_list(GRID_EXCLUDED_STAGES)}'
    if higher_stage != "All":
        m = re.match(r"(\d+)", higher_stage)
        n = int(m.group(1)) if m else 2147483647
        cond += f' AND {stage_num_sql(chr(34) + "Stage Name" + chr(34))} >= {n}'
    return f""",
g2 AS (SELECT * FROM {grid} WHERE {cond}),
g3 AS (SELECT *, 0 AS is_total FROM g2
       UNION ALL
       SELECT 'Total', CAST(coalesce(sum("OB"), 0) AS BIGINT), CAST(coalesce(sum("Added-New"), 0) AS BIGINT),
              CAST(coalesce(sum("Added-Old"), 0) AS BIGINT), CAST(coalesce(sum("Moved"), 0) AS BIGINT),
              CAST(coalesce(sum("Dropped"), 0) AS BIGINT), CAST(coalesce(sum("CB"), 0) AS BIGINT), 1
       FROM g2 WHERE "Stage Name" <> {s(CLOSED_STAGE)})
SELECT * EXCLUDE (is_total) FROM g3
ORDER BY is_total, {stage_num_sql(chr(34) + "Stage Name" + chr(34))}, "Stage Name"{f" LIMIT {limit}" if limit else ""}"""
