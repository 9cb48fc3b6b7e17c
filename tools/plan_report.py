"""Summarise the physical plans of registered queries (for PLANS.md).

Usage: python tools/plan_report.py [sf_dir] [name ...]

For each query: exchanges by partitioning, join strategies, window-group
limits (partial = before the shuffle), partial aggregates, and the filters and
columns pushed into each Parquet scan.  AQE is off while planning so the
static plan is shown; the broadcast threshold is the session's.
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DEFAULT = ["status_rule", "sales_reporting_bucketed", "facets_at_once", "movement_report", "drill_down", "drill_down_details",
           "report_followup", "stage_history", "login_sessions", "bookmark_state",
           "history_export_by_key"]


def summarise(plan: str) -> list[str]:
    clean = re.sub(r"#\d+L?", "", plan)
    out = []
    ex = Counter(m.group(1) for m in re.finditer(r"Exchange (\w+)", clean))
    out.append("exchanges: " + (", ".join(f"{k} x{v}" for k, v in sorted(ex.items())) or "none"))
    joins = Counter(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|"
                               r"BroadcastNestedLoopJoin|CartesianProduct)", clean))
    out.append("joins: " + (", ".join(f"{k} x{v}" for k, v in sorted(joins.items())) or "none"))
    wgl = Counter(re.findall(r"WindowGroupLimit .*?, (Partial|Final)", clean))
    if wgl:
        out.append("window group limits: " + ", ".join(f"{k} x{v}" for k, v in sorted(wgl.items())))
    partial = len(re.findall(r"(?:Hash|ObjectHash|Sort)Aggregate\(keys?=\[[^\]]*\], "
                             r"functions=\[partial_", clean))
    if partial:
        out.append(f"partial (map-side) aggregates: {partial}")
    scans = set()
    for m in re.finditer(r"FileScan parquet [^\n]*?PushedFilters: (.*?), ReadSchema: "
                         r"(struct<[^\n]*)", clean):
        schema = m.group(2)
        ncols = schema.count(":")
        shown = f"{ncols}+ (schema text truncated)" if "..." in schema else str(ncols)
        scans.add(f"scan: {shown} columns read, pushed {m.group(1)[:160]}")
    out += sorted(scans)
    return out


def status_rule(spark, sf_dir):
    """The six-case status rule planned over the stored cleaned/merged tables."""
    from stagecraft.operators.status import sales_reporting
    from stagecraft.registry import PARAMS, tables
    t = tables(spark, sf_dir)
    return sales_reporting(t["p2rdb"], t["p1rdb"], t["dsr2rdb"], t["modified_rdb"],
                           dsr_tiebreak=PARAMS.dsr_tiebreak, main_tiebreak=PARAMS.main_tiebreak)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    names = sys.argv[2:] or DEFAULT
    from stagecraft.registry import QUERIES
    from stagecraft.session import local_session
    spark = local_session(8, 16)
    for name in names:
        fn = status_rule if name == "status_rule" else QUERIES[name]
        df = fn(spark, sf_dir)                  # builds/reads the stored tables first
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = df._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        print(f"### {name}\n")
        for line in summarise(plan):
            print(f"- {line}")
        print()
    spark.stop()


if __name__ == "__main__":
    main()
