"""Command line: the batch build from CSV exports, and the movement report.

    python -m stagecraft build  --input DIR --output DIR [options]
    python -m stagecraft load   --input DIR --output DIR --load-date DATE [options]
    python -m stagecraft report --tables DIR --output DIR [options]

``build`` reads ``p1.csv``, ``p2.csv``, ``dsr1.csv`` and ``dsr2.csv`` from
``--input`` (all text, pandas-style null tokens), tags each with its file order,
and writes the cleaned, merged and status tables under ``--output``.
``load`` reads ``p.csv`` and ``dsr.csv`` of one date and writes only that date's part of
tables kept by load date; running it again replaces that part.
``report`` reads the stored status and merged tables and writes the filtered
movement grid (with its filter block), the drill-down details and the stage
histories of the drilled potentials.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _json(text):
    return json.loads(text) if text else None


def _formats(given):
    """Date layouts from the command line: for all columns, or per column."""
    from .functions.dates import DAYFIRST_FORMATS

    if not given:
        return DAYFIRST_FORMATS
    if not any("=" in g for g in given):
        return tuple(given)
    out: dict = {}
    for g in given:
        name, _, layout = g.partition("=")
        out.setdefault(name, []).append(layout)
    return out


def _inputs(spark: SparkSession, args, names) -> tuple:
    """The exports ``names`` and the build's parameters."""
    from .plans.build import INFERRED, BuildParams
    from .sources.ordered import number_by_file
    from .sources.readers import scan_csv

    inputs = {}
    for name in names:
        # an export is a file or a folder of files; rows are numbered in the order of the files
        inputs[name] = number_by_file(scan_csv(spark, f"{args.input.rstrip('/')}/{name}.csv",
                                               multi_line=not args.split_files))
    params = BuildParams(exec_aliases=_json(args.aliases) or {},
                         exec_suffixed=_json(args.suffixed) or [],
                         owner_map=_json(args.owner_map), min_date=args.min_date,
                         date_formats=INFERRED if args.infer_dates else _formats(args.date_format),
                         load_order=("_seq",), main_tiebreak=("_seq",),
                         dsr_tiebreak=("_seq",))
    return inputs, params


def load(spark: SparkSession, args) -> dict:
    from .plans.build import run_load

    inputs, params = _inputs(spark, args, ("p", "dsr"))
    return {name: f"{args.output.rstrip('/')}/{name}" for name in run_load(inputs, params, args.output, args.load_date)}


def build(spark: SparkSession, args) -> dict:
    from .plans.build import run_build, unparsed_inputs
    from .sources.writers import write_table

    inputs, params = _inputs(spark, args, ("p1", "p2", "dsr1", "dsr2"))
    out = run_build(inputs, params, args.output, args.format)
    out["unparsed_dates"] = write_table(unparsed_inputs(inputs, params), args.output,
                                        "unparsed_dates", args.format)
    same = {"p1rdb_filtered": "p1rdb", "dsr1rdb_filtered": "dsr1rdb"}  # other names, no files of their own
    return {name: f"{args.output.rstrip('/')}/{same.get(name, name)}" for name in out}


def report(spark: SparkSession, args) -> dict:
    from .operators import grid as G
    from .operators.filters import filter_report_chain
    from .operators.lookup import drill_down_details, history_for_export, potential_details
    from .sources.writers import details_and_history_export, history_export_by_key, report_export

    base = args.tables.rstrip("/")
    srl = spark.read.format(args.format).load(f"{base}/sales_reporting_logic")
    modified = spark.read.format(args.format).load(f"{base}/modified_rdb")
    filtered, _, _ = filter_report_chain(
        srl, user=args.user, team=_json(args.team), restricted=_json(args.restricted) or (),
        forced_regions=_json(args.forced_regions), executive=args.executive,
        region=args.region, code=args.code, criterion=args.criterion, as_of=args.as_of,
        start=args.start, end=args.end, report=args.report)
    grid = G.finish_grid(G.stage_movement_grid(filtered), args.higher_stage)
    selected = {"Region": args.region, "Executive": args.executive,
                "Potential Code": args.code, "Stage Filter": args.higher_stage,
                "Criterion Date": args.criterion, "Report": args.report}
    paths = report_export(G.grid_alerts(grid), args.output, "movement_grid", selected,
                          args.format)
    if args.stages:
        keys = G.drill_down(filtered, args.stages, args.metrics)
        bookmarks = (spark.read.format(args.format).load(args.bookmarks)
                     if args.bookmarks else None)
        paths["drill_down"] = report_export(
            drill_down_details(modified, keys, bookmarks, args.user, tiebreak=("_seq",)),
            args.output, "drill_down", {"Stage Name(s)": ", ".join(args.stages),
                                        "Column": ", ".join(args.metrics)},
            args.format, names=("Stage Name(s)", "Column"))["report"]
        paths["history_by_sheet"] = history_export_by_key(
            history_for_export(modified, keys, tiebreak=("_seq",)), args.output,
            fmt=args.format)
        both = details_and_history_export(
            potential_details(modified, keys, tiebreak=("_seq",)),
            history_for_export(modified, keys, tiebreak=("_seq",)), args.output, args.format)
        paths.update({"details": both["details"], "details_history": both["history"]})
    return paths


def _input_options(b: argparse.ArgumentParser) -> None:
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--min-date", default="2021-01-01")
    b.add_argument("--date-format", action="append",
                   help="a layout for all date columns, or Column=layout; repeat to try several")
    b.add_argument("--infer-dates", action="store_true",
                   help="take each date column's layout from its first text")
    b.add_argument("--split-files", action="store_true",
                   help="no quoted value holds a line break: files may be split over tasks")
    b.add_argument("--multi-line", dest="split_files", action="store_false",
                   help="quoted values may hold line breaks (the default)")
    b.add_argument("--aliases", help='JSON object, e.g. {"Alias": "Name"}')
    b.add_argument("--suffixed", help="JSON list of names that get the ' - (EX)' suffix")
    b.add_argument("--owner-map", help="JSON object owner label -> address")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stagecraft")
    sub = p.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="clean, merge and derive the status table")
    b.add_argument("--format", default="parquet")
    d = sub.add_parser("load", help="the build's next load, kept by its date")
    d.add_argument("--load-date", required=True, help="YYYY-MM-DD")
    for x in (b, d):
        _input_options(x)
    r = sub.add_parser("report", help="movement grid, drill-down and histories")
    r.add_argument("--tables", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--format", default="parquet")
    r.add_argument("--user")
    r.add_argument("--team", help='JSON object lead -> [executives]')
    r.add_argument("--restricted", help="JSON list of users limited to their own rows")
    r.add_argument("--forced-regions", help="JSON object user -> region")
    r.add_argument("--executive", default="All")
    r.add_argument("--region", default="All")
    r.add_argument("--code", default="All")
    r.add_argument("--criterion", default="Till date")
    r.add_argument("--as-of")
    r.add_argument("--start")
    r.add_argument("--end")
    r.add_argument("--report", default="All")
    r.add_argument("--higher-stage", default="All")
    r.add_argument("--stages", nargs="*")
    r.add_argument("--metrics", nargs="*", default=["CB"])
    r.add_argument("--bookmarks", help="stored bookmark state (user, potential_no, ...)")
    return p


def main(argv=None, spark: SparkSession | None = None) -> dict:
    args = parser().parse_args(argv)
    if spark is None:
        spark = SparkSession.builder.appName(f"stagecraft-{args.cmd}").getOrCreate()
    out = {"build": build, "load": load, "report": report}[args.cmd](spark, args)
    print(json.dumps(out, indent=1, default=str))
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
