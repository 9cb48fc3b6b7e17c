"""The batch build: clean both snapshots and both logs, merge incrementally,
derive the status table, list discrepancies (Q1-Q4, Q12, A7).

``build_tables`` is lazy: it returns DataFrames and runs no job.
``run_build`` writes every table (one action per table) and then reads the
written merged tables back for the status rule, so the final stage's lineage
starts at stored files (survives executor loss without recomputing the
cleaning chain).
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..columns import (DEFAULT_MIN_DATE, DSR_DATES, DSR_DROP, DSR_RENAME, FLAG, KEY, P_DATES, P_DROP,
                       P_RENAME, SRL_COLUMNS, STATUS_COLUMNS, STATUS_DATE_COLUMNS, c, present)
from ..functions.dates import DAYFIRST_FORMATS
from ..functions.periods import ntz_lit
from ..operators.clean import (clean_activities, clean_potentials, drop_columns_if_present,
                               ensure_columns, parse_text_dates, rename_columns, unparsed_dates)
from ..operators.layouts import inferred_formats
from ..operators.merge import incremental_merge, union_by_name
from ..operators.ranking import dedupe_keep_first, duplicate_keys, duplicate_rows
from ..operators.status import busy_keys, common_new_counts, crowded_key, flag_new_existing, sales_reporting


#: ``date_formats`` for layouts taken from each column's first text (operators.layouts)
INFERRED = "inferred"


@dataclass
class BuildParams:
    """Everything the reference hard-codes, as arguments."""
    exec_aliases: dict = field(default_factory=dict)
    exec_suffixed: list = field(default_factory=list)
    owner_map: object = None
    min_date: str = DEFAULT_MIN_DATE
    date_formats: object = DAYFIRST_FORMATS  # layouts, column -> layouts, or INFERRED
    load_order: tuple = ("_seq",)          # W1 "first in file order"
    dsr_tiebreak: tuple = ()                # total order of activity picks
    main_tiebreak: tuple = ("_seq",)        # total order of main-row picks

    def cleaning(self) -> dict:
        return dict(aliases=self.exec_aliases, suffix_names=self.exec_suffixed,
                    owner_map=self.owner_map, min_date=self.min_date,
                    date_formats=self.date_formats)


def params_of(name: str, raw: DataFrame, params: BuildParams) -> BuildParams:
    """The parameters of one input: inferred layouts are found from its own columns."""
    if params.date_formats != INFERRED:
        return params
    rename, dates = ((P_RENAME, P_DATES + STATUS_DATE_COLUMNS) if name.startswith("p")
                     else (DSR_RENAME, DSR_DATES + ["Modified Date"]))
    named = rename_columns(drop_columns_if_present(raw, P_DROP if name.startswith("p") else DSR_DROP), rename)
    texts = [n for n in present(named, dates) if named.schema[n].dataType.typeName() == "string"]
    order = present(named, params.load_order) or present(named, params.dsr_tiebreak)
    if not order:
        raise ValueError(f"{name}: inferred layouts need a load-order column; see sources.ordered")
    return replace(params, date_formats=inferred_formats(named, texts, order))


def clean_new_snapshot(p2_raw: DataFrame, params: BuildParams) -> DataFrame:
    """Cleaned new snapshot with the eight status columns ensured (before dedupe)."""
    p2 = clean_potentials(p2_raw, **params.cleaning())
    p2 = parse_text_dates(p2, STATUS_DATE_COLUMNS, params.date_formats)
    return ensure_columns(p2, STATUS_COLUMNS, {n: "timestamp_ntz" for n in STATUS_DATE_COLUMNS})


def unparsed_inputs(tables_in: dict[str, DataFrame], params: BuildParams) -> DataFrame:
    """Per raw input and date column, how many non-null texts fit none of the layouts."""
    parts = []
    for name, df in tables_in.items():
        rename, dates = ((P_RENAME, P_DATES + STATUS_DATE_COLUMNS) if name.startswith("p")
                         else (DSR_RENAME, DSR_DATES))
        counts = unparsed_dates(rename_columns(df, rename), dates, params_of(name, df, params).date_formats)
        parts.append(counts.select(F.lit(name).alias("input"), "column", "unparsed"))
    return union_by_name(*parts)


def stored_snapshot(p2rdb: DataFrame, p1rdb: DataFrame) -> DataFrame:
    """The new snapshot as it is stored: every column of the status table, and ``Flag``."""
    dates = {n: "timestamp_ntz" for n in SRL_COLUMNS if n in STATUS_DATE_COLUMNS + P_DATES}
    return flag_new_existing(ensure_columns(p2rdb, SRL_COLUMNS, dates), p1rdb)


def _old_side(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The old side passes the watermark step whole: its filtered tables are other names."""
    return {"p1rdb_filtered": tables["p1rdb"], "dsr1rdb_filtered": tables["dsr1rdb"]}


def build_tables(p1_raw: DataFrame, p2_raw: DataFrame, dsr1_raw: DataFrame,
                 dsr2_raw: DataFrame, params: BuildParams) -> dict[str, DataFrame]:
    cl = params.cleaning()
    p1rdb = clean_potentials(p1_raw, **cl)
    p2_all = clean_new_snapshot(p2_raw, params)
    p2rdb = dedupe_keep_first(p2_all, KEY, params.load_order)
    dsr1rdb = clean_activities(dsr1_raw, **cl)
    dsr2rdb = clean_activities(dsr2_raw, **cl)
    merged = incremental_merge(p1rdb, p2rdb, dsr1rdb, dsr2rdb)
    srl = sales_reporting(p2rdb, p1rdb, dsr2rdb, merged["modified_rdb"],
                          dsr_tiebreak=params.dsr_tiebreak, main_tiebreak=params.main_tiebreak,
                          date_formats=params.date_formats)
    out = {"p1rdb": p1rdb, "p2rdb_duplicates": duplicate_rows(p2_all), "p2rdb_all": p2_all,
           "p2rdb_deduped": p2rdb, "p2rdb": stored_snapshot(p2rdb, p1rdb),
           "dsr1rdb": dsr1rdb, "dsr2rdb": dsr2rdb, **merged, "sales_reporting_logic": srl}
    return out | _old_side(out)


def discrepancies(srl: DataFrame, dsr2rdb: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct non-null keys only in the status table
    (``side='srl_only'``) or only in the activity log (``side='dsr2_only'``).
    """
    # tagged keys of both sides, one aggregate: keys seen on one side only
    def tagged(df, on_srl):
        return (df.select(c(key).alias("_dk"), F.lit(on_srl).alias("_s"))
                .filter(F.col("_dk").isNotNull()))

    seen = (tagged(srl, True).unionByName(tagged(dsr2rdb, False)).groupBy("_dk")
            .agg(F.bool_or("_s").alias("_a"), F.bool_and("_s").alias("_b")))
    return (seen.filter(F.col("_a") == F.col("_b"))
            .select(F.col("_dk").alias(key),
                    F.when(F.col("_a"), F.lit("srl_only")).otherwise(F.lit("dsr2_only")).alias("side")))


def discrepancy_counts(srl: DataFrame, dsr2rdb: DataFrame, key: str = KEY) -> DataFrame:
    """Counts of both discrepancy lists (one row per side)."""
    return discrepancies(srl, dsr2rdb, key).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of main, weekly, modified and the status table, one row each."""
    parts = []
    for name in ("main_rdb", "weekly_rdb", "modified_rdb", "sales_reporting_logic"):
        df = tables.get(name)
        if df is not None:
            parts.append(df.agg(F.count(F.lit(1)).alias("n"))
                         .select(F.lit(name).alias("table"), "n"))
    return union_by_name(*parts)


METRICS = "build_metrics"


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """``df`` with its row count and newest ``Created Date`` gathered while it is written."""
    seen = Observation()
    created = c("Created Date") if "Created Date" in df.columns else F.lit(None).cast("timestamp_ntz")
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.max(created).alias("max_created")), seen


def stored_counts(metrics: DataFrame) -> DataFrame:
    """A7 from the metrics stored with the tables (no table is read)."""
    names = ["main_rdb", "weekly_rdb", "modified_rdb", "sales_reporting_logic"]
    return metrics.where(F.col("table").isin(names)).select("table", F.col("rows").alias("n"))


def stored_watermark(metrics: DataFrame) -> DataFrame:
    """A1 from the metrics stored with the tables: one row, null if no date is known."""
    return metrics.agg(F.max(F.when(F.col("table") == "main_rdb", F.col("max_created"))).alias("watermark"))


def existing_new_counts(p2rdb: DataFrame, p1rdb: DataFrame) -> DataFrame:
    """A3 on the de-duplicated new snapshot."""
    return common_new_counts(p2rdb, p1rdb)


def run_build(tables_in: dict[str, DataFrame], params: BuildParams, out_dir: str,
              fmt: str = "parquet", by_key: bool = False) -> dict[str, DataFrame]:
    """Write every built table under ``out_dir`` (overwrite) in three stages and
    return the tables read back from the files.

    1. the cleaned snapshots and logs (each reads its raw input once);
    2. dedupe and the incremental merge, from the *written* cleaned tables;
    3. the status table, from the written merged tables.

    Every stage starts from stored files, so no table re-derives another's
    lineage and a lost executor never forces the cleaning chain to rerun.  The
    independent tables of a stage are written as concurrent jobs, so small jobs
    do not leave the rest of the cluster idle.

    ``by_key``: the inputs lie by key, and so does every table that is stored (``write_by_key``):
    de-duplication, flags, the status rule and later work by key then move no rows.  Where a key
    is crowded, the same files are read as plain ones from stage 2 on.
    """
    from ..sources.writers import read_by_key, stored_options, write_by_key, write_table

    spark = tables_in["p1"].sparkSession
    own = {name: params_of(name, df, params) for name, df in tables_in.items()}
    metrics: dict = {}
    keyed = by_key and fmt == "parquet"

    def read(path: str) -> DataFrame:
        return read_by_key(spark, path) if keyed else spark.read.format(fmt).load(path)

    def store_all(frames: dict) -> dict:
        """Write independent tables as concurrent jobs; read each back."""
        live = {n: f for n, f in frames.items() if f is not None}

        def store(name: str) -> str:
            frame, seen = observed(live[name])
            path = (write_by_key(frame, out_dir, name) if keyed
                    else write_table(frame, out_dir, name, fmt, options=stored_options(fmt)))
            metrics[name] = seen.get
            return path

        with ThreadPoolExecutor(max_workers=max(1, len(live))) as pool:
            paths = dict(zip(live, pool.map(store, live)))
        return {n: read(p) for n, p in paths.items()}

    out = store_all({
        "p1rdb": clean_potentials(tables_in["p1"], **own["p1"].cleaning()),
        "p2rdb_all": clean_new_snapshot(tables_in["p2"], own["p2"]),
        "dsr1rdb": clean_activities(tables_in["dsr1"], **own["dsr1"].cleaning()),
        "dsr2rdb": clean_activities(tables_in["dsr2"], **own["dsr2"].cleaning()),
    })
    if keyed and crowded_key(*out.values()):
        keyed = False  # one task would take all rows of that key
        out = {n: read(f"{out_dir.rstrip('/')}/{n}") for n in out}
    p2_all = out["p2rdb_all"]
    dup_keys = spark.read.format(fmt).load(write_table(duplicate_keys(p2_all), out_dir, "p2rdb_duplicate_keys", fmt))
    deduped = dedupe_keep_first(p2_all, KEY, params.load_order)
    flagged = FLAG not in p2_all.columns  # de-duplicated and flagged in one shuffle, then stored without the flag
    out.update(store_all({
        "p2rdb_duplicates": duplicate_rows(p2_all, keys=dup_keys),
        "p2rdb" if flagged else "p2rdb_deduped": stored_snapshot(deduped, out["p1rdb"]) if flagged else deduped,
        "main_rdb": union_by_name(out["p1rdb"], out["dsr1rdb"]),
    }))
    p2 = out["p2rdb"].select(*[c(n) for n in p2_all.columns]) if flagged else out["p2rdb_deduped"]
    # the watermark was gathered while the table was written; a literal that filters push to scans
    wm = None
    if "Created Date" in out["main_rdb"].columns:
        mark = metrics["main_rdb"]["max_created"]
        wm = F.lit(None).cast("timestamp_ntz") if mark is None else ntz_lit(mark)
    merged = incremental_merge(out["p1rdb"], p2, out["dsr1rdb"], out["dsr2rdb"], out["main_rdb"], wm)
    out.update(store_all({name: merged[name] for name in (
        "p2rdb_filtered", "dsr2rdb_filtered", "weekly_rdb", "modified_rdb")}
        | ({"p2rdb_deduped": p2} if flagged else {"p2rdb": stored_snapshot(p2, out["p1rdb"])})))
    srl = sales_reporting(out["p2rdb_deduped"], out["p1rdb"], out["dsr2rdb"], out["modified_rdb"],
                          dsr_tiebreak=params.dsr_tiebreak, main_tiebreak=params.main_tiebreak,
                          date_formats=own["p2"].date_formats, busy=busy_keys(out["dsr2rdb"]))
    out.update(store_all({"sales_reporting_logic": srl}))
    rows = [(name, m["rows"], m["max_created"]) for name, m in sorted(metrics.items())]
    seen = spark.createDataFrame(rows, "table string, rows long, max_created timestamp_ntz")
    out[METRICS] = spark.read.format(fmt).load(write_table(seen, out_dir, METRICS, fmt))
    return out | _old_side(out)


SNAPSHOTS, ACTIVITIES, MERGED, STATUS = "snapshots", "activities", "modified_rdb", "sales_reporting_logic"


def run_load(inputs: dict[str, DataFrame], params: BuildParams, out_dir: str, load_date: str,
             by_key: bool = False) -> dict[str, DataFrame]:
    """One load of a build that goes on: a snapshot ``p`` and an activity log ``dsr`` of one date.

    Every table is kept by load date and only this date's part is written, so a load can be run
    again (late or corrected exports) without the others being read whole or written.  The
    first load is taken whole; each later one is cleaned, de-duplicated and merged past the
    watermark of the loads before it, and its status table compares its snapshot with the last
    one before.  Returns the load's own snapshot and status table and the merged table up to it.
    ``by_key``: as in ``run_build``, for the load's snapshot and log.
    """
    from ..sources.loads import loads_before, merge_load, read_loads, write_load
    from ..sources.writers import read_by_key

    spark = inputs["p"].sparkSession
    base = out_dir.rstrip("/")
    own = {name: params_of(name, inputs[name], params) for name in ("p", "dsr")}
    before = loads_before(spark, f"{base}/{SNAPSHOTS}", load_date)

    def stored(name: str, df: DataFrame, by_key: bool = False) -> DataFrame:
        path = write_load(df, f"{base}/{name}", load_date, by_key=by_key)
        plain = spark.read.parquet(path)
        kept = read_by_key(spark, path) if by_key else None
        return plain if kept is None or crowded_key(kept) else kept

    snapshot = clean_new_snapshot(inputs["p"], own["p"]) if before else clean_potentials(inputs["p"], **own["p"].cleaning())
    snapshot = stored(SNAPSHOTS, dedupe_keep_first(snapshot, KEY, params.load_order) if before else snapshot, by_key)
    activities = stored(ACTIVITIES, clean_activities(inputs["dsr"], **own["dsr"].cleaning()), by_key)
    merge_load(snapshot, activities, f"{base}/{MERGED}", load_date, first=not before)
    merged = read_loads(spark, f"{base}/{MERGED}", upto=load_date)
    out = {SNAPSHOTS: snapshot, MERGED: merged}
    if before:
        last = spark.read.parquet(f"{base}/{SNAPSHOTS}/load_date={before[-1]}")
        srl = sales_reporting(snapshot, last, activities, merged, dsr_tiebreak=params.dsr_tiebreak,
                              main_tiebreak=params.main_tiebreak, date_formats=own["p"].date_formats,
                              busy=busy_keys(activities))
        out[STATUS] = stored(STATUS, srl)
    return out
