"""Forms that keep their cost in proportion on larger tables."""

import datetime as dt
import os
import random
import re

from pyspark.sql import functions as F

from stagecraft import registry
from stagecraft.columns import KEY, c
from stagecraft.functions import dates
from stagecraft.operators import asof, lookup, status
from stagecraft.operators.clean import parse_dates_dayfirst
from stagecraft.plans import build, reports, stored
from stagecraft.registry import PARAMS, raw_inputs
from stagecraft.sources import derived as dv
from stagecraft.sources import ordered as OD

SMOKE = "/root/testdata/sf0.001"


def test_parsing_many_date_columns_stays_compilable(spark, capsys):
    names = [f"d{i}" for i in range(6)]
    df = spark.range(3).select(*[F.concat(F.lit("0"), (F.col("id") + 1).cast("string"), F.lit("/02/2000 09:30")).alias(n)
                                 for n in names])
    out = parse_dates_dayfirst(df, names)
    out.explain(mode="codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000  # the JVM leaves longer methods uncompiled
    assert sorted(str(r["d5"]) for r in out.collect()) == [f"2000-02-0{i} 09:30:00" for i in (1, 2, 3)]


def test_numbering_by_file_sends_only_the_block_table(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(40).withColumn("v", F.col("id") % 3).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = OD.number_by_file(spark.read.parquet(path))
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = sorted((r["id"], r["_seq"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == [(i, i) for i in range(40)]
    assert re.search(r"BroadcastHashJoin \[_file#\d+, _at#", plan)


def test_export_files_stay_small_as_rows_grow(spark, monkeypatch):
    rows = dv.read_table(spark, SMOKE, "lineitem").count()
    monkeypatch.setattr(stored, "_EXPORT_ROWS", max(1, rows // 40), raising=False)
    stored_files = [f for f in os.listdir(stored._exported(spark, SMOKE).removeprefix("file:")) if f.startswith("part-")]
    assert len(stored_files) >= 40


def test_full_width_texts_parse_as_the_pattern_parser_does(spark, monkeypatch):
    assert dates.full_width("d/M/yyyy H:mm") and dates.full_width("yyyy-MM-dd H:mm:ss")
    assert not any(map(dates.full_width, ("d/M/yy", "ddMMyyyy", "d MMM yyyy", "d/M/yyyy H", "d/M/yyyy'T'H:mm", "d/d/yyyy", "")))
    texts = ["01/02/2000 09:30", "1/2/2000 9:30", "31/02/2000 09:30", "29/02/2000 23:59", "29/02/1900 00:00", "01/13/2000 09:30",
             "01/02/2000 24:00", "01/02/2000 09:60", "01/02/0000 09:30", "00/01/2000 00:00", "01/02/2000 09:30\n", " 01/02/2000 09:30",
             "01/02/2000 09:30:61", "01/02/2000 09:30:59", "01/02/2000", "2000-02-01", "01-02-2000 09:30", "+1/02/2000 09:30",
             "01/02/20000 09:30", "٠١/02/2000 09:30", "", None, "x", "1 /02/2000 09:30", "25/12/9999 23:59", "12/25/2000"]
    rnd = random.Random(3)
    texts += ["".join(rnd.choice("0123456789/ :") if rnd.random() < 0.1 else x for x in "07/11/2003 21:45") for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    layouts = [dates.DAYFIRST_FORMATS, ("d/M/yyyy", "M/d/yyyy"), ("yyyy-MM-dd",), ("M/d/yyyy H:mm",)]

    def rows():
        return [tuple(r) for r in df.select("t", *[dates.parse_dayfirst(F.col("t"), f).cast("string") for f in layouts]).collect()]

    got = rows()
    monkeypatch.setattr(dates, "full_width", lambda layout: None)
    assert got == rows()
    assert got[0][1] == "2000-02-01 09:30:00"


def _activities(spark):
    rnd, day = random.Random(5), dt.datetime(2024, 3, 1)
    rows = [(rnd.choice(["a", "b", "b", "b", "c", None]), rnd.choice([None, day + dt.timedelta(days=rnd.randrange(4), hours=rnd.randrange(3))]),
             rnd.choice([None, day + dt.timedelta(hours=rnd.randrange(9))]), f"O{i}", f"N{i}", i) for i in range(150)]
    return spark.createDataFrame(rows, "`Potential No.` string, `Contacted Date` timestamp_ntz, `Created Date` timestamp_ntz, "
                                       "`Original Stage` string, `New Stage` string, seq long")


def test_day_summary_is_shuffled_once_by_key(spark):
    dsr = _activities(spark)
    assert sorted(status.busy_keys(dsr, most=40)) == ["b"] and status.busy_keys(dsr) == []
    want = sorted(map(str, status.activity_day_summary(dsr, tiebreak=["seq"]).collect()))
    for busy in ([], ["b"], ["a", "b", "c"]):
        names = status.activity_day_summary(dsr, tiebreak=["seq"]).columns
        days = status.activity_day_summary(dsr, tiebreak=["seq"], busy=busy)
        assert sorted(map(str, days.select(*names).collect())) == want
    plan = status.activity_day_summary(dsr, tiebreak=["seq"], busy=[]).groupBy("_k").agg(F.max("_last"))
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_asof_of_calm_keys_is_shuffled_once(spark, monkeypatch):
    right = _activities(spark)
    left = spark.createDataFrame([("a", 0), ("b", 1), ("b", 3), ("c", None), ("d", 2), (None, 2)], "`Potential No.` string, n int").select(
        c(KEY), "n", F.timestamp_add("DAY", F.col("n"), F.lit("2024-03-02").cast("timestamp_ntz")).alias("md"))

    def found(blocks=None):
        return asof.asof_before(left, right, KEY, F.col("md"), c("Contacted Date"), F.struct(c("New Stage"), "seq"), [c("seq")], blocks=blocks)

    want = sorted(map(str, found(blocks=3).collect()))
    plan = found()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and sorted(map(str, found().collect())) == want
    monkeypatch.setattr(status, "BUSY_ROWS", 40)
    assert sorted(map(str, found().collect())) == want


def test_build_moves_the_snapshot_once_for_dedupe_and_flag(spark, tmp_path, monkeypatch):
    flagged = []
    monkeypatch.setattr(build, "stored_snapshot", lambda p2, p1, real=build.stored_snapshot: flagged.append(p2) or real(p2, p1))
    out = build.run_build(raw_inputs(spark, SMOKE), PARAMS, str(tmp_path))
    plan = build.stored_snapshot(flagged[0], out["p1rdb"])._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in plan.splitlines() if "Exchange hashpartitioning(Potential No." in x]
    assert "WindowGroupLimit" in plan and len(wide) == 1  # the window's exchange serves the join
    p2 = out["p2rdb_deduped"]
    assert p2.columns == out["p2rdb_all"].columns and "Flag" not in p2.columns
    assert out["p2rdb"].select(*map(c, p2.columns)).exceptAll(p2).count() == 0 and p2.count() == out["p2rdb"].count()
    twice = out["p2rdb_all"].groupBy(c(KEY)).count().where("count > 1").agg(F.sum("count")).first()[0]
    assert out["p2rdb_duplicates"].count() == twice


def test_stored_tables_have_files_of_few_rows(spark, tmp_path, monkeypatch):
    from stagecraft.sources import writers

    monkeypatch.setattr(writers, "STORED_ROWS", 500)
    out = build.run_build(raw_inputs(spark, SMOKE), PARAMS, str(tmp_path))
    per_file = out["modified_rdb"].groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert per_file <= 500


def test_stored_inputs_have_the_rows_of_the_raw_ones(spark):
    raw, kept = raw_inputs(spark, SMOKE), registry.stored_inputs(spark, SMOKE)
    for name, df in raw.items():
        assert kept[name].dtypes == df.dtypes
        assert kept[name].exceptAll(df).count() == 0 and df.exceptAll(kept[name]).count() == 0
    plan = kept["dsr1"].unionByName(kept["dsr2"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # the line items are joined once, before


def test_tables_stored_by_key_move_no_rows_for_work_by_key(spark):
    t = registry.tables(spark, SMOKE)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [registry.QUERIES[name](spark, SMOKE)
                 for name in ("sales_reporting", "keys_semi_filter", "filter_in_keys_blank_report")]
        found.append(build.stored_snapshot(build.dedupe_keep_first(t["p2rdb_all"], KEY, PARAMS.load_order), t["p1rdb"]))
        # history_export_by_key: only the export's own order moves rows
        found.append(lookup.history_for_export(t["modified_rdb"], reports._cb_keys(spark, SMOKE)))
        for df in found:
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_build_by_key_equals_the_plain_one_also_with_a_crowded_key(spark, tmp_path, monkeypatch):
    want = build.run_build(raw_inputs(spark, SMOKE), PARAMS, str(tmp_path / "plain"))
    for most in (50_000, 3):
        monkeypatch.setattr(status, "BUSY_ROWS", most)
        got = build.run_build(registry.stored_inputs(spark, SMOKE), PARAMS, str(tmp_path / f"by_key_{most}"), by_key=True)
        assert set(got) == set(want)
        bucketed = "Bucketed: true" in got["p2rdb"].groupBy(c(KEY)).count()._jdf.queryExecution().executedPlan().toString()
        assert bucketed == (most > 3)  # a crowded key: plain files, so that no task takes all its rows
        for name in want:
            assert got[name].columns == want[name].columns
            assert got[name].exceptAll(want[name]).count() == 0 and want[name].exceptAll(got[name]).count() == 0, name


def test_crowded_key_counts_null_as_a_key(spark):
    df = spark.createDataFrame([("a",)] * 3 + [(None,)] * 5, "`Potential No.` string")
    one = spark.createDataFrame([("b",)], "`Potential No.` string")
    assert status.crowded_key(one, df, most=4) and not status.crowded_key(one, df, most=5)
    assert status.crowded_key(df.where("`Potential No.` is not null"), most=2)


def test_history_of_calm_keys_is_numbered_without_blocks(spark, monkeypatch):
    acts = _activities(spark).withColumn("DSR Type", F.lit("DSR"))

    def numbers():
        rows = lookup.numbered_history(acts, tiebreak=["seq"])
        return rows, sorted(map(str, rows.collect()))

    monkeypatch.setattr(status, "BUSY_ROWS", 0)  # all keys in blocks, the form for busy ones
    want = numbers()[1]
    assert len(want) == acts.where("`Potential No.` is not null").count()
    for most in (40, 50_000):
        monkeypatch.setattr(status, "BUSY_ROWS", most)
        rows, got = numbers()
        assert got == want and rows.schema["No."].dataType.typeName() == "long"
    plan = lookup.numbered_history(acts, tiebreak=["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Scan ExistingRDD[Potential No." in plan  # no checkpoint


def test_loads_by_key_equal_the_build_and_move_no_activities(spark, tmp_path, monkeypatch):
    given, same = registry.stored_inputs(spark, SMOKE), registry.tables(spark, SMOKE)
    seen = []
    monkeypatch.setattr(build, "sales_reporting", lambda *a, real=build.sales_reporting, **k: seen.append(a) or real(*a, **k))
    for most, rounds in ((50_000, 2), (3, 1)):
        monkeypatch.setattr(status, "BUSY_ROWS", most)
        out = str(tmp_path / f"loads_{most}")
        build.run_load({"p": given["p1"], "dsr": given["dsr1"]}, PARAMS, out, "2000-01-01", by_key=True)
        for _ in range(rounds):  # a rerun replaces its own load
            done = build.run_load({"p": given["p2"], "dsr": given["dsr2"]}, PARAMS, out, "2000-01-08", by_key=True)
        days = status.activity_day_summary(seen[-1][2], busy=[])._jdf.queryExecution().executedPlan().toString()
        assert ("Exchange" in days) == (most == 3)
        for name, want in ((build.MERGED, same["modified_rdb"]), (build.STATUS, same["sales_reporting_logic"])):
            got = done[name].select(*[c(n) for n in want.columns])
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
