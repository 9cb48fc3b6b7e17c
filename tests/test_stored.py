"""Stored forms: layouts per column, load order over files, dated loads, buckets, as-of carry,
clustered files, pickers at once, numbered rows, logs folded day by day."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stagecraft.columns import SRL_DATE_COLUMNS, c
from stagecraft.operators import asof, layouts, logs, lookup, sequences
from stagecraft.plans import bucketed, build
from stagecraft.registry import PARAMS, raw_inputs, tables
from stagecraft.sources import clustered, loads, ordered, readers
from stagecraft.sources.writers import shared_dir

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("text,layout", [
    ("15/03/2024 10:20", "d/M/yyyy H:mm"), ("04/13/2024", "M/d/yyyy"), ("1.2.2024", "d.M.yyyy"),
    ("2024-03-04", "yyyy-d-M"), ("2024-03-15", "yyyy-M-d"), ("2024-03-15T10:20:30", "yyyy-M-d'T'H:mm:ss"),
    ("05-06-2024 3:05 PM", "d-M-yyyy h:mm a"), ("15/03-2024", None), ("32/32/2024", None), ("soon", None), ("", None)])
def test_layout_of_first_text(spark, text, layout):
    df = spark.createDataFrame([(3, "09/09/2024"), (1, None), (2, f" {text} ")], "_seq long, `Created Date` string")
    rows = layouts.infer_layouts(df, ["Created Date", "absent"]).collect()
    assert [tuple(r) for r in rows] == [("Created Date", text, layout)]


def test_layout_report_refuses_other_layouts(spark):
    df = spark.createDataFrame([(1, "15/03/2024 10:20", None), (2, "16/03/2024", None), (3, "1/2/2024 9:05", None)],
                               "_seq long, a string, b string")
    got = {r["column"]: (r["layout"], r["parsed"], r["refused"]) for r in layouts.layout_report(df, ["a", "b"]).collect()}
    assert got == {"a": ("d/M/yyyy H:mm", 2, 1), "b": (None, 0, 0)}
    assert layouts.layout_report(df, []).count() == 0
    assert layouts.inferred_formats(df, ["a"]) == {"a": ("d/M/yyyy H:mm",)}
    empty = layouts.layout_report(df.limit(0), ["a"]).collect()
    assert [tuple(r) for r in empty] == [("a", None, None, 0, 0)]


def test_build_with_inferred_layouts(spark):
    given = raw_inputs(spark, SF)
    out = build.run_build(given, build.replace(PARAMS, date_formats=build.INFERRED), shared_dir(spark))
    same = tables(spark, SF)
    for name in ("p1rdb", "modified_rdb", "sales_reporting_logic"):
        assert out[name].exceptAll(same[name]).count() == 0 and same[name].exceptAll(out[name]).count() == 0


def test_metrics_are_those_of_the_tables(spark):
    t = tables(spark, SF)
    seen = {r["table"]: r for r in t[build.METRICS].collect()}
    assert {r["table"]: r["n"] for r in build.stored_counts(t[build.METRICS]).collect()} == \
        {r["table"]: r["n"] for r in build.record_counts(t).collect()}
    for name in ("main_rdb", "p2rdb_all", "weekly_rdb"):
        newest = t[name].agg(F.max(c("Created Date"))).first()[0]
        assert seen[name]["max_created"] == newest and seen[name]["rows"] == t[name].count()


def test_quoted_line_breaks_are_read_by_default(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Potential No.,Description\n1,"two\nlines, ""quoted"""\n2,NA\n')
    rows = [tuple(r) for r in readers.scan_csv(spark, str(tmp_path / "a.csv")).collect()]
    assert rows == [("1", 'two\nlines, "quoted"'), ("2", None)]


def test_load_order_is_the_same_whatever_the_splits(spark, tmp_path):
    for name, lo, hi in (("a.csv", 0, 700), ("b.csv", 700, 701), ("c.csv", 701, 2000)):
        (tmp_path / name).write_text("n,a.b\n" + "".join(f"{i},text number {i}\n" for i in range(lo, hi)))
    (tmp_path / "d.csv").write_text("n,a.b\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = set()
    try:
        for size in ("128m", "3k", "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0" if size != "128m" else "4m")
            df = readers.scan_csv(spark, str(tmp_path), multi_line=False)
            rows = ordered.number_by_file(df).collect()
            seen.add(df.rdd.getNumPartitions())
            assert sorted((r["_seq"], r["n"]) for r in rows) == [(i, str(i)) for i in range(2000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", "4m")
    assert len(seen) > 1


def test_a_rerun_replaces_its_own_day(spark, tmp_path):
    def day(*rows):
        return spark.createDataFrame([(i, dt.datetime(2024, 1, d), dt.datetime(2024, 1, m)) for i, d, m in rows],
                                     "k int, `Created Date` timestamp_ntz, `Modified Date` timestamp_ntz")

    path, none = str(tmp_path / "t"), day()
    loads.merge_load(day((1, 1, 1)), day((2, 2, 2)), path, "2024-01-03", first=True)

    def content():
        return sorted((str(r["load_date"]), r["k"]) for r in loads.read_loads(spark, path).collect())

    for _ in range(2):  # modified after the 2nd, created after it
        loads.merge_load(day((1, 1, 9), (3, 1, 2)), day((4, 5, 5), (5, 2, 2)), path, "2024-01-10")
        assert content() == [("2024-01-03", 1), ("2024-01-03", 2), ("2024-01-10", 1), ("2024-01-10", 4)]
    loads.merge_load(day((1, 1, 12)), day((6, 6, 6)).withColumn("extra", F.lit("x")), path, "2024-01-17")
    loads.merge_load(none, none, path, "2024-01-10")  # its rerun finds nothing: the later load stays
    assert content() == [("2024-01-03", 1), ("2024-01-03", 2), ("2024-01-17", 1), ("2024-01-17", 6)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_status_rule_has_no_exchange(spark):
    t = tables(spark, SF)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        inputs = bucketed.bucket_inputs(t["p2rdb_deduped"], t["p1rdb"], t["dsr2rdb"], t["modified_rdb"],
                                        dsr_tiebreak=PARAMS.dsr_tiebreak, main_tiebreak=PARAMS.main_tiebreak)
        out = bucketed.sales_reporting_bucketed(inputs)
        assert "Exchange" not in plan_of(out)
        want = t["sales_reporting_logic"]
        assert out.exceptAll(want).count() == 0 and want.exceptAll(out).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_asof_carry_against_brute_force_with_a_hot_key(spark):
    rnd = random.Random(4)
    keys = ["hot"] * 6 + ["a", "b", "c.d", None]
    left = [(i, rnd.choice(keys), rnd.choice([None, *range(40)])) for i in range(400)]
    right = [(rnd.choice(keys), rnd.choice([None, *range(40)]), rnd.randrange(5), i if i % 7 else None) for i in range(600)]
    ldf = spark.createDataFrame(left, "id int, `the.key` string, t int")
    rdf = spark.createDataFrame(right, "`the.key` string, t int, x int, v int")
    got = asof.asof_before(ldf, rdf, "the.key", c("t"), c("t"), F.struct("v", "x"), [c("x"), c("v")], blocks=16)

    def best(k, t):
        if k is None or t is None:
            return None
        rows = [(s, x, -1 if v is None else v, v) for key, s, x, v in right if key == k and s is not None and s < t]
        return (max(rows, key=lambda r: r[:3])[3], max(rows, key=lambda r: r[:3])[1]) if rows else None

    rows = got.collect()
    assert sorted(r["id"] for r in rows) == [i for i, _, _ in left]
    assert {r["id"]: None if r["_asof"] is None else tuple(r["_asof"]) for r in rows} == {i: best(k, t) for i, k, t in left}
    blocks = sequences.assign_blocks(rdf.where("t is not null").selectExpr("`the.key` as k", "t", "x", "v"), ["k"],
                                     [F.col("t").asc()], 16)
    assert blocks.where("k = 'hot'").select(sequences.BLOCK).distinct().count() > 4
    assert asof.asof_before(ldf, rdf.limit(0), "the.key", c("t"), c("t"), F.struct("v")).where("_asof is not null").count() == 0


def test_a_narrow_range_reads_fewer_files(spark, tmp_path):
    srl = tables(spark, SF)["sales_reporting_logic"]
    path = clustered.write_clustered(srl, str(tmp_path / "c"), ["Created Date", "Modified Date"], SRL_DATE_COLUMNS, files=12)
    lo = srl.agg(F.min(c("Created Date"))).first()[0]
    sizes = []
    for days in (1, 900, 10_000):
        ranges = (lo, lo + dt.timedelta(days=days))
        sizes.append(len(clustered.files_in_range(spark, path, SRL_DATE_COLUMNS, *ranges)))
        want = clustered.filter_any_date_in_range(srl, *ranges)
        got = clustered.read_in_range(spark, path, SRL_DATE_COLUMNS, *ranges)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    assert sizes[0] < sizes[1] <= sizes[2] and sizes[2] > 8
    none = clustered.read_in_range(spark, path, SRL_DATE_COLUMNS, dt.datetime(1900, 1, 1), dt.datetime(1900, 1, 2))
    assert none.count() == 0 and none.columns == srl.columns


def test_numbers_run_through_all_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("v"), (F.col("id") % 3).alias("g"))
    rows = sequences.number_rows(df, [F.col("v").asc()], blocks=7).collect()
    assert all(r["No."] == r["v"] + 1 for r in rows) and len(rows) == 5000
    inside = sequences.number_rows(df, [F.col("v").desc()], "n", ["g"], blocks=7).collect()
    for g in range(3):
        mine = sorted((r["v"] for r in inside if r["g"] == g), reverse=True)
        assert [r["v"] for r in sorted((r for r in inside if r["g"] == g), key=lambda r: r["n"])] == mine
    assert sequences.number_rows(df.limit(0), [F.col("v").asc()]).count() == 0


def test_facets_read_their_table_once(spark):
    srl = tables(spark, SF)["sales_reporting_logic"]
    some = srl.where(c("Company Name").isNotNull()).first()
    picks = (some["State/UT"], some["Company Name"], some["Potential Code"])
    got = lookup.facets_at_once(srl, *picks)
    assert plan_of(got).count("FileScan") == 1
    rows = {}
    for r in got.collect():
        rows.setdefault(r["facet"], []).append(r["value"])
    for name, df in lookup.facet_cascade(srl, *picks).items():
        assert sorted(rows[name]) == [r[0] for r in df.collect()]
    assert sorted(rows["pick Region"]) == [r[0] for r in lookup.distinct_values(srl, "Region").collect()]


def log_of(rnd, n, actions):
    rows = []
    for i in range(n):
        who = "hot" if rnd.random() < 0.5 else rnd.choice("abc")
        rows.append((who, str(rnd.randrange(4)), dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.randrange(n)),
                     rnd.choice(actions), i))
    return rows


def days_of(rows):
    cuts = [dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m) for m in (0, 60, 60, 170, 10_000)]
    return [[r for r in rows if a <= r[2] < b] for a, b in zip(cuts, cuts[1:])]


def test_bookmarks_by_day_equal_the_whole_log(spark):
    rows = log_of(random.Random(2), 300, ["add", "add", "remove"])
    schema = "user string, potential_no string, ts timestamp_ntz, action string, seq long"
    state = None
    for day in days_of(rows):
        state = logs.fold_bookmarks(state, spark.createDataFrame(day, schema))
    whole = logs.bookmark_state(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, whole.collect()))


def test_sessions_by_day_equal_the_whole_log(spark):
    rows = [(u, t, a, i) for u, _, t, a, i in log_of(random.Random(3), 300, ["login", "logout"])]
    schema = "username string, ts timestamp_ntz, action string, seq long"
    closed, still_open = [], None
    for day in days_of([(u, None, t, a, i) for u, t, a, i in rows]):
        done, still_open = logs.fold_sessions(
            still_open, spark.createDataFrame([(u, t, a, i) for u, _, t, a, i in day], schema))
        closed += map(tuple, done.collect())
        still_open = spark.createDataFrame(still_open.collect(), still_open.schema)
    closed += [(r["username"], r["ts"], None) for r in still_open.collect()]
    whole = logs.login_sessions(spark.createDataFrame(rows, schema)).collect()
    assert sorted(closed, key=str) == sorted(map(tuple, whole), key=str)


def test_dated_build_equals_the_whole_build(spark):
    raw, out, same = raw_inputs(spark, SF), shared_dir(spark), tables(spark, SF)
    first = build.run_load({"p": raw["p1"], "dsr": raw["dsr1"]}, PARAMS, out, "2000-01-01")
    assert build.STATUS not in first and first[build.MERGED].count() == same["main_rdb"].count()
    for _ in range(2):
        done = build.run_load({"p": raw["p2"], "dsr": raw["dsr2"]}, PARAMS, out, "2000-01-08")
        for name, want in ((build.MERGED, same["modified_rdb"]), (build.STATUS, same["sales_reporting_logic"])):
            got = done[name].select(*[c(n) for n in want.columns])
            assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # the first load again: it finds no earlier one and replaces itself only
    again = build.run_load({"p": raw["p1"], "dsr": raw["dsr1"]}, PARAMS, out, "2000-01-01")
    assert again[build.MERGED].count() == same["main_rdb"].count()
    assert loads.read_loads(spark, f"{out}/{build.MERGED}").count() == same["modified_rdb"].count()
