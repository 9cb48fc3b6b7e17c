import datetime as dt

from stagecraft.operators import lookup as LK

T = dt.datetime


def test_facet_cascade(spark):
    srl = spark.createDataFrame(
        [("S1", "C1", "A", "k1"), ("S1", "C2", "B", "k2"), ("S2", "C1", "B", "k3"),
         ("S1", " ", "A", "k4"), (None, "C3", "A", "k5")],
        "`State/UT` string, `Company Name` string, `Potential Code` string, `Potential No.` string")
    f = LK.facet_cascade(srl, state="S1", company="C1", code="B")
    assert [r[0] for r in f["State/UT"].collect()] == ["S1", "S2"]
    assert [r[0] for r in f["Company Name"].collect()] == ["C1", "C2"]      # blank dropped
    assert [r[0] for r in f["Potential Code"].collect()] == ["A", "B"]      # by company only
    assert [r[0] for r in f["Potential No."].collect()] == ["k3"]


def test_drill_down_details(spark):
    modified = spark.createDataFrame(
        [("k1", T(2024, 1, 1), "S-old", None, None, 1), ("k1", T(2024, 2, 1), "S-new", None, None, 2),
         ("k2", T(2024, 1, 5), "S2", "R-9", None, 3), ("k2", T(2024, 1, 4), "S2b", "  ", None, 4),
         ("k3", T(2024, 1, 5), "S3", None, None, 5)],
        "`Potential No.` string, `Modified Date` timestamp_ntz, Stage string, `Report ID` string, "
        "`DSR Type` string, _seq long")
    keys = spark.createDataFrame([("k1",), ("k2",)], "`Potential No.` string")
    bm = spark.createDataFrame([("u", "k2", T(2024, 1, 1), 1)],
                               "user string, potential_no string, timestamp timestamp_ntz, seq long")
    out = LK.drill_down_details(modified, keys, bm, "u", tiebreak=["_seq"])
    assert out.columns[:2] == ["Potential No.", "BM"]
    assert "Report ID" not in out.columns and "Modified Date" not in out.columns
    got = sorted((r["Potential No."], r["BM"], r["Stage"]) for r in out.collect())
    # k2's newest row has a report id, so the blank-report row is the one shown
    assert got == [("k1", False, "S-new"), ("k2", True, "S2b")]


def test_latest_details_skips_activity_rows(spark):
    modified = spark.createDataFrame(
        [("k1", T(2024, 1, 1), "Main", None, 1), ("k1", None, "Act", "DSR", 2)],
        "`Potential No.` string, `Modified Date` timestamp_ntz, Stage string, `DSR Type` string, _seq long")
    d = LK.potential_details(modified, tiebreak=["_seq"]).collect()
    assert [(r["Potential No."], r["Stage"], r["Modified Date"]) for r in d] == \
        [("k1", "Main", dt.date(2024, 1, 1))]


def test_find_potential_spans_states(spark):
    from stagecraft.operators import lookup as LK
    srl = spark.createDataFrame([("k1", "S1", "C1", "A"), ("k2", "S2", "C1", "A"), ("k3", "S1", "C2", "A")],
                                "`Potential No.` string, `State/UT` string, `Company Name` string,"
                                " `Potential Code` string")
    modified = srl.selectExpr("`Potential No.`", "cast(null as string) as `DSR Type`",
                              "timestamp_ntz'2024-01-01 00:00:00' as `Modified Date`")
    details, _ = LK.find_potential(srl, modified, "S1", "C1")
    assert sorted(r["Potential No."] for r in details.collect()) == ["k1", "k2"]
    details, _ = LK.find_potential(srl, modified, "S1")
    assert sorted(r["Potential No."] for r in details.collect()) == ["k1", "k3"]


def test_no_row_is_in_neither_snapshot_or_log(spark):
    from stagecraft.sources import derived as dv
    sf = "/root/testdata/sf0.001"
    base, li = dv.base(spark, sf), dv.dsr(spark, sf)
    seen = dv.p1(spark, sf).select("k").unionByName(dv.p2(spark, sf).select("k"))
    assert base.join(seen, "k", "left_anti").count() == 0
    logged = dv.dsr1(spark, sf).select("k", "l_linenumber").unionByName(dv.dsr2(spark, sf).select("k", "l_linenumber"))
    assert li.join(logged, ["k", "l_linenumber"], "left_anti").count() == 0
