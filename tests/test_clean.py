import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagecraft.columns import c
from stagecraft.functions.text import digits_only, stage_number, stage_sort_number
from stagecraft.operators import clean as CL
from stagecraft.operators.ranking import dedupe_keep_first, duplicate_rows
from stagecraft.sources.readers import normalize_nulls


def test_parse_dates_dayfirst(spark):
    df = spark.createDataFrame([("15/03/2024 10:20",), ("5/3/2024 9:20",), ("16/03/2024",),
                                ("x",), (None,)], "d string")
    both = [r[0] for r in CL.parse_dates_dayfirst(df, ["d"]).collect()]
    assert both[2] == dt.datetime(2024, 3, 16)      # default layouts include a date alone
    got = [r[0] for r in CL.parse_dates_dayfirst(df, ["d"], {"d": ["d/M/yyyy H:mm"]}).collect()]
    assert got == [dt.datetime(2024, 3, 15, 10, 20), dt.datetime(2024, 3, 5, 9, 20),
                   None, None, None]
    assert CL.parse_dates_dayfirst(df, ["d"]).schema["d"].dataType.typeName() == "timestamp_ntz"


def test_parse_dates_several_formats(spark):
    df = spark.createDataFrame([("16/03/2024",), ("15/03/2024 10:20",)], "d string")
    got = [r[0] for r in CL.parse_dates_dayfirst(df, ["d"], ("d/M/yyyy H:mm", "d/M/yyyy"))
           .collect()]
    assert got == [dt.datetime(2024, 3, 16), dt.datetime(2024, 3, 15, 10, 20)]


def test_map_stage(spark):
    df = spark.createDataFrame([("7 First Quote",), ("Closed Won",), ("70 - Demo/Trials",),
                                (None,)], "Stage string")
    got = [r[0] for r in CL.map_stage(df).collect()]
    assert got == ["60 - Value Proposition", "100 - Billed", "70 - Demo/Trials", None]


def test_map_stage_idempotent(spark):
    df = spark.createDataFrame([("2 Final Quote",), ("Closed Lost",)], "Stage string")
    once = CL.map_stage(df)
    assert once.collect() == CL.map_stage(once).collect()


def test_canonical_executive(spark):
    df = spark.createDataFrame([("A",), ("B",), ("C",), (None,)], "Executive string")
    got = [r[0] for r in CL.canonical_executive(df, {"A": "B"}, ["B"]).collect()]
    assert got == ["B - (EX)", "B - (EX)", "C", None]


def test_coalesce_contact_mode(spark):
    df = spark.createDataFrame([("d", "m"), (None, "n")],
                               "`Mode of Contact (DSR)` string, `Mode of Contact` string")
    out = CL.coalesce_contact_mode(df)
    assert out.columns == ["Mode of Contact"]
    assert [r[0] for r in out.collect()] == ["d", "n"]
    only = spark.createDataFrame([("d",)], "`Mode of Contact (DSR)` string")
    assert CL.coalesce_contact_mode(only).columns == ["Mode of Contact"]


def test_backfill_new_stage(spark):
    df = spark.createDataFrame([("o", None), ("o", "n"), (None, None)],
                               "`Original Stage` string, `New Stage` string")
    assert [r[1] for r in CL.backfill_new_stage(df).collect()] == ["o", "n", None]


def test_filter_min_date(spark):
    t = dt.datetime(2021, 1, 1)
    day = dt.timedelta(days=1)
    df = spark.createDataFrame([(1, t, None), (2, t - day, t), (3, None, None),
                                (4, t - day, t - day)],
                               "id int, `Created Date` timestamp_ntz, `Modified Date` timestamp_ntz")
    assert sorted(r[0] for r in CL.filter_min_date(df, "2021-01-01").collect()) == [1, 2]
    only_c = df.drop("Modified Date")
    assert sorted(r[0] for r in CL.filter_min_date(only_c, "2021-01-01").collect()) == [1]


def test_dedupe_keep_first_nulls_group(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), (None, 2), (None, 3), ("b", 4)],
                               "`Potential No.` string, _seq long")
    got = sorted((r[0] or "", r[1]) for r in dedupe_keep_first(df).collect())
    assert got == [("", 2), ("a", 0), ("b", 4)]


def test_duplicate_rows_null_equal(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), (None, 2), (None, 3), ("b", 4)],
                               "`Potential No.` string, _seq long")
    assert sorted(r[1] for r in duplicate_rows(df).collect()) == [0, 1, 2, 3]


def test_stage_number_and_digits(spark):
    df = spark.createDataFrame([("80 - Final Quote",), ("abc",), (None,)], "s string")
    got = df.select(stage_number(F.col("s")), stage_sort_number(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [(80, 80), (None, 2147483647), (None, 2147483647)]
    k = spark.createDataFrame([("ENQ-00123/A",), ("abc",), ("9" * 40,)], "k string")
    assert [r[0] for r in k.select(digits_only(F.col("k"), 31)).collect()] == ["00123", "Sheet1",
                                                                              "9" * 31]
    assert [r[0] for r in k.select(digits_only(F.col("k"))).collect()] == ["00123", "Sheet1", "9" * 40]


def test_rename_collision_raises(spark):
    df = spark.createDataFrame([("x", "y")],
                               "`Company Name` string, `Company Name (Company Name)` string")
    with pytest.raises(ValueError):
        CL.rename_columns(df, {"Company Name (Company Name)": "Company Name"})


def test_drop_and_ensure_columns(spark):
    df = spark.createDataFrame([("k", 1)], "`Potential No.` string, `Record Id` int")
    out = CL.ensure_columns(CL.drop_columns_if_present(df, ["Record Id", "absent"]),
                            ["Potential No.", "Stage", "Enquiry Date"],
                            {"Enquiry Date": "timestamp_ntz"})
    assert out.columns == ["Potential No.", "Stage", "Enquiry Date"]
    assert out.collect()[0][0] == "k"


def test_normalize_nulls(spark):
    df = spark.createDataFrame([("NA",), ("n/a",), ("",), ("ok",), ("#N/A",), (None,)], "x string")
    assert [r[0] for r in normalize_nulls(df).collect()] == [None, None, None, "ok", None, None]


def test_map_owner_with_frame(spark):
    df = spark.createDataFrame([("O1",), ("O2",), (None,)], "`Potential Owner` string")
    m = spark.createDataFrame([("O1", "o1@example.org")], "label string, address string")
    got = sorted(r[0] or "" for r in CL.map_owner(df, m).collect())
    assert got == ["", "O2", "o1@example.org"]
    assert df.select(c("Potential Owner")).first()[0] == "O1"


def test_parse_dates_zone_free(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("2/4/2000 2:30",), ("31/02/2000 1:00",)], "d string")
        got = [r[0] for r in CL.parse_dates_dayfirst(df, ["d"]).collect()]
        assert got == [dt.datetime(2000, 4, 2, 2, 30), None]   # inside the DST gap, unshifted
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
