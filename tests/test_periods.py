import datetime as dt

import pytest
from pyspark.sql import functions as F

from stagecraft.functions import periods as PD


def test_week_window_sunday():
    sun = dt.date(2000, 3, 5)
    assert PD.period_days(PD.LAST_WEEK, sun) == (dt.date(2000, 2, 27), dt.date(2000, 3, 5))
    assert PD.period_days(PD.CURRENT_WEEK, sun) == (dt.date(2000, 3, 5), dt.date(2000, 3, 12))


def test_fiscal_year():
    assert PD.period_days(PD.CURRENT_FY, "2024-03-31")[0] == dt.date(2023, 4, 1)
    assert PD.period_days(PD.CURRENT_FY, "2024-04-01")[0] == dt.date(2024, 4, 1)


def test_custom_and_till_date():
    with pytest.raises(ValueError):
        PD.period_days(PD.CUSTOM, start="2024-02-01", end="2024-01-01")
    assert PD.period_range(PD.TILL_DATE, "2024-01-01") == (None, None)
    lo, hi = PD.period_range(PD.CUSTOM, start="2024-01-01", end="2024-01-31")
    assert hi == dt.datetime(2024, 2, 1)


def test_column_form_matches_scalar(spark):
    days = [dt.date(2023, 12, 20) + dt.timedelta(days=i) for i in range(500)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    cols = []
    for cr in PD.CALENDAR_CRITERIA:
        cols += [PD.period_start_col(cr, F.col("d")), PD.period_end_col(cr, F.col("d"))]
    for r in df.select("d", *cols).collect():
        for i, cr in enumerate(PD.CALENDAR_CRITERIA):
            assert (r[1 + 2 * i], r[2 + 2 * i]) == PD.period_days(cr, r[0]), (cr, r[0])


def test_labels(spark):
    df = spark.createDataFrame([(dt.date(2024, 5, 7),)], "d date")
    r = df.select(*[PD.period_label_col(cr, F.col("d")) for cr in PD.CALENDAR_CRITERIA]).first()
    assert r[2] == "Current Month: May 2024"
    assert r[4] == "Current Quarter: Q2 (April - June) 2024"
    assert r[5] == "Current Financial Year: 2024-2025"


def test_custom_label(spark):
    from pyspark.sql import functions as F

    from stagecraft.functions import periods as PD
    row = spark.range(1).select(PD.period_label_col(PD.CUSTOM, F.current_date(), "2024-01-05", "2024-02-01")).first()
    assert row[0] == "From: 2024-01-05 To: 2024-02-01"
