import datetime as dt

from stagecraft.functions import periods as PD
from stagecraft.operators import filters as FL

ROWS = [("A", "North", "X", dt.datetime(2024, 3, 4), None),
        ("B", "South", "Y", None, dt.datetime(2024, 3, 9)),
        ("C", "North", "X", None, None),
        ("Lead", "North", "Y", dt.datetime(2024, 2, 1), None)]
SCHEMA = ("Executive string, Region string, `Potential Code` string, "
          "`Last Contact Date` timestamp_ntz, `CS Contacted On Date` timestamp_ntz")
TEAM = {"Lead": ["Lead", "A", "B"]}


def execs(df):
    return sorted(r["Executive"] for r in df.collect())


def test_role_branches(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert execs(FL.filter_role(df, "Lead", "All", TEAM)) == ["A", "B", "Lead"]
    assert execs(FL.filter_role(df, "Lead", "B", TEAM)) == ["B"]
    assert execs(FL.filter_role(df, "Lead", "C", TEAM)) == ["Lead"]      # outside -> own rows
    assert execs(FL.filter_role(df, "C", "All", TEAM, restricted=["C"])) == ["C"]
    assert execs(FL.filter_role(df, "Z", "A", TEAM)) == ["A"]
    assert execs(FL.filter_forced_region(df, "Lead", {"Lead": "South"}, "North")) == ["B"]


def test_reports_with_and_without_range(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    lo, hi = PD.period_range(PD.CURRENT_WEEK, "2024-03-05")      # 3 Mar .. 10 Mar
    assert execs(FL.report_followup(df, lo, hi)) == ["A", "B"]
    assert execs(FL.report_followup(df)) == ["A", "B", "Lead"]
    assert execs(FL.report_pending(df, lo, hi)) == ["C"]
    chain, lo2, hi2 = FL.filter_report_chain(df, user="Lead", team=TEAM, region="North",
                                             criterion=PD.CURRENT_WEEK, as_of="2024-03-05")
    assert execs(chain) == ["A"] and hi2 == dt.datetime(2024, 3, 11)
