"""The six status cases on literal frames (FIXTURES section 3)."""

import datetime as dt

from stagecraft.operators.status import common_new_counts, flag_new_existing, status_six_cases

T = dt.datetime
MOD = T(2024, 3, 10, 12, 0)
LC, NF, CL = T(2024, 3, 8), T(2024, 3, 20), T(2024, 4, 30)

SRL_SCHEMA = ("`Potential No.` string, `Modified Date` timestamp_ntz, Stage string, "
              "`Last Contact Date` timestamp_ntz, `Next Followup Date` timestamp_ntz, "
              "`Closing Date` timestamp_ntz")
DSR_SCHEMA = ("`Potential No.` string, `Contacted Date` timestamp_ntz, `Created Date` timestamp_ntz, "
              "`Original Stage` string, `New Stage` string, `Next Followup Date` timestamp_ntz, "
              "`Closing Date` timestamp_ntz, seq long")
MAIN_SCHEMA = ("`Potential No.` string, `Modified Date` timestamp_ntz, Stage string, "
               "`Last Contact Date` timestamp_ntz, `Next Followup Date` timestamp_ntz, "
               "`Closing Date` timestamp_ntz, _seq long")


def d(key, contacted, created, n, seq):
    """An activity whose follow-up/closing are derived from its number."""
    return (key, contacted, created, f"O{n}", f"N{n}", T(2025, 1, n), T(2026, 1, n), seq)


def m(key, modified, n, seq):
    return (key, modified, f"M{n}", T(2023, 1, n), T(2023, 2, n), T(2023, 3, n), seq)


def run(spark):
    keys = ["c1", "c2", "c3", "c4", "c5", "x_late", "x_none", "x_nomod", "x_nocontact"]
    srl = spark.createDataFrame(
        [(k, None if k == "x_nomod" else MOD, "S", LC, NF, CL) for k in keys], SRL_SCHEMA)
    dsr = spark.createDataFrame([
        d("c3", T(2024, 3, 10, 9), T(2024, 3, 10, 9), 1, 1),
        d("c4", T(2024, 3, 10, 8), T(2024, 3, 10, 9), 1, 2),
        d("c4", T(2024, 3, 10, 10), T(2024, 3, 10, 11), 2, 3),
        d("c5", T(2024, 3, 1), T(2024, 3, 1), 1, 4),
        d("c5", T(2024, 3, 5), T(2024, 3, 5), 2, 5),
        d("x_late", T(2024, 3, 12), T(2024, 3, 12), 1, 6),
        d("x_nomod", T(2024, 3, 1), T(2024, 3, 1), 1, 7),
        d("x_nocontact", None, T(2024, 3, 1), 1, 8),
    ], DSR_SCHEMA)
    main = spark.createDataFrame([
        m("c1", T(2024, 3, 1), 1, 1),
        m("c2", T(2024, 3, 1), 1, 2), m("c2", T(2024, 3, 9), 2, 3),
        m("c3", T(2024, 3, 1), 1, 4), m("x_late", T(2024, 3, 1), 1, 5),
        m("x_nomod", T(2024, 3, 1), 1, 6), m("x_nocontact", T(2024, 3, 1), 1, 7),
    ], MAIN_SCHEMA)
    out = status_six_cases(srl, dsr, main, dsr_tiebreak=["seq"], main_tiebreak=["_seq"])
    cols = ["Previous Status Stage", "PS Contacted On Date", "PS Follow-up On Date",
            "PS Closure Date", "Current Status Stage", "CS Contacted On Date",
            "CS Follow-up On Date", "CS Closure Date"]
    return {r["Potential No."]: tuple(r[c] for c in cols) for r in out.collect()}


def test_six_cases(spark):
    got = run(spark)
    own = ("S", LC, NF, CL)
    assert got["c1"] == own + own
    assert got["c2"] == ("M1", T(2023, 1, 1), T(2023, 2, 1), T(2023, 3, 1),
                         "M2", T(2023, 1, 2), T(2023, 2, 2), T(2023, 3, 2))
    # case 3: PS stage = original stage, PS dates untouched (null)
    assert got["c3"] == ("O1", None, None, None,
                         "N1", T(2024, 3, 10, 9), T(2025, 1, 1), T(2026, 1, 1))
    # case 4: newest by creation is CS, second newest is PS (new stages)
    assert got["c4"] == ("N1", T(2024, 3, 10, 8), T(2025, 1, 1), T(2026, 1, 1),
                         "N2", T(2024, 3, 10, 10), T(2025, 1, 2), T(2026, 1, 2))
    # case 5/6: PS = latest earlier activity, CS = the row itself
    assert got["c5"] == ("N2", T(2024, 3, 5), T(2025, 1, 2), T(2026, 1, 2)) + own
    for k in ("x_late", "x_none", "x_nomod", "x_nocontact"):
        assert got[k] == (None,) * 8, k


def test_flag_and_counts(spark):
    p1 = spark.createDataFrame([("a",), ("b",), (None,)], "`Potential No.` string")
    p2 = spark.createDataFrame([("a",), ("c",), (None,)], "`Potential No.` string")
    flags = {r[0]: r[1] for r in flag_new_existing(p2, p1).collect()}
    assert flags == {"a": "Existing", "c": "New", None: "New"}
    # membership counting matches null with null (unlike the flag)
    assert tuple(common_new_counts(p2, p1).first()) == (2, 1)
