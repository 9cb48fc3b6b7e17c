"""A subset of registered queries against their DuckDB oracles on sf0.001
(the full list runs with ``python tools/check_oracle.py``)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from conftest import SMOKE  # noqa: E402

NAMES = ["sales_reporting", "movement_report", "drill_down", "login_sessions",
         "bookmark_state", "incremental_merge", "period_bounds", "top2_same_day", "date_layouts",
         "dedupe_first_over_files", "activity_asof_carry", "facets_at_once", "row_number_details",
         "history_positions", "keys_semi_filter", "filter_in_keys_blank_report", "find_potential_history",
         "history_export_by_key", "details_and_history_export_history", "latest_per_key", "record_counts",
         "watermark", "potential_details_grouped", "report_export_filters"]


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, name):
    import __spark_entry__ as E
    from check_oracle import duck, rows_of
    sdf = E.queries()[name](spark, SMOKE)
    rel = duck(SMOKE).sql(E.oracle_sql()[name])
    assert sorted(sdf.columns) == sorted(rel.columns)
    assert rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) == \
        rows_of(rel.columns, rel.fetchall())


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and rows[-1]["Stage Name"] == "Total"
    assert df.columns == ["Stage Name", "OB", "Added-New", "Added-Old", "Moved", "Dropped", "CB"]


def test_every_query_has_oracle_or_is_listed():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
