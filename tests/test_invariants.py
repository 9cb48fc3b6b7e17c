"""Invariants of the build over the driver's sf0.001 tables."""

from pyspark.sql import functions as F

from conftest import SMOKE
from stagecraft.columns import KEY, c
from stagecraft.operators import grid as G
from stagecraft.registry import lazy_tables, tables


def test_build_invariants(spark):
    t = tables(spark, SMOKE)
    srl = t["sales_reporting_logic"]
    n = srl.count()
    assert srl.select(c(KEY)).distinct().count() == n                 # keys unique
    assert t["modified_rdb"].count() == t["main_rdb"].count() + t["weekly_rdb"].count()
    flags = {r[0]: r[1] for r in srl.groupBy("Flag").count().collect()}
    assert set(flags) <= {"Existing", "New"} and sum(flags.values()) == n


def test_grid_sums_and_partition_independence(spark):
    srl = tables(spark, SMOKE)["sales_reporting_logic"]
    g = G.stage_movement_grid(srl)
    s = g.agg(*[F.sum(m).alias(m) for m in G.GRID_METRICS]).first()
    assert s["Moved"] == s["Added-Old"]
    assert s["CB"] == s["OB"] + s["Added-New"] - s["Dropped"]
    base = sorted(tuple(r) for r in g.collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            again = G.stage_movement_grid(lazy_tables(spark, SMOKE)["sales_reporting_logic"])
            assert sorted(tuple(r) for r in again.collect()) == base
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_independent_of_input_partitioning(spark):
    from stagecraft.plans.build import build_tables
    from stagecraft.registry import PARAMS, raw_inputs

    def status(parts):
        r = raw_inputs(spark, SMOKE)
        if parts:
            r = {k: v.repartition(parts) for k, v in r.items()}
        srl = build_tables(r["p1"], r["p2"], r["dsr1"], r["dsr2"], PARAMS)["sales_reporting_logic"]
        return sorted((tuple(str(x) for x in row) for row in srl.collect()))

    assert status(None) == status(7)


def test_independent_of_session_time_zone(spark):
    """Every stamp is zone-less (timestamp_ntz), so a non-UTC session (with a
    daylight-saving zone) must give the same status table."""
    old = spark.conf.get("spark.sql.session.timeZone")

    def status():
        srl = lazy_tables(spark, SMOKE)["sales_reporting_logic"]
        return sorted(tuple(str(x) for x in row) for row in srl.collect())

    try:
        utc = status()
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert status() == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
