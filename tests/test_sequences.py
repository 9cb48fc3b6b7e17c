import random

from pyspark.sql import functions as F

from stagecraft.operators.sequences import running_sum


def expected(rows):
    out, state = {}, {}
    for g, t, v in sorted(rows):
        s, mn = state.get(g, (0, None))
        prev_min = mn
        s += v
        mn = s if mn is None else min(mn, s)
        state[g] = (s, mn)
        out[(g, t)] = (s, mn, prev_min)
    return out


def test_running_sum_blocks(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"g{rnd.randrange(5)}", i, rnd.choice([-2, -1, 1, 3]))
            for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    want = expected(rows)
    for blocks in (1, 4, 13):
        got = running_sum(df, ["g"], [F.col("t").asc()], F.col("v"), "s", min_out="m",
                          prev_min_out="pm", blocks=blocks)
        res = {(r["g"], r["t"]): (r["s"], r["m"], r["pm"]) for r in got.collect()}
        assert res == want, blocks


def test_report_repeatable(spark):
    from conftest import SMOKE
    from stagecraft.registry import QUERIES
    a = sorted(tuple(r) for r in QUERIES["movement_report_filtered"](spark, SMOKE).collect())
    b = sorted(tuple(r) for r in QUERIES["movement_report_filtered"](spark, SMOKE).collect())
    assert a == b
