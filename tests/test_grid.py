from stagecraft.operators import grid as G

SCHEMA = "Flag string, `Previous Status Stage` string, `Current Status Stage` string, Stage string"
ROWS = [("Existing", "A", "A", "A"), ("Existing", "A", "B", "A"),
        ("Existing", "B", "0 - Closed", "B"), ("New", "A", "A", "A"), ("New", None, None, None),
        ("Existing", "A", None, "A"), ("Existing", "0 - Closed", "0 - Closed", "0 - Closed")]


def grid(spark):
    g = G.stage_movement_grid(spark.createDataFrame(ROWS, SCHEMA))
    return {r["Stage Name"]: tuple(r[m] for m in G.GRID_METRICS) for r in g.collect()}


def test_grid_frame(spark):
    g = grid(spark)
    #            OB AN AO MV DR CB
    assert g["A"] == (3, 1, 0, 1, 0, 3)
    assert g["B"] == (1, 0, 1, 0, 1, 1)
    assert g["0 - Closed"] == (1, 0, 0, 0, 0, 1)


def test_grid_invariants(spark):
    g = grid(spark).values()
    tot = [sum(v[i] for v in g) for i in range(6)]
    assert tot[3] == tot[2]                       # sum Moved == sum Added-Old
    assert tot[5] == tot[0] + tot[1] - tot[4]      # sum CB == OB + Added-New - Dropped


def test_total_row_excludes_closed_and_limit(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = G.finish_grid(G.stage_movement_grid(df))
    rows = out.collect()
    assert rows[-1]["Stage Name"] == "Total"
    assert rows[-1]["OB"] == 4 and rows[-1]["CB"] == 4
    assert [r["Stage Name"] for r in rows] == ["0 - Closed", "A", "B", "Total"]


def test_drill_null_is_not_in(spark):
    df = spark.createDataFrame([("k1", "Existing", None, "X", "Y")],
                               "`Potential No.` string, Flag string, `Previous Status Stage` string,"
                               " `Current Status Stage` string, Stage string")
    keys = [r[0] for r in G.drill_down(df, ["X"], ["Added-Old"]).collect()]
    assert keys == ["k1"]
    # Moved: CS null counts as "not in" and "not closed"
    df2 = spark.createDataFrame([("k2", "Existing", "X", None, "X")], df.schema)
    assert [r[0] for r in G.drill_down(df2, ["X"], ["Moved"]).collect()] == ["k2"]


def test_stage_filter_and_exclusion(spark):
    df = spark.createDataFrame([("Existing", "80 - Final Quote", "100 - Billed", "x"),
                                ("Existing", "10 - Prospecting", "10 - Prospecting", "zz")],
                               SCHEMA)
    g = G.stage_movement_grid(df)
    names = {r[0] for r in G.filter_stage_at_least(g, "60 - Value Proposition").collect()}
    assert names == {"80 - Final Quote", "100 - Billed", "x", "zz"}   # no number = +inf, kept
    names = {r[0] for r in G.filter_exclude_stages(g).collect()}
    assert "100 - Billed" not in names


def test_report_keeps_every_stage_and_the_total(spark):
    rows = [("Existing", f"{i} - S", f"{i} - S", f"{i} - S") for i in range(10, 40)]
    out = G.finish_grid(G.stage_movement_grid(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(out) == 31 and out[-1]["Stage Name"] == "Total" and out[-1]["OB"] == 30
    shown = G.limit_rows(G.finish_grid(G.stage_movement_grid(spark.createDataFrame(rows, SCHEMA))))
    assert shown.count() == 20


def test_total_of_an_empty_grid(spark):
    out = G.finish_grid(G.stage_movement_grid(spark.createDataFrame([], SCHEMA))).collect()
    assert [tuple(r) for r in out] == [("Total", 0, 0, 0, 0, 0, 0)]
