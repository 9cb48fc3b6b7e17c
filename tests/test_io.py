import datetime as dt

from stagecraft.sources import readers as RD
from stagecraft.sources import writers as WR


def test_scan_csv_tokens_and_multiline(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('Potential No.,Stage,Note\n1,NA,"two\nlines"\n2,,ok\n3,Closed Won,null\n')
    df = RD.scan_csv(spark, str(p), multi_line=True)
    assert df.columns == ["Potential No.", "Stage", "Note"]
    rows = sorted(tuple(r) for r in df.collect())
    assert rows == [("1", None, "two\nlines"), ("2", None, "ok"), ("3", "Closed Won", None)]


def test_scan_csv_splits_a_folder_of_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text("Potential No.,Stage\n" + f"{i},Open\n")
    df = RD.scan_csv(spark, str(tmp_path))
    assert sorted(r[0] for r in df.collect()) == ["0", "1", "2"]


def test_drill_down_export_names_its_own_filters(spark, tmp_path):
    df = spark.createDataFrame([("k",)], "a string")
    paths = WR.report_export(df, str(tmp_path), "drill", {"Stage Name(s)": "80 - Final Quote", "Column": "CB"},
                             names=("Stage Name(s)", "Column"))
    assert sorted(tuple(r) for r in spark.read.parquet(paths["filters"]).collect()) == [
        ("Column", "CB"), ("Stage Name(s)", "80 - Final Quote")]


def test_write_and_scan_table_all(spark, tmp_path):
    df = spark.createDataFrame([("k", "2024-01-02 03:04:05")],
                               "`Potential No.` string, `Created Date` string")
    path = WR.write_table(df, str(tmp_path), "srl")
    got = RD.scan_table_all(spark, path).first()
    assert got["Flag"] == "Existing"
    assert got["Created Date"] == dt.datetime(2024, 1, 2, 3, 4, 5)


def test_history_export_sheets(spark, tmp_path):
    hist = spark.createDataFrame(
        [("ENQ-0012", dt.date(2024, 1, 2), "a"), ("ENQ-0012", dt.date(2024, 1, 1), "b"),
         ("X-0012", dt.date(2024, 1, 3), "c"), ("none", None, "d")],
        "`Potential No.` string, `Created Date` date, Description string")
    path = WR.history_export_by_key(hist, str(tmp_path))
    back = spark.read.parquet(path)
    sheets = {r[0]: r[1] for r in back.groupBy("sheet").count().collect()}
    assert sheets == {"0012": 3, "Sheet1": 1}       # coinciding digits share a sheet
    # one directory per sheet: the sheet name stays text (leading zeros kept)
    path2 = WR.history_export_by_key(hist, str(tmp_path), "h2", directory_per_sheet=True)
    back2 = spark.read.schema(hist.schema.add("sheet", "string")).parquet(path2)
    assert {r[0] for r in back2.select("sheet").distinct().collect()} == {"0012", "Sheet1"}


def test_column_width_profile(spark):
    df = spark.createDataFrame([("abc", None), ("a" * 70, 5)], "s string, n int")
    got = {r["column"]: r["width"] for r in WR.column_width_profile(df).collect()}
    assert got == {"s": 50, "n": 3}


def test_streaming_ingest(spark, tmp_path):
    from stagecraft.streaming.incremental import start_activity_ingest
    main = spark.createDataFrame([("1", dt.datetime(2024, 1, 10))],
                                 "`Potential No.` string, `Created Date` timestamp_ntz")
    main_path = str(tmp_path / "main")
    main.write.parquet(main_path)
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.csv").write_text("Potential No.,Created Time,Contacted Date\n"
                               "1,09/01/2024 10:00,09/01/2024 10:00\n"
                               "2,11/01/2024 10:00,11/01/2024 10:00\n")
    schema = "`Potential No.` string, `Created Time` string, `Contacted Date` string"
    from pyspark.sql.types import StructType
    q = start_activity_ingest(spark, str(src), StructType.fromDDL(schema), main_path,
                              str(tmp_path / "weekly"), str(tmp_path / "ckpt"),
                              cleaning={"min_date": "2020-01-01"})
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "weekly")).select("`Potential No.`", "`DSR Type`")
    assert [tuple(r) for r in got.collect()] == [("2", "DSR")]
