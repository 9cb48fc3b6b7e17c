"""End to end through the command line: CSV exports -> build -> report."""

P_HEAD = ("Record Id,Potential No.,Sales handled by,Created Time,Modified Time,"
          "Company Name (Company Name),Stage,Category,Region,Potential Code,State/UT,"
          "Last Contact Date,Next Followup Date,Closing Date\n")
D_HEAD = ("Record Id,Potential No.,Sales Person Name,Created Time,Contacted Date,Original Stage,"
          "New Stage,Next Followup Date (Potential Details),Closing Date,Mode of Contact (DSR),"
          "Mode of Contact,Report ID,Description (Potential Details)\n")


def write(tmp, name, text):
    (tmp / name).write_text(text)


def test_build_and_report(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    write(src, "p1.csv", P_HEAD +
          "1,P1,Ann,01/03/2024 10:00,02/03/2024 10:00,Acme,2 Final Quote,1. Hot,North,A,S1,"
          "02/03/2024 09:00,05/03/2024 09:00,30/04/2024 00:00\n"
          "2,P2,Bob,01/03/2024 11:00,02/03/2024 11:00,Beta,9 Prospecting,2. Followup,South,B,S2,"
          ",,\n")
    write(src, "p2.csv", P_HEAD +
          "1,P1,Ann,01/03/2024 10:00,10/03/2024 12:00,Acme,Closed Won,1. Hot,North,A,S1,"
          "09/03/2024 09:00,15/03/2024 09:00,30/04/2024 00:00\n"
          "2,P2,Bob,01/03/2024 11:00,11/03/2024 11:00,Beta,9 Prospecting,2. Followup,South,B,S2,"
          ",,\n"
          "3,P3,Ann,08/03/2024 11:00,12/03/2024 11:00,Gamma,7 First Quote,NA,North,A,S1,,,\n"
          "4,P3,Ann,08/03/2024 11:00,12/03/2024 11:00,Gamma,Closed Lost,NA,North,A,S1,,,\n")
    write(src, "dsr1.csv", D_HEAD +
          "10,P1,Ann,01/03/2024 12:00,01/03/2024 12:00,9 Prospecting,2 Final Quote,"
          "05/03/2024 00:00,30/04/2024 00:00,,Phone,,\"first call,\nwith a line break\"\n")
    write(src, "dsr2.csv", D_HEAD +
          "11,P1,Ann,10/03/2024 13:00,10/03/2024 12:30,2 Final Quote,Closed Won,"
          "15/03/2024 00:00,30/04/2024 00:00,Visit,Phone,,won\n"
          "12,P9,Cid,10/03/2024 13:00,10/03/2024 12:30,9 Prospecting,,,,,Phone,R-1,orphan\n")
    from stagecraft.__main__ import main
    out = str(tmp_path / "out")
    main(["build", "--input", str(src), "--output", out, "--min-date", "2024-01-01", "--multi-line"],
         spark=spark)
    srl = spark.read.parquet(f"{out}/sales_reporting_logic")
    rows = {r["Potential No."]: r for r in srl.collect()}
    assert sorted(rows) == ["P1", "P2", "P3"]
    assert rows["P3"]["Stage"] == "60 - Value Proposition"          # first copy kept
    assert rows["P1"]["Flag"] == "Existing" and rows["P3"]["Flag"] == "New"
    # One same-day activity (case 3); P2: two main rows, no activity (case 2)
    assert (rows["P1"]["Previous Status Stage"], rows["P1"]["Current Status Stage"]) == \
        ("80 - Final Quote", "100 - Billed")
    assert (rows["P2"]["Previous Status Stage"], rows["P2"]["Current Status Stage"]) == \
        ("10 - Prospecting", "10 - Prospecting")
    rep = str(tmp_path / "rep")
    paths = main(["report", "--tables", out, "--output", rep, "--stages", "80 - Final Quote",
                  "--metrics", "OB", "Dropped"], spark=spark)
    grid = spark.read.parquet(paths["report"]).collect()
    assert any(r["Stage Name"] == "Total" for r in grid)
    assert spark.read.parquet(paths["filters"]).count() == 6
    drill = spark.read.parquet(paths["drill_down"]).collect()
    assert [r["Potential No."] for r in drill] == ["P1"]
    hist = spark.read.parquet(paths["history_by_sheet"]).collect()
    assert {r["sheet"] for r in hist} == {"1"}


def test_build_with_text_status_dates_and_mixed_layouts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    head = P_HEAD.rstrip("\n") + ",PS Contacted On Date\n"
    write(src, "p1.csv", P_HEAD)
    write(src, "p2.csv", head +
          "1,P1,Ann,01/03/2024 10:00,10/03/2024 12:00:05,Acme,Closed Won,1. Hot,North,A,S1,"
          "09/03/2024 09:00,15/03/2024,30/04/2024,07/01/2024 09:00\n"
          "2,P2,Bob,01/03/2024 11:00,11/03/2024 11:00,Beta,9 Prospecting,2. Followup,South,B,S2,"
          "soon,,,\n")
    write(src, "dsr1.csv", D_HEAD)
    write(src, "dsr2.csv", D_HEAD +
          "11,P1,Ann,10/03/2024 13:00,10/03/2024 12:30,2 Final Quote,Closed Won,,,Visit,Phone,,won\n")
    from stagecraft.__main__ import main
    out = str(tmp_path / "out")
    main(["build", "--input", str(src), "--output", out, "--min-date", "2024-01-01"], spark=spark)
    rows = {r["Potential No."]: r for r in spark.read.parquet(f"{out}/sales_reporting_logic").collect()}
    # one same-day activity: the stored previous contact date is kept, as a timestamp
    assert str(rows["P1"]["PS Contacted On Date"]) == "2024-01-07 09:00:00"
    assert str(rows["P1"]["Modified Date"]) == "2024-03-10 12:00:05"
    assert str(rows["P1"]["Closing Date"]) == "2024-04-30 00:00:00"
    bad = {(r["input"], r["column"]): r["unparsed"] for r in spark.read.parquet(f"{out}/unparsed_dates").collect()}
    assert bad[("p2", "Last Contact Date")] == 1 and bad[("p2", "Closing Date")] == 0
    p2 = spark.read.parquet(f"{out}/p2rdb")
    assert {"Flag", "Potential Name", "Enquiry Date"} <= set(p2.columns)
