"""CRM-shaped inputs derived from the driver's star-schema tables.

The test tables hold orders, customers and line items, not opportunities, so
the snapshots and activity logs are derived from them by Spark (whole tables,
no sampling): one opportunity per order, one activity per line item.  The
layout follows ``FIXTURES.md`` section 4; dates are rendered as day-first text
so the cleaning operators parse them exactly as they would parse a CSV export.

``p1``/``dsr1`` are the old snapshot/log (orders before 2000), ``p2``/``dsr2``
the new ones (some old potentials absent, some duplicated, some modified later).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..columns import c

# Fixed values of the derived views: raw stage labels and categories the
# orders are spread over (before cleaning maps them).
STAGE_SEEDS = ["9 Prospecting", "6 Needs Analysis", "7 First Quote", "3 Negotiation/Review",
               "2 Final Quote", "Closed Lost", "Closed Won",
               "85 - Order confirmed-Awaiting for PO"]
CATEGORY_SEEDS = ["1. Hot", "2. Followup", "3. Cold", "4. Yet to Contact", "Other"]
OLD_SNAPSHOT_BEFORE = "2000-01-01"

# Invented directory data used by the cleaning steps in the registered queries.
EXEC_ALIASES = {"Exec 1": "Exec 11"}
EXEC_SUFFIXED = ["Exec 11", "Exec 4"]
OWNER_MAP = {"Owner 1": "one@example.org", "Owner 2": "two@example.org"}
MIN_DATE = "1996-01-01"

# Tie-break columns that make every "latest" pick a total order.
DSR_TIEBREAK = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
MAIN_TIEBREAK = ["_seq"]
MERGED_TIEBREAK = ["_seq"] + DSR_TIEBREAK


_READS: dict = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver's table ``name``; the lazy reader (file listing, footer
    schema) is built once per session and folder and then reused."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _READS:
        _READS[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _READS[key]


def forget_readers() -> None:
    """Read file listings and schemas anew from the next query on."""
    _READS.clear()


def _pick(arr: list[str], idx: Column) -> Column:
    """``arr[idx]`` with a 0-based integer column."""
    return F.element_at(F.array(*[F.lit(x) for x in arr]), (idx + 1).cast("int"))


def _fmt(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM/yyyy HH:mm")


def _plus_days(ts: Column, n) -> Column:
    return F.timestamp_add("DAY", n if isinstance(n, Column) else F.lit(n), ts)


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One opportunity per order with customer, nation and region attributes."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey",
                                                      "c_mktsegment")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    j = (o.join(cu, o.o_custkey == cu.c_custkey)
         .join(n, cu.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey))
    k, ck = F.col("o_orderkey"), F.col("o_custkey")
    return j.select(
        k.alias("k"), ck.alias("ck"), F.col("o_orderdate").alias("od"),
        k.cast("string").alias("Potential No."),
        F.col("c_mktsegment").alias("Potential Code"),
        F.col("c_name").alias("Company Name (Company Name)"),
        F.col("n_name").alias("State/UT"),
        F.when(k % 97 == 5, F.lit(None).cast("string")).otherwise(F.col("r_name")).alias("Region"),
        F.concat(F.lit("Exec "), (ck % 12).cast("string")).alias("Sales handled by"),
        _pick(CATEGORY_SEEDS, k % 5).alias("Category"),
        F.concat(F.lit("Owner "), (ck % 7).cast("string")).alias("Potential Owner"),
    )


def _is_old() -> Column:
    return F.col("od") < F.lit(OLD_SNAPSHOT_BEFORE).cast("timestamp_ntz")


def _old(df: DataFrame) -> DataFrame:
    return df.filter(_is_old())


def p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old opportunity snapshot (orders before 2000)."""
    return p1_of(base(spark, sf_dir))


def p1_of(opportunities: DataFrame) -> DataFrame:
    """``p1`` from the rows of ``base``."""
    b = _old(opportunities)
    k, od = F.col("k"), F.col("od")
    return b.select(
        "*", (k * 2).alias("_seq"), _pick(STAGE_SEEDS, k % 8).alias("Stage"),
        _fmt(od).alias("Created Time"),
        _fmt(_plus_days(od, 5)).alias("Modified Time"),
        _fmt(_plus_days(od, 60)).alias("Closing Date"),
        F.when(k % 6 != 0, _fmt(_plus_days(od, 2))).alias("Last Contact Date"),
        F.when(k % 7 != 3, _fmt(_plus_days(od, 9))).alias("Next Followup Date"),
    )


def p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New snapshot: every 7th old potential gone, every 50th twice, modified later."""
    return p2_of(base(spark, sf_dir))


def p2_of(opportunities: DataFrame) -> DataFrame:
    """``p2`` from the rows of ``base``."""
    b = opportunities.filter((F.col("k") % 7 != 0) | ~_is_old())
    k, ck, od = F.col("k"), F.col("ck"), F.col("od")
    shift = F.when(k % 5 == 0, (k % 13) * 100).otherwise((k % 8) * 15 - 15).cast("int")
    b = b.withColumn("md", _plus_days(od, shift))
    b = b.withColumn("copy", F.explode(F.when(k % 50 == 1, F.array(F.lit(0), F.lit(1)))
                                       .otherwise(F.array(F.lit(0)))))
    md, cp = F.col("md"), F.col("copy")
    return b.select(
        *[c(x) for x in b.columns if x not in ("md", "copy")],
        (k * 2 + cp).alias("_seq"), _pick(STAGE_SEEDS, (k * 3 + ck + cp) % 8).alias("Stage"),
        _fmt(od).alias("Created Time"),
        _fmt(md).alias("Modified Time"),
        _fmt(_plus_days(md, 45)).alias("Closing Date"),
        F.when(k % 6 != 0, _fmt(_plus_days(md, -1))).alias("Last Contact Date"),
        F.when(k % 7 != 3, _fmt(_plus_days(md, 7))).alias("Next Followup Date"),
    )


def dsr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is one activity on its order's potential."""
    li, b = _line_items(spark, sf_dir), base(spark, sf_dir)
    return dsr_of(_dated(li.join(b, li.l_orderkey == b.k)))


def _line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def activity_rows(spark: SparkSession, sf_dir: str, opportunities: DataFrame) -> DataFrame:
    """The line items with what ``dsr_of`` needs of their opportunity, joined on the potential's number."""
    li = _line_items(spark, sf_dir).withColumn("_no", F.col("l_orderkey").cast("string"))
    b = opportunities.select("k", "od", c("Potential No."), c("Sales handled by"))
    return _dated(li.join(b, F.col("_no") == c("Potential No."))).drop("_no", "l_orderkey")


def _dated(j: DataFrame) -> DataFrame:
    """Line items joined with the rows of ``base``, and the texts of their dates."""
    ln = F.col("l_linenumber")
    ct = _plus_days(F.col("od"), (F.floor(ln / 2) * 30).cast("int"))
    return j.select(
        "*", _fmt(ct).alias("Contacted Date"), _fmt(F.timestamp_add("HOUR", ln, ct)).alias("Created Time"),
        _fmt(_plus_days(ct, 14)).alias("Next Followup Date (Potential Details)"),
        _fmt(_plus_days(ct, 40)).alias("Closing Date"))


def dsr_of(j: DataFrame) -> DataFrame:
    """``dsr`` from line items with their potential and dates."""
    ln, pk, sk = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    return j.select(
        "k", "od", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate",
        c("Potential No."), c("Sales handled by").alias("Sales Person Name"),
        _pick(STAGE_SEEDS, ln % 8).alias("Original Stage"),
        F.when(pk % 9 != 4, _pick(STAGE_SEEDS, pk % 8)).alias("New Stage"),
        "Contacted Date", c("Created Time"), c("Next Followup Date (Potential Details)"), "Closing Date",
        F.when(sk % 3 == 0, F.lit("Visit")).alias("Mode of Contact (DSR)"),
        F.lit("Phone").alias("Mode of Contact"),
        F.when(sk % 4 == 0, F.concat(F.lit("R-"), sk.cast("string")))
         .when(sk % 4 == 1, F.lit("  ")).alias("Report ID"),
        F.concat(F.lit("Call "), ln.cast("string"), F.lit(" on order "),
                 F.col("k").cast("string")).alias("Description (Potential Details)"),
    )


def dsr1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dsr1_of(dsr(spark, sf_dir))


def dsr1_of(activities: DataFrame) -> DataFrame:
    return _old(activities)


def dsr2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New log: all activities but those of every 5th old potential."""
    return dsr2_of(dsr(spark, sf_dir))


def dsr2_of(activities: DataFrame) -> DataFrame:
    return activities.filter((F.col("k") % 5 != 0) | ~_is_old())


def bookmark_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmark add/remove log from ``events``: click = add, error = remove."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type").isin("click", "error"))
            .select(F.col("user_id").cast("string").alias("user"),
                    F.get_json_object("props", "$.k").cast("bigint").cast("string")
                    .alias("potential_no"),
                    F.col("ts").alias("ts"),
                    F.when(F.col("event_type") == "click", F.lit("add"))
                    .otherwise(F.lit("remove")).alias("action"),
                    F.col("event_id").alias("seq")))


def login_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Login/logout log from ``events``: signup = login, purchase = logout."""
    ev = read_table(spark, sf_dir, "events")
    return (ev.filter(F.col("event_type").isin("signup", "purchase"))
            .select(F.col("user_id").cast("string").alias("username"),
                    F.col("ts").alias("ts"),
                    F.when(F.col("event_type") == "signup", F.lit("login"))
                    .otherwise(F.lit("logout")).alias("action"),
                    F.col("event_id").alias("seq")))
