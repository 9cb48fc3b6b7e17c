"""The status rule over tables that are bucketed by key, so that its inputs meet without a shuffle.

What the rule joins are summaries: the log by (key, day), the main rows by key, the old snapshot's
keys and the new snapshot itself.  Each is reduced first, with a partial pass in the map tasks, and
only then dealt to buckets, so a key with a third of all raw rows fills its bucket with one row per
day.  A later run of the rule, or of any join on the key, reads the buckets as they lie.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..columns import DSR_TYPE, FLAG, KEY, SRL_COLUMNS, c
from ..operators.filters import filter_is_main
from ..operators.status import activity_day_summary, main_key_summary, status_six_cases
from ..sources.writers import shared_dir
from .build import stored_snapshot

#: the key's name in the bucketed tables: a plain name, as bucket columns may hold no dot
BUCKET_KEY = "_k"


@dataclass
class BucketedInputs:
    snapshot: DataFrame   # the new snapshot, ``KEY`` as BUCKET_KEY
    old_keys: DataFrame   # distinct keys of the old snapshot
    days: DataFrame       # activity_day_summary
    mains: DataFrame      # main_key_summary


def write_bucketed(df: DataFrame, name: str, buckets: int, key: str = BUCKET_KEY) -> DataFrame:
    """Store ``df`` as a table of ``buckets`` buckets, sorted by key, and read it back."""
    spark = df.sparkSession
    table = f"stagecraft_{name}_{uuid.uuid4().hex[:12]}"
    # one task a bucket, so that each bucket is one sorted file
    (df.repartition(buckets, F.col(key)).write.format("parquet").option("path", shared_dir(spark, "stagecraft-buckets"))
     .bucketBy(buckets, key).sortBy(key).saveAsTable(table))
    return spark.table(table)


def bucket_inputs(p2rdb: DataFrame, p1rdb: DataFrame, dsr2rdb: DataFrame, modified_rdb: DataFrame, *,
                  dsr_tiebreak=(), main_tiebreak=(), buckets: int | None = None) -> BucketedInputs:
    """Reduce and store the rule's inputs.  ``buckets`` is the session's shuffle partitions by default."""
    n = buckets or int(p2rdb.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    main = filter_is_main(modified_rdb) if DSR_TYPE in modified_rdb.columns else modified_rdb
    flagless = stored_snapshot(p2rdb, p1rdb).select(*[c(x) for x in SRL_COLUMNS])
    old = p1rdb.select(c(KEY).alias(BUCKET_KEY)).where(f"{BUCKET_KEY} is not null").distinct()
    return BucketedInputs(
        write_bucketed(flagless.withColumn(BUCKET_KEY, c(KEY)), "snapshot", n),
        write_bucketed(old, "old_keys", n),
        write_bucketed(activity_day_summary(dsr2rdb, KEY, dsr_tiebreak), "days", n),
        write_bucketed(main_key_summary(main, KEY, main_tiebreak), "mains", n))


def sales_reporting_bucketed(inputs: BucketedInputs) -> DataFrame:
    """Q4's tail from bucketed inputs: flag and status rule, without an exchange."""
    old = inputs.old_keys.withColumn("_old", F.lit(True))
    srl = inputs.snapshot.join(old, BUCKET_KEY, "left")
    srl = srl.withColumn(FLAG, F.when(F.col("_old"), F.lit("Existing")).otherwise(F.lit("New"))).drop("_old")
    out = status_six_cases(srl.withColumnRenamed(BUCKET_KEY, "_key"), None, None, key="_key",
                           days=inputs.days, mstat=inputs.mains)
    return out.select(*[c(n) for n in SRL_COLUMNS + [FLAG]])
