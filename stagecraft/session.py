"""Session construction for tests, the bench and local runs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "stagecraft", broadcast_bytes: int = 1 << 20) -> SparkSession:
    """A local session with AQE on, the UI off and UTC as session zone."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             # small local inputs would otherwise broadcast a fact table and leave the
             # per-row work on the other side's single coalesced partition; keep
             # broadcasts to genuinely small tables, as a large cluster plan would
             .config("spark.sql.autoBroadcastJoinThreshold", str(broadcast_bytes))
             .config("spark.driver.memory", os.environ.get("STAGECRAFT_DRIVER_MEM", "8g"))
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    A fresh scratch folder serves a single-machine session that names none (tests);
    a cluster session must name a folder that all executors share.
    """
    sc = spark.sparkContext
    cur = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if cur:
        sc.setCheckpointDir(cur)
        return cur
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="stagecraft-ckpt-")
    sc.setCheckpointDir(path)
    return path
