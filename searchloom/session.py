"""Session helpers: a local builder for tests and the shared-folder checkpoint."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "searchloom") -> SparkSession:
    """Single-machine session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SEARCHLOOM_DRIVER_MEMORY", "12g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The reliable folder the cluster names in ``spark.checkpoint.dir``.

    Only a session on one machine (a ``local`` master, as in tests) may do without: it gets a temporary folder. Anywhere else a
    missing setting raises, since executors would not see each other's files.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^,\]]*(,\s*\d+)?\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    fallback = getattr(spark, "_searchloom_dir", None)
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="spark-searchloom-", dir="/tmp")
        spark._searchloom_dir = fallback
    return fallback


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, for written tables and stream checkpoints."""
    return f"{shared_dir(spark).rstrip('/')}/searchloom/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Iterative jobs use it so a lost executor re-reads one round and does not recompute all rounds.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
