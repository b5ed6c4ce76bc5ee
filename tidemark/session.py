"""Session settings for local runs and tests. On a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "tidemark", cores: str | int = "*", conf: dict[str, str] | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "256k")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
    )
    for key, value in (conf or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared folder the cluster names for checkpoints.

    Where none is set: ``fallback``, else a folder of the warehouse, which is shared as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    return (root or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")
