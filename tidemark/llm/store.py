"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset, a folder of the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return root.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/llm-{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a cut in the lineage that outlives executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain(path: str) -> str:
    """A path without scheme and repeated slashes."""
    return re.sub("/+", "/", path.split(":", 1)[-1])


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`stored` that no later step reads."""
    spark = df.sparkSession
    root = _plain(shared_root(spark)) + "/llm-"
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if _plain(name).startswith(root):
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
