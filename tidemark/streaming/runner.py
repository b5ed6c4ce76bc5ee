"""Running streams: sources to sinks with checkpoints, one plan for batch and stream."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.plans.flow import Flow, reached, watch_lsn
from tidemark.session import checkpoint_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that stateful processors need; it keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def checkpoint_for(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    return os.path.join(checkpoint_root(spark, fallback), "streams", name)


def batch_table(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that is safe to repeat: a batch rewrites its own folder."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").format(fmt).save(f"{path}/batch={batch_id}")

    return write


def start(
    df: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, int], None],
    output_mode: str = "append",
    every: str | None = None,
) -> StreamingQuery:
    """Start a stream. Without ``every`` it takes what is there now and stops."""
    writer = df.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def run_stream(changes: DataFrame, flow: Flow, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """A flow over a stream of changes: lines and the highest lsn of each batch, by batch id."""

    def write(df: DataFrame, batch_id: int) -> None:
        watched, high = watch_lsn(df)
        watched.select("line").write.mode("overwrite").text(f"{path}/lines/batch={batch_id}")
        reached(df, high).write.mode("overwrite").parquet(f"{path}/checkpoint/batch={batch_id}")

    return start(flow.plan(changes), checkpoint, write, every=every)


def drain(df: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there and read the result back.

    In complete and update mode a later batch replaces what an earlier one gave; the caller
    picks by ``batch``.
    """
    schema = df.schema
    start(df, checkpoint, batch_table(path), output_mode).awaitTermination()
    spark = df.sparkSession
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*")
