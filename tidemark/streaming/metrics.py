"""Counters of running streams: observed while the rows pass, appended by a listener."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTERS = ["received", "filtered", "formatted", "decode_errors", "format_errors"]
SCHEMA = ", ".join(["query string", "batch bigint", "at string", *(f"{c} bigint" for c in COUNTERS)])


def counted(df: DataFrame, name: str, counters: Sequence[Column]) -> DataFrame:
    """``df`` with ``counters`` (such as ``counting.pipeline_metrics``) observed under ``name``; no pass of its own."""
    return df.observe(name, *counters)


class MetricsLog(StreamingQueryListener):
    """Appends the counters of each micro-batch of the streams that observe ``name`` to a table.

    A row is kept by query and batch id, so a batch that runs again after a restart replaces its own row.
    A sink that runs the plan several times still observes it once a batch.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path, name

    def __enter__(self) -> MetricsLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        self.settle()
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(self.name)
        if found is None or not progress.numInputRows:
            return  # a trigger without rows reports the batch before it
        row = (str(progress.id), progress.batchId, progress.timestamp, *(found[c] for c in COUNTERS))
        folder = f"{self.path}/query={progress.id}/batch={progress.batchId}"
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("overwrite").parquet(folder)

    def onQueryTerminated(self, event) -> None:
        pass

    def settle(self, timeout: int = 60_000) -> None:
        """Wait until the progress that has been reported is written."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(timeout)

    def read(self) -> DataFrame:
        """A row for each query and batch."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/query=*/batch=*")

    def totals(self) -> DataFrame:
        return self.read().agg(*[F.sum(c).cast("bigint").alias(c) for c in COUNTERS])
