"""A table of rows that failed, kept for a while and replayed.

Rows are appended by the hour in which they failed. Hours that are past the retention are dropped as folders; rows of the border hour
that are too old are left out by the reader. A replay works on the files that are there when it begins, so
rows that are appended meanwhile stay.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import instant, span_micros
from tidemark.operators.filters import Stage
from tidemark.sinks import files

_HOUR = 3600 * 10**6


class DeadLetters:
    """``schema`` is that of the failed rows, with ``reason`` and ``dead_at``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, ttl=1800):
        if span_micros(ttl) <= 0:
            raise ValueError("dead letters: ttl must be positive")
        self.spark, self.path, self.schema, self.span = spark, path, schema, span_micros(ttl)

    def append(self, failed: DataFrame) -> None:
        """Add the rows that have a reason. Each call writes folders of its own, so a replay can tell them apart."""
        rows = failed.filter(F.col("reason").isNotNull() & F.col("dead_at").isNotNull())
        hour = F.floor(F.unix_micros("dead_at") / _HOUR).cast("bigint")
        rows.withColumns({"_hour": hour, "_part": F.lit(uuid.uuid4().hex)}).write.mode("append").partitionBy("_hour", "_part").parquet(
            f"{self.path}/rows"
        )

    def _parts(self) -> list[str]:
        hours = files.numbered(self.spark, f"{self.path}/rows", "_hour")
        return [f"{self.path}/rows/_hour={h}/{p}" for h in hours for p in files.names(self.spark, f"{self.path}/rows/_hour={h}") if p.startswith("_part=")]

    def _alive(self, as_of):
        return F.unix_micros("dead_at") >= F.unix_micros(instant(as_of)) - self.span  # a row of exactly the retention stays

    def _read(self, parts: list[str], as_of=None) -> DataFrame:
        rows = self.spark.read.schema(self.schema).parquet(*parts) if parts else self.spark.createDataFrame([], self.schema)
        return rows.filter(self._alive(as_of))

    def read(self, as_of=None) -> DataFrame:
        """The rows within the retention at ``as_of`` (default: now)."""
        return self._read(self._parts(), as_of)

    def expire(self, as_of=None) -> int:
        """Drop the hours that lie wholly before the retention; gives their number."""
        now = self.spark.range(1).select(F.unix_micros(instant(as_of)).alias("now")).first()["now"]
        past = [h for h in files.numbered(self.spark, f"{self.path}/rows", "_hour") if (h + 1) * _HOUR <= now - self.span]
        for h in past:
            files.delete(self.spark, f"{self.path}/rows/_hour={h}")
        return len(past)

    def replay(self, retry: Stage, sink, as_of=None) -> None:
        """Run the failing stage again on what is there: rows that pass go to ``sink``, others stay with their new reason.

        ``retry`` gives the rows with ``reason`` (null: passed). They are worked out once, before anything is deleted.
        """
        parts = self._parts()
        if not parts:
            return
        stage = f"{self.path}/replay-{uuid.uuid4().hex}"
        self._read(parts, as_of).drop("reason").transform(retry).write.parquet(stage)
        tried = self.spark.read.parquet(stage)
        sink(tried.filter("reason IS NULL").drop("reason"))
        now = dt.datetime.now(dt.timezone.utc) if as_of is None else as_of
        self.append(tried.filter("reason IS NOT NULL").withColumn("dead_at", F.coalesce("dead_at", instant(now))))
        for part in parts:
            files.delete(self.spark, part)
        files.delete(self.spark, stage)
