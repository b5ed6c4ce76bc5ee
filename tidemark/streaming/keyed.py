"""Tables with one row per key that micro-batches write into.

A table is cut into hash buckets of its key. A batch reads the buckets that its rows touch, merges, and writes new versions of
those alone; a manifest per batch lists the version of each bucket. Nothing that a manifest lists is
changed, so readers see whole batches, and a batch that runs again starts from the manifest
before its own and ends in the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import combine
from tidemark.sinks import files
from tidemark.streaming.runner import start

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def replaced(keys: Sequence[str]) -> Merge:
    """New rows take the place of old ones with their key, as update mode gives them."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_new_{k}"))
        named = new.select(*[F.col(k).alias(f"_new_{k}") for k in keys])
        return old.join(named, same, "left_anti").unionByName(new)

    return merge


class KeyedTable:
    """``keys`` give the bucket of a row; ``merge(old, new)`` gives the rows of the touched buckets."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[Column], merge: Merge, buckets: int = 64):
        self.spark, self.path, self.schema = spark, path, schema
        self.keys, self.merge, self.buckets = list(keys), merge, buckets

    def _manifest(self, before: int | None = None) -> dict[int, int]:
        """Bucket to version, as of the newest batch (before ``before``). One entry a bucket."""
        batches = [b for b in files.numbered(self.spark, f"{self.path}/manifest", "batch") if before is None or b < before]
        if not batches:
            return {}
        rows = self.spark.read.schema("bucket int, version bigint").parquet(f"{self.path}/manifest/batch={batches[-1]}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _rows(self, manifest: dict[int, int], buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/rows/version={v}/_bucket={b}" for b, v in sorted(manifest.items()) if buckets is None or b in buckets]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._rows(self._manifest())

    def write(self, new: DataFrame, batch_id: int) -> None:
        """Merge a micro-batch; the same batch again gives the same table."""
        manifest = self._manifest(batch_id)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        touched = {r["b"] for r in new.select(bucket.alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        merged = self.merge(self._rows(manifest, touched), new).withColumn("_bucket", bucket)
        folder = f"{self.path}/rows/version={batch_id}"
        merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
        there = set(files.numbered(self.spark, folder, "_bucket"))
        manifest = {b: v for b, v in manifest.items() if b not in touched} | {b: batch_id for b in there}
        entries = self.spark.createDataFrame(sorted(manifest.items()), "bucket int, version bigint")
        entries.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")

    def vacuum(self, keep: int = 2) -> None:
        """Delete what the newest ``keep`` manifests do not list. At least two, as Spark may run the last batch again."""
        batches = files.numbered(self.spark, f"{self.path}/manifest", "batch")
        old, kept = batches[:-max(keep, 2)], batches[-max(keep, 2):]
        listed = {(v, b) for batch in kept for b, v in self._manifest(batch + 1).items()}
        for batch in old:
            files.delete(self.spark, f"{self.path}/manifest/batch={batch}")
        for v in files.numbered(self.spark, f"{self.path}/rows", "version"):
            if v > max(kept, default=-1):
                continue  # being written
            for b in files.numbered(self.spark, f"{self.path}/rows/version={v}", "_bucket"):
                if (v, b) not in listed:
                    files.delete(self.spark, f"{self.path}/rows/version={v}/_bucket={b}")


def upserts(spark: SparkSession, path: str, schema: str, key_column: str, buckets: int = 64) -> KeyedTable:
    """``combine.coalesce_rows`` as a table: one row per table and key value, the last write of each column wins.

    Rows of a later batch must have arrived later, as the rows of a log do: a row of the table has the ``seq`` of its first
    row, so what a batch writes comes after it, and one pass merges both.
    """
    stage = combine.coalesce_rows(key_column)
    keys = [F.coalesce("table_name", F.lit("")), combine.coalesce_key(key_column)]
    return KeyedTable(spark, path, schema, keys, lambda old, new: old.unionByName(new).transform(stage), buckets)


def upsert_stream(live: DataFrame, table: KeyedTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return start(live, checkpoint, table.write, every=every)


def update_table(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str], buckets: int = 16) -> KeyedTable:
    """A table for a stream in update mode: its rows replace those with their key."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in updates.schema.fields)
    return KeyedTable(spark, path, schema, [F.col(k) for k in keys], replaced(keys), buckets)


def update_stream(updates: DataFrame, table: KeyedTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return start(updates, checkpoint, table.write, "update", every)
