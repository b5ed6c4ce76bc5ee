"""Lookups in a table of switches by time: intervals cut at the borders of time buckets, joined by bucket.

Each entry holds from its time to the next one's. Intervals are cut at borders that divide the entries' span into as
many buckets as there are entries, so cutting adds at most one piece a bucket, and a row
finds its interval by an equi-join on the bucket. A table of up to ``BROADCAST_ENTRIES`` is
broadcast, and the log is then not shuffled; a larger one is joined by shuffle, where AQE
splits a bucket with many rows. Either way the join has a row for each row of the log, also on streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import Running, running

BROADCAST_ENTRIES = 20_000
TIME_BLOCK = 1 << 26


def _next(points: DataFrame, name: str, value: Column, many: bool) -> DataFrame:
    """The first non-null ``value`` of the later entries; one task may sort a table that could be broadcast."""
    if many:
        return running(points, {name: Running("last", value, before=True)}, order="_at", block=TIME_BLOCK, descending=True)
    later = Window.partitionBy(F.lit(0)).orderBy("_at").rowsBetween(1, Window.unboundedFollowing)
    return points.withColumn(name, F.first(value, ignorenulls=True).over(later))


def during(
    df: DataFrame, entries: DataFrame, value: str, ts: str = "ts", entry_ts: str = "ts", tie: str | None = None,
    following: dict[str, Column] | None = None, broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """``df`` with ``value`` of the newest entry at or before its time, null where there is none (or no time).

    Entries of one instant are reduced to the last by ``tie``. ``following`` adds columns to a ``value`` struct: the
    next non-null one, from later entries.
    """
    timed = entries.filter(F.col(entry_ts).isNotNull())
    pick = F.max_by(value, tie) if tie else F.last(value)
    points = timed.groupBy(F.unix_micros(entry_ts).alias("_at")).agg(pick.alias("_value"))
    held = points.limit(broadcast_entries + 1).collect()  # worked out once, and no more than may be broadcast
    many = len(held) > broadcast_entries
    if many:
        n, low, high = points.agg(F.count("*"), F.min("_at"), F.max("_at")).first()
    else:
        points = df.sparkSession.createDataFrame(held, points.schema)
        times = [r["_at"] for r in held]
        n, low, high = max(1, len(times)), min(times, default=0), max(times, default=0)
    width = max(1, -(-(high - low + 1) // n))
    bucket = lambda at: F.floor((at - F.lit(low)) / F.lit(width)).cast("bigint")
    points = _next(points, "_to", F.col("_at"), many)
    for name, c in (following or {}).items():
        points = _next(points, name, c, many)
        points = points.withColumn("_value", F.struct("_value.*", name)).drop(name)
    last = (high - low) // width
    cut = points.select(
        "_at", "_to", F.col("_value").alias(value),
        F.explode(F.sequence(bucket(F.col("_at")), F.coalesce(bucket(F.col("_to") - 1), F.lit(last)))).alias("_bucket"),
    )
    if not many:
        cut = F.broadcast(cut)  # at most twice ``broadcast_entries`` rows
    now = F.unix_micros(ts)
    held = df.withColumns({"_now": now, "_in": F.least(bucket(now), F.lit(last))})
    same = (F.col("_in") == F.col("_bucket")) & (F.col("_now") >= F.col("_at")) & (F.col("_to").isNull() | (F.col("_now") < F.col("_to")))
    return held.join(cut, same, "left").select(*df.columns, value)
