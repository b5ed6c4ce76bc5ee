"""Counts by table and action, pipeline counters and sliding counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cells import scope
from tidemark.model import ACTIONS, span_micros
from tidemark.operators.filters import Stage


_CHUNK = 1 << 14  # buckets per task of a sliding sum


def _n() -> Column:
    return F.count(F.lit(1))


def aggregate(by: str) -> Stage:
    """Rows per table or per action."""
    if by not in ("table", "action"):
        raise ValueError(f"aggregate: unsupported group {by!r}; must be 'table' or 'action'")
    column = "table_name" if by == "table" else "action"
    return lambda df: df.groupBy(column).agg(_n().alias("n"))


def census(dense: bool = False, actions: Sequence[str] = ACTIONS) -> Stage:
    """Rows per table and action; ``dense`` gives every listed action of a table, 0 if absent."""

    def run(df: DataFrame) -> DataFrame:
        counts = df.groupBy("table_name", "action").agg(_n().alias("n"))
        if not dense:
            return counts
        by_action = F.array(
            *[F.struct(F.lit(a).alias("action"), F.count_if(F.col("action") == a).alias("n")) for a in actions]
        )
        wide = df.groupBy("table_name").agg(by_action.alias("_all"))
        return wide.select("table_name", F.inline("_all"))

    return run


def census_lines() -> Stage:
    return lambda df: census()(df).select(
        F.format_string("  %s/%s: %d", "table_name", "action", "n").alias("line")
    )


def snapshot() -> Stage:
    """Rows per ``table:action`` key with the text ``key=count``."""
    key = F.concat_ws(":", "table_name", "action")
    return lambda df: (
        df.groupBy("table_name", "action")
        .agg(_n().alias("n"))
        .select(key.alias("key"), "n", F.concat(key, F.lit("="), F.col("n").cast("string")).alias("text"))
    )


def snapshot_total() -> Stage:
    return lambda df: df.agg(_n().alias("total"))


def summarize(table: str | None = None) -> Stage:
    """Counts per table and action, per table, and in total; null marks the total."""
    return lambda df: (
        df.filter(scope(table))
        .rollup("table_name", "action")
        .agg(_n().alias("n"), F.grouping_id().cast("bigint").alias("level"))
    )


def pipeline_metrics(
    kept: Column, formatted: Column | None = None, decode_error: Column | None = None, format_error: Column | None = None
) -> list[Column]:
    """The five counters as aggregate columns, for ``agg`` or ``observe``."""
    no = F.lit(False)

    def n(cond: Column | None, name: str) -> Column:
        return F.count_if(F.coalesce(cond if cond is not None else no, no)).alias(name)

    return [
        _n().alias("received"),
        n(~F.coalesce(kept, no), "filtered"),
        n(kept if formatted is None else formatted, "formatted"),
        n(decode_error, "decode_errors"),
        n(format_error, "format_errors"),
    ]


def window_count(size: int = 10, interval=1, keys: Sequence[str] = (), amount: Column | None = None) -> Stage:
    """Sum over the last ``size`` buckets of ``interval``, at every bucket that has rows.

    Buckets start at multiples of the interval from the epoch. Rows are summed per bucket
    first, so the window runs over buckets only.
    """
    if size <= 0:
        raise ValueError("window_count: size must be greater than zero")
    width = span_micros(interval)
    if width <= 0:
        raise ValueError("window_count: interval must be greater than zero")
    amount = F.lit(1) if amount is None else amount

    def run(df: DataFrame) -> DataFrame:
        bucket = F.floor(F.unix_micros("ts") / F.lit(width)).cast("bigint")
        sums = df.groupBy(*keys, bucket.alias("bucket")).agg(F.sum(amount).cast("bigint").alias("n"))
        # Buckets are cut into chunks; one that a later chunk still looks back to goes there too.
        wide = max(_CHUNK, size)
        own = F.floor(F.col("bucket") / F.lit(wide)).cast("bigint")
        reach = F.floor((F.col("bucket") + (size - 1)) / F.lit(wide)).cast("bigint")
        placed = sums.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, reach)))
        last = Window.partitionBy(*keys, "_chunk").orderBy("bucket").rangeBetween(-(size - 1), 0)
        return (
            placed.withColumn("window_n", F.sum("n").over(last)).filter("_chunk = _own").drop("_own", "_chunk")
        )

    return run


def window_count_stream(size: int, interval: str, span: str, late: str, keys: Sequence[str] = ()) -> Stage:
    """Streaming form: sliding windows of ``span`` (= size x interval) with a watermark."""
    return lambda df: (
        df.withWatermark("ts", late)
        .groupBy(F.window("ts", span, interval), *keys)
        .agg(_n().alias("window_n"))
    )
