"""As-of lookups: the newest earlier entry per key, by sort and scan instead of by pairs.

Both sides are put in one order and the newest entry seen so far is carried forward with
``running``. The work is linear in the rows of both sides, and a hot key is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import Running, running

# Block width for times: about a minute, in half microseconds (entries sort before probes).
TIME_BLOCK = 1 << 27


def asof_by_seq(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, **kw) -> DataFrame:
    """For every left row the ``value`` struct of the newest right row with a smaller ``seq``.

    ``seq`` is unique over both sides together.
    """
    both = left.withColumn("_asof_probe", F.lit(True)).unionByName(
        right.select(*keys, "seq", F.col(value).alias("_asof_entry"), F.lit(False).alias("_asof_probe")),
        allowMissingColumns=True,
    )
    seen = running(both, {value: Running("last", F.col("_asof_entry"))}, keys, **kw)
    return seen.filter("_asof_probe").select(*left.columns, value)


def asof_by_time(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    value: str,
    left_ts: str = "ts",
    right_ts: str = "ts",
    tie: str | None = None,
    block: int = TIME_BLOCK,
) -> DataFrame:
    """For every left row the ``value`` struct of the newest right row at or before its time.

    Entries of one key and instant are reduced to the last by ``tie``; probes are reduced to
    one per key and instant, so the order is unique as ``running`` needs it. A null key or time
    finds nothing.
    """
    pick = F.max_by(value, tie) if tie else F.last(value)
    entries = right.groupBy(*keys, F.unix_micros(right_ts).alias("_asof_at")).agg(pick.alias("_asof_entry"))
    timed = left.withColumn("_asof_at", F.unix_micros(left_ts))
    probes = timed.select(*keys, "_asof_at").filter("_asof_at is not null").distinct()
    order = (F.col("_asof_at") * 2 + F.when(F.col("_asof_probe"), 1).otherwise(0)).alias("_asof_order")
    both = (
        probes.withColumn("_asof_probe", F.lit(True))
        .unionByName(entries.withColumn("_asof_probe", F.lit(False)), allowMissingColumns=True)
        .select("*", order)
    )
    seen = (
        running(both, {value: Running("last", F.col("_asof_entry"))}, keys, order="_asof_order", block=block)
        .filter("_asof_probe")
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_asof_at").alias("_k_at"), value)
    )
    same = F.col("_asof_at") == F.col("_k_at")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return timed.join(seen, same, "left").select(*left.columns, value)
