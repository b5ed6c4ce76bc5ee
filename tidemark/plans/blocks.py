"""Exact running aggregates over arrival order, without one task per key.

Keys with few rows stay whole. The rows of hot keys are cut into blocks of a fixed range of
the order column. The order column is a unique integer, so a (key, block) group never holds
more rows than the block is wide, however hot the key is. Each block is aggregated (with
map-side partial aggregation), the small table of blocks is scanned per key, and the scan
result is joined back to rows that carry their block-local running value. Catalyst chooses
how that join runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 1 << 20  # width of a block, and the most rows of a key that stay in one group
SUPER_BLOCK = 1 << 12


def with_block(
    df: DataFrame, keys: Sequence[str], position: Column, block: int, few_keys: bool, hot: int | None = None
) -> DataFrame:
    """Add ``_block``: a range number of ``position`` for hot keys, null for all others.

    A key is hot when it has more than ``hot`` rows (at most ``BLOCK``, by default the block
    width), so there are at most rows / ``hot`` hot keys; Catalyst and AQE choose the join by the list's size, and split a hot
    key's partition where it is not broadcast. With ``few_keys`` every key is cut and nothing is counted first.
    """
    place = F.floor(position / F.lit(block)).cast("bigint")
    if few_keys or not keys:
        return df.withColumn("_block", place)
    limit = min(block, BLOCK) if hot is None else hot
    counted = (
        df.groupBy(*[F.col(k).alias(f"_h_{k}") for k in keys])
        .agg(F.count(F.lit(1)).alias("_hot_rows"))
        .filter(F.col("_hot_rows") > limit)
    )
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    return df.join(counted, same, "left").select(
        *df.columns, F.when(F.col("_hot_rows").isNotNull(), place).alias("_block")
    )


@dataclass(frozen=True)
class Running:
    """One running value. ``before`` leaves the current row out."""

    kind: str  # sum | max | last
    value: Column
    before: bool = False

    def local(self, window) -> Column:
        fn = {"sum": F.sum, "max": F.max}.get(self.kind)
        value = fn(self.value) if fn else F.last(self.value, ignorenulls=True)
        return value.over(window)

    def total(self, order: Column) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def join(self, carried: Column, local: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
        if self.kind == "max":
            return F.greatest(carried, local)
        return F.coalesce(local, carried)


def plain_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add group columns that are never null and tell null keys apart.

    With plain equality on them, a join finds its rows where the window left them; a null-safe
    comparison would make Spark shuffle both sides once more.
    """
    out, nulls = {}, F.lit(0)
    for i, k in enumerate(keys):
        kind = df.schema[k].dataType
        if isinstance(kind, T.StringType):
            value = F.coalesce(F.col(k), F.lit(""))
        elif isinstance(kind, (T.NumericType, T.BooleanType)):
            value = F.coalesce(F.col(k), F.lit(0).cast(kind))
        else:
            value = F.to_json(F.struct(k))
        out[f"_key{i}"] = value
        nulls = nulls + F.when(F.col(k).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    if keys:
        out["_nulls"] = nulls
    return df.withColumns(out), list(out)


def count_if(cond: Column | None = None, before: bool = False) -> Running:
    one = F.lit(1) if cond is None else F.when(cond, 1).otherwise(0)
    return Running("sum", one.cast("bigint"), before)


def running(
    df: DataFrame,
    out: dict[str, Running],
    keys: Sequence[str] = (),
    order: str = "seq",
    block: int = BLOCK,
    levels: int | None = None,
    descending: bool = False,
    few_keys: bool = False,
) -> DataFrame:
    """Add running values per key in the order of a unique integer column.

    ``levels`` above 1 scans the block table in blocks too (the default without keys, where one
    task would scan all of it: an order with gaps has up to a block for each row). ``few_keys`` tells that nearly every key is hot (such as a table name).
    A ``_block`` column that is there already (from ``with_block``) is used and kept.
    """
    levels = levels or (1 if keys else 2)
    position = -F.col(order) if descending else F.col(order)
    blocked = df if "_block" in df.columns else with_block(df, keys, position, block, few_keys)
    blocked, group_keys = plain_keys(blocked, keys)
    group = [*group_keys, "_block"]

    totals = (
        blocked.filter(F.col("_block").isNotNull())
        .groupBy(*group)
        .agg(*[r.total(position).alias(f"_t_{n}") for n, r in out.items()])
    )
    if levels > 1:
        carried = running(
            totals.withColumnRenamed("_block", f"_block{levels}"),
            {f"_c_{n}": Running(r.kind, F.col(f"_t_{n}"), before=True) for n, r in out.items()},
            group_keys, f"_block{levels}", SUPER_BLOCK, levels - 1, few_keys=few_keys,
        ).withColumnRenamed(f"_block{levels}", "_block")
    else:
        earlier = (
            Window.partitionBy(*group_keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        )
        carried = totals.select(
            *group,
            *[
                Running(r.kind, F.col(f"_t_{n}")).local(earlier).alias(f"_c_{n}")
                for n, r in out.items()
            ],
        )
    carried = carried.select(*group, *[f"_c_{n}" for n in out])

    inside = Window.partitionBy(*group).orderBy(position.asc())
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prior = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = blocked.withColumns(
        {f"_l_{n}": r.local(prior if r.before else upto) for n, r in out.items()}
    )
    return local.join(carried, group, "left").select(
        *df.columns,
        *[r.join(F.col(f"_c_{n}"), F.col(f"_l_{n}")).alias(n) for n, r in out.items()],
    )


def arrival_number(df: DataFrame, name: str, keys: Sequence[str] = (), where: Column | None = None, **kw) -> DataFrame:
    """Number rows 1, 2, … in arrival order (only rows where ``where`` holds move the count)."""
    return running(df, {name: count_if(where)}, keys, **kw)
