"""Stages that combine rows: merge, last-write-wins, keyed store, timed lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import cols
from tidemark.model import CELLS, span_micros
from tidemark.operators.filters import Stage
from tidemark.plans.asof import asof_by_time


def merge(src: DataFrame, on: Sequence[str], prefer: str = "src", table: str | None = None) -> Stage:
    """Merge the columns of the matching ``src`` row into each row.

    On a shared name the preferred side's cell stays; new columns follow in ``src`` order.
    A row without a match stays as it is. ``src`` has one row per key.
    """
    if prefer not in ("src", "dst"):
        raise ValueError("merge: prefer is 'src' or 'dst'")

    def run(dst: DataFrame) -> DataFrame:
        other = src.select(
            *[F.col(k).alias(f"_m_{k}") for k in on], F.col("columns").alias("_src"),
            F.col("table_name").alias("_src_table"),
        )
        same = F.lit(True)
        for k in on:
            same = same & (F.col(k) == F.col(f"_m_{k}"))
        mine = F.coalesce(cols(), F.array().cast(CELLS))
        theirs = F.col("_src")
        last = lambda c: F.try_element_at(F.filter(theirs, lambda s: s["name"] == c["name"]), F.lit(-1))
        shared = mine
        if prefer == "src":
            # Of several equal names only the last is addressed.
            names = F.transform(mine, lambda c: c["name"])
            later = lambda c, i: F.array_contains(F.slice(names, i + 2, F.size(names)), c["name"])
            shared = F.when(
                F.size(F.array_distinct(names)) == F.size(names), F.transform(mine, lambda c: F.coalesce(last(c), c))
            ).otherwise(F.transform(mine, lambda c, i: F.when(later(c, i), c).otherwise(F.coalesce(last(c), c))))
        added = F.filter(theirs, lambda s: ~F.exists(mine, lambda c: c["name"] == s["name"]))
        merged = F.concat(shared, added)
        applies = theirs.isNotNull()
        if table:
            applies = applies & (F.col("table_name") == table) & (F.col("_src_table") == table)
        return (
            dst.join(other, same, "left")
            .withColumn("columns", F.when(F.coalesce(applies, F.lit(False)), merged).otherwise(cols()))
            .drop("_src", "_src_table", *[f"_m_{k}" for k in on])
        )

    return run


def coalesce_key(key_column: str) -> Column:
    """The key value of a row in lower case; absent counts as empty, of several the last holds."""
    last = F.try_element_at(F.filter(cols(), lambda c: c["name"] == key_column), F.lit(-1))["value"]
    return F.lower(F.coalesce(last, F.lit("")))


def coalesce_rows(key_column: str, tables: Sequence[str] = ()) -> Stage:
    """One row per table and key value (any case): last write wins per column name.

    Other fields and the place are those of the first row, the lsn that of the last. Columns
    come back sorted by name. Only numbers are aggregated by row and by cell; the rows and cells that win are joined by them.
    """
    if not key_column.strip():
        raise ValueError("coalesce_rows: a key column is needed")

    def run(df: DataFrame) -> DataFrame:
        listed = [t.lower() for t in tables]
        inside = F.coalesce(F.lower("table_name").isin(*listed), F.lit(False)) if listed else F.lit(True)
        keyed = df.filter(inside).withColumns({"_table": F.coalesce("table_name", F.lit("")), "_key": coalesce_key(key_column)})
        group = ["_table", "_key"]
        heads = keyed.groupBy(*group).agg(F.min("seq").alias("_head"), F.max_by("lsn", "seq").alias("_lsn"))
        # A row's cells by name, the last of each name; then the newest row of each name, by number.
        names = F.array_distinct(F.transform(cols(), lambda c: c["name"]))
        newest = keyed.select(*group, "seq", F.explode(names).alias("_name")).groupBy(*group, "_name").agg(F.max("seq").alias("_won"))
        won = newest.groupBy(*group, "_won").agg(F.collect_list("_name").alias("_names"))
        last = F.transform("_names", lambda n: F.try_element_at(F.filter(cols(), lambda c: c["name"].eqNullSafe(n)), F.lit(-1)))
        # As many entries per key as its table has column names.
        body = (
            keyed.select("seq", "columns").join(won, F.col("seq") == F.col("_won")).select(*group, last.alias("_cells"))
            .groupBy(*group).agg(F.array_sort(F.flatten(F.collect_list("_cells"))).alias("_body"))
        )
        first = heads.join(body, group, "left").select("_head", "_lsn", "_body")
        out = df.filter(inside).join(first, F.col("seq") == F.col("_head"))
        out = out.withColumns({"lsn": F.col("_lsn"), "columns": F.col("_body")}).select(df.columns)
        return out.unionByName(df.filter(~inside)) if listed else out

    return run


def stash_latest(key: str, max_size: int = 256) -> Stage:
    """Last row per key, for the first ``max_size`` keys that arrived; later keys are refused."""
    size = max_size if max_size > 0 else 256

    def run(df: DataFrame) -> DataFrame:
        keyed = df.filter(F.coalesce(F.col(key), F.lit("")) != "")
        admitted = keyed.groupBy(key).agg(F.min("seq").alias("_first"), F.max("seq").alias("_last"))
        chosen = admitted.orderBy("_first").limit(size).select("_last")
        return df.join(chosen, F.col("seq") == F.col("_last"), "left_semi")

    return run


def ttl_lookup(ops: DataFrame, key: str, ttl, into: str = "cached") -> Stage:
    """The value set last for the row's key, if its age is at most ``ttl``; null on a miss.

    ``ops``: ``key``, ``ts``, ``seq``, ``op`` (set or delete), ``value``.
    """
    span = span_micros(ttl)
    entries = ops.select(
        F.col("key").alias("_key"), "ts", "seq",
        F.struct("op", "value", F.unix_micros("ts").alias("at")).alias("_entry"),
    )

    def run(df: DataFrame) -> DataFrame:
        seen = asof_by_time(df.withColumn("_key", F.col(key)), entries, ["_key"], "_entry", tie="seq")
        alive = (F.col("_entry.op") == "set") & (F.unix_micros("ts") <= F.col("_entry.at") + span)
        return seen.withColumn(into, F.when(alive, F.col("_entry.value"))).drop("_key", "_entry")

    return run


def ttl_purge(ops: DataFrame, ttl, as_of) -> DataFrame:
    """How many keys hold an entry that has expired at ``as_of``."""
    last = ops.groupBy("key").agg(F.max_by(F.struct("op", "ts"), F.struct("ts", "seq")).alias("e"))
    late = F.unix_micros(as_of) > F.unix_micros("e.ts") + span_micros(ttl)
    return last.filter(F.col("e.op") == "set").agg(F.count_if(late).alias("purged"))


