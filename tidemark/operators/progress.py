"""LSN progress, staleness, checkpoints and schema versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.model import instant, span_micros
from tidemark.operators.filters import Stage
from tidemark.plans.blocks import Running, running


def watermark_status(as_of=None, stale_after=30, keys: Sequence[str] = ()) -> Stage:
    """Highest lsn, the time it was first reached, and whether that is too long ago."""
    now = F.unix_micros(instant(as_of))

    def run(df: DataFrame) -> DataFrame:
        moved = F.when(F.col("lsn") > 0, F.struct("lsn", -F.col("seq")))
        out = df.groupBy(*keys).agg(
            F.coalesce(F.max(F.when(F.col("lsn") > 0, F.col("lsn"))), F.lit(0)).alias("lsn"),
            F.max_by("ts", moved).alias("updated_at"),
        )
        stale = F.col("updated_at").isNull() | (now - F.unix_micros("updated_at") > span_micros(stale_after))
        return out.withColumn("stale", stale)

    return run


def fingerprint() -> Column:
    names = F.transform(
        "columns", lambda c: F.concat(c["name"], F.lit("("), c["type_oid"].cast("string"), F.lit(")"))
    )
    return F.concat(F.col("schema_name"), F.lit("."), F.col("table_name"), F.lit(":"), F.array_join(names, ""))


def schema_version(**kw) -> Stage:
    """Version and change flag of every relation observation (``relations`` rows)."""

    def run(relations: DataFrame) -> DataFrame:
        observed = relations.withColumn("_fp", fingerprint())
        seen = running(observed, {"_prev": Running("last", F.col("_fp"), before=True)}, ["relation_id"], few_keys=True, **kw)
        changed = ~F.col("_fp").eqNullSafe(F.col("_prev"))
        flagged = seen.withColumn("changed", changed)
        counted = running(
            flagged, {"version": Running("sum", F.col("changed").cast("bigint"))}, ["relation_id"], few_keys=True, **kw
        )
        return counted.drop("_fp", "_prev")

    return run


def schema_evolve(table: str | None = None, **kw) -> Stage:
    """One event per schema change: relation, table, version and the row that brought it.

    With a table given, rows of other tables are not observed at all.
    """
    return lambda relations: relations.filter(scope_of_relation(table)).transform(schema_version(**kw)).filter("changed").drop("changed")


def scope_of_relation(table: str | None) -> Column:
    return F.coalesce(F.col("table_name") == table, F.lit(False)) if table else F.lit(True)
