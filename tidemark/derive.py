"""Side inputs of the registered queries, all computed from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.model import RELATION_COLUMNS, TUPLE, as_text

# Type numbers of bigint, text and double columns.
OID_BIGINT, OID_TEXT, OID_DOUBLE = 20, 25, 701


def relation_log(events: DataFrame) -> DataFrame:
    """Relations announced at their first event of every day. The column ``props`` joins in
    the second half of a month; relation 4 is dropped with its announcement on a 30th."""
    day = F.dayofmonth("ts")
    column = lambda n, t: F.struct(F.lit(n).alias("name"), F.lit(t).cast("bigint").alias("type_oid"))
    base = [column("user_id", OID_BIGINT), column("event_type", OID_TEXT), column("value", OID_DOUBLE)]
    names = F.array(*[F.lit(t) for t in ("accounts", "orders", "sessions", "users")])
    return (
        events.groupBy((F.col("user_id") % 4).alias("_r"), F.to_date("ts").alias("_day"))
        .agg((F.min("event_id") * 2).alias("seq"), F.min(day).alias("_dom"))
        .select(
            "seq",
            (F.col("_r") + 1).alias("relation_id"),
            F.lit("public").alias("schema_name"),
            F.get(names, F.col("_r").cast("int")).alias("table_name"),
            F.when(F.col("_dom") >= 15, F.array(*base, column("props", OID_TEXT)))
            .otherwise(F.array(*base))
            .cast(RELATION_COLUMNS)
            .alias("columns"),
            ((F.col("_r") == 3) & (F.col("_dom") == 30)).alias("deleted"),
        )
    )


def raw_log(events: DataFrame) -> DataFrame:
    """Raw rows as a replication stream carries them, between the relation announcements."""
    text = lambda v: F.struct(F.lit("t").alias("kind"), v.cast("string").alias("data"))
    none = lambda k: F.struct(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("data"))
    value = as_text(events, "value")
    kind = (
        F.when(F.col("event_type") == "signup", "insert")
        .when(F.col("event_type") == "error", "delete")
        .when((F.col("event_type") == "click") & (F.col("value") < 2), "truncate")
        .otherwise("update")
    )
    new = F.array(
        text(F.col("user_id")),
        text(F.col("event_type")),
        F.when(F.col("value") < 5, none("u")).otherwise(text(value)),
        F.when(F.col("value") > 100, none("n")).otherwise(text(F.col("props"))),
    ).cast(TUPLE)
    old = F.array(text(F.col("user_id"))).cast(TUPLE)
    return events.select(
        (F.col("event_id") * 2 + 1).alias("seq"),
        (F.col("event_id") * 10 + (F.col("event_id") * 7919) % 97 + 1).alias("lsn"),
        F.col("ts").cast("timestamp").alias("ts"),
        kind.alias("kind"),
        F.when(F.col("value") < 1, F.lit(9)).otherwise(F.col("user_id") % 4 + 1).cast("bigint").alias("relation_id"),
        F.when(kind.isin("insert", "update"), new).alias("new_tuple"),
        F.when((kind == "delete") | ((kind == "update") & (F.col("value") > 20)), old).alias("old_tuple"),
    )


def day_switch(events: DataFrame) -> DataFrame:
    """A switch that is set at the first event of every day: on for odd days of the month."""
    return (
        events.groupBy(F.to_date("ts").alias("_day"))
        .agg(F.min("ts").cast("timestamp").alias("ts"))
        .select("ts", (F.dayofmonth("_day") % 2 == 1).alias("on"))
    )


def cache_ops(events: DataFrame) -> DataFrame:
    """A user's signups set a value, errors delete it."""
    return events.filter(F.col("event_type").isin("signup", "error")).select(
        F.col("user_id").cast("string").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "set").otherwise("delete").alias("op"),
        as_text(events, "value").alias("value"),
    )
