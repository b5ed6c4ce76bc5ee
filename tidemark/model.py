"""The change-row data model and the mappings from ordinary tables to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
CELLS = T.ArrayType(CELL)
META = T.MapType(T.StringType(), T.StringType())

CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("wal_ts", T.TimestampType()),
        T.StructField("action", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("columns", CELLS),
        T.StructField("old_keys", CELLS),
        T.StructField("meta", META),
        T.StructField("relation_id", T.LongType()),
    ]
)

RELATION_COLUMNS = T.ArrayType(
    T.StructType([T.StructField("name", T.StringType()), T.StructField("type_oid", T.LongType())])
)
RELATIONS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("relation_id", T.LongType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("columns", RELATION_COLUMNS),
        T.StructField("deleted", T.BooleanType()),
    ]
)

TUPLE = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("data", T.StringType())])
)
RAW_CHANGES = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("lsn", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("relation_id", T.LongType()),
        T.StructField("new_tuple", TUPLE),
        T.StructField("old_tuple", TUPLE),
    ]
)

DATA_ACTIONS = ("INSERT", "UPDATE", "DELETE")
ACTIONS = DATA_ACTIONS + ("TRUNCATE",)


def parse_lsn(text: Column) -> Column:
    """``hi/lo`` hexadecimal log position to BIGINT."""
    part = F.split(text, "/")
    return F.conv(part[0], 16, 10).cast("bigint") * F.lit(4294967296) + F.conv(part[1], 16, 10).cast("bigint")


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def span_micros(span) -> int:
    """A duration given as seconds (int/float) or ``datetime.timedelta``, in microseconds."""
    seconds = span.total_seconds() if hasattr(span, "total_seconds") else span
    return int(round(seconds * 1_000_000))


def instant(value) -> Column:
    """An ``as_of`` parameter: Column as is, text as a UTC timestamp, None as the current time."""
    if value is None:
        return F.current_timestamp()
    if isinstance(value, Column):
        return value
    text = str(value)
    return F.to_timestamp(F.lit(text if text.endswith("Z") else text + "Z"))


def as_text(df: DataFrame, name: str) -> Column:
    """The text form of a column. Doubles go through DECIMAL so no exponent form appears."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        column = column.cast("decimal(18,2)")
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, "yyyy-MM-dd HH:mm:ss")
    return column.cast("string")


def cell(name: str, value: Column, type_: str | None = None) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        F.lit(type_).cast("string").alias("type"),
        value.cast("string").alias("value"),
    )


def rows_to_changes(
    df: DataFrame, table: str, key: str, ts: str | None = None, columns: list[str] | None = None,
    schema: str = "public",
) -> DataFrame:
    """A table whose rows arrived as INSERTs in the order of the integer column ``key``."""
    names = columns or df.columns
    when = F.col(ts).cast("timestamp") if ts else F.lit(None).cast("timestamp")
    return df.select(
        F.col(key).cast("bigint").alias("seq"),
        (F.col(key).cast("bigint") + 1).alias("lsn"),
        when.alias("ts"),
        when.alias("wal_ts"),
        F.lit("INSERT").alias("action"),
        F.lit(schema).alias("schema_name"),
        F.lit(table).alias("table_name"),
        F.array(*[cell(n, as_text(df, n)) for n in names]).alias("columns"),
        F.lit(None).cast(CELLS).alias("old_keys"),
        F.create_map().cast(META).alias("meta"),
        F.lit(None).cast("bigint").alias("relation_id"),
    )


def events_to_changes(events: DataFrame) -> DataFrame:
    """The shared derivation of a change log from the ``events`` table."""
    user = F.col("user_id")
    action = (
        F.when(F.col("event_type") == "signup", "INSERT")
        .when(F.col("event_type") == "error", "DELETE")
        .otherwise("UPDATE")
    )
    tables = F.array(*[F.lit(t) for t in ("accounts", "orders", "sessions", "users")])
    when = F.col("ts").cast("timestamp")
    return events.select(
        F.col("event_id").alias("seq"),
        (F.col("event_id") * 10 + (F.col("event_id") * 7919) % 97 + 1).alias("lsn"),
        when.alias("ts"),
        when.alias("wal_ts"),
        action.alias("action"),
        F.lit("public").alias("schema_name"),
        F.get(tables, (user % 4).cast("int")).alias("table_name"),
        F.array(
            cell("user_id", user),
            cell("event_type", F.col("event_type")),
            cell("value", as_text(events, "value")),
            cell("props", F.col("props")),
        ).alias("columns"),
        F.when(action != "INSERT", F.array(cell("user_id", user))).alias("old_keys"),
        F.create_map().cast(META).alias("meta"),
        (user % 4 + 1).alias("relation_id"),
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the session zone is pinned so that times read as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_to_changes(read_table(spark, sf_dir, "events"))
