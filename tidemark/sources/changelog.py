"""Scans of change logs, as batch or stream, and the relation dictionary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.model import CELLS, CHANGES, META
from tidemark.plans.asof import asof_by_seq
from tidemark.plans.blocks import Running, running

FORMATS = ("parquet", "json", "orc")


def _source(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"scan: unknown format {fmt!r}; one of {', '.join(FORMATS)}")


def scan_changes(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = CHANGES) -> DataFrame:
    """A change log on files, with the fixed schema."""
    _source(fmt)
    return spark.read.schema(schema).format(fmt).load(path)


def stream_changes(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = CHANGES, files_per_trigger: int = 1000
) -> DataFrame:
    """The same log as a stream. Progress is kept in the query's checkpoint location."""
    _source(fmt)
    return (
        spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)
    )


def _parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of JSON lines, and ``malformed``: the line itself where it is no row of the schema."""
    fields = T.StructType([*schema.fields, T.StructField("_line", T.StringType())])
    row = F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_line"})
    broken = F.col("_row._line").isNotNull() | F.col("_row").isNull() | F.col("_row.seq").isNull()
    kept = [F.when(~F.col("_bad"), F.col(f"_row.`{f.name}`")).alias(f.name) for f in schema.fields]
    return lines.withColumn("_row", row).withColumn("_bad", broken).select(
        *kept, F.when(F.col("_bad"), F.col("value")).alias("malformed"), F.col("_metadata.file_path").alias("file")
    )


def scan_lines(spark: SparkSession, path: str, schema: T.StructType = CHANGES) -> DataFrame:
    """A change log in JSON lines of which some may be broken: the log's columns, ``malformed`` and ``file``.

    A line that does not parse, has a value of another type or no ``seq`` comes as it is in ``malformed``, with no columns
    set. One pass; :func:`part_malformed` parts the two.
    """
    return _parsed(spark.read.text(path), schema)


def stream_lines(spark: SparkSession, path: str, schema: T.StructType = CHANGES, files_per_trigger: int = 1000) -> DataFrame:
    return _parsed(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path), schema)


def part_malformed(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of the log, and the broken lines with their files."""
    rows = scanned.filter("malformed IS NULL").drop("malformed", "file")
    return rows, scanned.filter("malformed IS NOT NULL").select(F.col("malformed").alias("line"), "file")


def latest_relations(relations: DataFrame) -> DataFrame:
    """The newest entry per id, deletions among them; on a stream, in update mode, for a table that it overwrites."""
    fields = [f for f in ("seq", "schema_name", "table_name", "columns", "deleted") if f in relations.columns]
    latest = relations.groupBy("relation_id").agg(F.max_by(F.struct(*fields), "seq").alias("_r"))
    return latest.select("relation_id", *[F.col(f"_r.{f}").alias(f) for f in fields])


def known_relations(latest: DataFrame) -> DataFrame:
    return latest.filter(~F.coalesce(F.col("deleted"), F.lit(False))).drop("deleted") if "deleted" in latest.columns else latest


def relation_dictionary(relations: DataFrame) -> DataFrame:
    """The relation in force per id; an id whose last entry is a deletion is gone."""
    return known_relations(latest_relations(relations))


def lookup_relation(keys: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Relation of every requested id; ``error`` tells the unknown ones."""
    out = keys.join(dictionary, "relation_id", "left")
    text = F.concat(F.lit("unknown relation id "), F.col("relation_id").cast("string"))
    return out.withColumn("error", F.when(F.col("table_name").isNull(), text))


# Raw row kinds that carry data, and their actions.
KINDS = {"insert": "INSERT", "update": "UPDATE", "delete": "DELETE", "truncate": "TRUNCATE"}


def _cells(tuple_: Column, names: Column) -> Column:
    """Named cells of a raw tuple; positions past the relation's columns get an empty name."""
    return F.transform(
        tuple_,
        lambda v, i: F.struct(
            F.coalesce(F.get(names, i)["name"], F.lit("")).alias("name"),
            F.lit(None).cast("string").alias("type"),
            F.when(v["kind"] == "t", v["data"]).alias("value"),
        ),
    )


def _resolved(raw: DataFrame) -> DataFrame:
    """Change rows from raw rows that carry their relation in ``_rel``; adds ``decode_error``."""
    action = F.lit(None).cast("string")
    for kind, name in KINDS.items():
        action = F.when(F.col("kind") == kind, F.lit(name)).otherwise(action)
    whole = F.col("kind") == "truncate"
    known = F.col("_rel").isNotNull() & ~F.coalesce(F.col("_rel.deleted"), F.lit(False))
    error = F.when(
        ~whole & ~known, F.concat(F.lit("unknown relation id "), F.col("relation_id").cast("string"))
    )
    names = F.col("_rel.columns")
    new = F.when(F.col("kind").isin("insert", "update"), _cells(F.col("new_tuple"), names))
    old = F.when(F.col("kind").isin("update", "delete"), _cells(F.col("old_tuple"), names))
    return raw.filter(F.col("kind").isin(*KINDS)).select(
        "seq", "lsn", "ts",
        F.col("ts").alias("wal_ts"),
        action.alias("action"),
        F.when(~whole, F.col("_rel.schema_name")).alias("schema_name"),
        F.when(~whole, F.col("_rel.table_name")).alias("table_name"),
        new.cast(CELLS).alias("columns"),
        old.cast(CELLS).alias("old_keys"),
        F.create_map().cast(META).alias("meta"),
        F.when(~whole, F.col("relation_id")).alias("relation_id"),
        error.alias("decode_error"),
    )


def _relation_struct(relations: DataFrame) -> DataFrame:
    deleted = F.col("deleted") if "deleted" in relations.columns else F.lit(False)
    return relations.select(
        "relation_id", "seq",
        F.struct("schema_name", "table_name", "columns", deleted.alias("deleted")).alias("_rel"),
    )


def decode_changes(raw: DataFrame, relations: DataFrame, many_versions: bool = False, **kw) -> DataFrame:
    """Name the columns of raw rows by the relation in force when each row arrived.

    Rows of an unknown relation keep their place with ``decode_error`` set; use
    ``operators.filters.split_errors`` to part them. Rows are joined to the validity ranges of the relation
    versions, so the log is not shuffled where those are small. With ``many_versions`` (definitions that change
    all the time) both sides are put in one order instead, which is linear however many versions an id has.
    """
    if many_versions:
        data = raw.filter(F.col("kind").isin(*KINDS))
        return _resolved(asof_by_seq(data, _relation_struct(relations), ["relation_id"], "_rel", few_keys=True, **kw))
    return decode_stream(raw, relations, **kw)


def relation_ranges(relations: DataFrame, **kw) -> DataFrame:
    """Validity ranges of the relation versions. Repeated announcements of the same version are
    merged first, so an id has as many ranges as its definition had changes."""
    known = _relation_struct(relations)
    seen = running(known, {"_was": Running("last", F.col("_rel"), before=True)}, ["relation_id"], few_keys=True, **kw)
    changed = seen.filter(~F.col("_rel").eqNullSafe(F.col("_was")))
    by_id = Window.partitionBy("relation_id").orderBy("seq")
    return changed.select(
        F.col("relation_id").alias("_id"), F.col("seq").alias("_from"), F.lead("seq").over(by_id).alias("_to"), "_rel"
    )


def decode_stream(raw: DataFrame, relations: DataFrame, **kw) -> DataFrame:
    """Streaming form: a raw stream against the relation log known so far."""
    held = (
        (F.col("relation_id") == F.col("_id"))
        & (F.col("seq") > F.col("_from"))
        & (F.col("_to").isNull() | (F.col("seq") < F.col("_to")))
    )
    data = raw.filter(F.col("kind").isin(*KINDS))
    return _resolved(data.join(relation_ranges(relations, **kw), held, "left").drop("_id", "_from", "_to"))
