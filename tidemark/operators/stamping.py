"""Metadata stamping, keys, hashes and ranks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import meta
from tidemark.functions.cells import (
    byte_size, cols, first_match, first_value, last_by_name, last_value_ci, named, scope, shown,
)
from tidemark.functions.hashing import fnv1a_32
from tidemark.functions.text import general_text
from tidemark.operators.filters import Stage
from tidemark.plans.blocks import count_if, running


def _set_meta(value: Column) -> Stage:
    return lambda df: df.withColumn("meta", value)


@dataclass(frozen=True)
class MetaRule:
    key: str
    value: str
    table: str = ""
    action: str = ""


def _rules(rules: Sequence[MetaRule]) -> list[tuple[Column, str, Column]]:
    return [(scope(r.table, r.action, ci=True), r.key, F.lit(r.value)) for r in rules]


def annotate(*rules: MetaRule) -> Stage:
    """Set meta entries for every matching rule; the later rule wins."""
    if not rules:
        raise ValueError("annotate: at least one rule is required")
    if any(not r.key for r in rules):
        raise ValueError("annotate: a rule has an empty key")
    return _set_meta(meta.put_rules(_rules(rules)))


def enrich(pairs: dict[str, str], tables: Sequence[str] = ()) -> Stage:
    """Static entries for the listed tables (any case), all tables if none is listed."""
    if not pairs:
        raise ValueError("enrich: at least one entry is required")
    inside = F.lower("table_name").isin(*[t.lower() for t in tables]) if tables else F.lit(True)
    inside = F.coalesce(inside, F.lit(False))
    return _set_meta(F.when(inside, meta.overlay(meta.current(), meta.literal(pairs))).otherwise(meta.current()))


def label(labels: dict[str, str], overwrite: bool = False) -> Stage:
    """Static labels with lower-cased keys; keys that are there stay unless ``overwrite``."""
    if not labels:
        raise ValueError("label: at least one label is required")
    extra = meta.literal({k.lower(): v for k, v in labels.items()})
    base = meta.current()
    return _set_meta(meta.overlay(base, extra) if overwrite else meta.overlay(extra, base))


def tag(static: dict[str, str] | None = None, *rules: MetaRule) -> Stage:
    """Static tags first, then matching rules on top."""
    base = meta.overlay(meta.current(), meta.literal(static)) if static else meta.current()
    return _set_meta(meta.put_rules(_rules(rules), base))


def pick(column: str, key: str = "", table: str | None = None) -> Stage:
    """The first column of that name into meta; an absent value leaves meta as it is."""
    if not column:
        raise ValueError("pick: a column is needed")
    return _set_meta(meta.put(key or column, first_value(column), scope(table)))


@dataclass(frozen=True)
class PromoteRule:
    column: str
    key: str
    table: str = ""
    action: str = ""


def promote(*rules: PromoteRule) -> Stage:
    """Column values into meta by rule (any case); of several the last present value wins."""
    if not rules:
        raise ValueError("promote: at least one rule is required")
    if any(not r.column or not r.key for r in rules):
        raise ValueError("promote: a rule needs a column and a key")
    steps = []
    for r in rules:
        value = last_value_ci(r.column)
        steps.append((scope(r.table, r.action, ci=True) & value.isNotNull(), r.key, value))
    return _set_meta(meta.put_rules(steps))


def correlate(column: str, key: str, table: str | None = None) -> Stage:
    """Shared correlation id from a column."""
    if not column or not key:
        raise ValueError("correlate: column and key are needed")
    return _set_meta(meta.put(key, first_value(column), scope(table)))


def correlation_groups(key: str) -> Stage:
    """Per correlation id: rows, tables touched, first and last lsn."""
    return lambda df: (
        df.withColumn("correlation_id", F.col("meta")[key])
        .filter(F.col("correlation_id").isNotNull())
        .groupBy("correlation_id")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.size(F.collect_set("table_name")).cast("bigint").alias("tables"),
            F.min("lsn").alias("first_lsn"),
            F.max("lsn").alias("last_lsn"),
        )
    )


@dataclass(frozen=True)
class ScoreRule:
    score: float
    table: str = ""
    action: str = ""


def score(rules: Sequence[ScoreRule], default: float = 0.0, field: str = "score") -> Stage:
    """Score of the first matching rule, as text in meta."""
    if not field:
        raise ValueError("score: a field is needed")
    text = first_match([(scope(r.table, r.action), general_text(r.score)) for r in rules], general_text(default))
    return _set_meta(meta.put(field, text))


LOW, NORMAL, HIGH = 0, 1, 2


@dataclass(frozen=True)
class PriorityRule:
    level: int
    table: str = ""
    action: str = ""


def priority(rules: Sequence[PriorityRule], default: int = NORMAL) -> Stage:
    """Add ``priority``: the level of the first matching rule."""
    if not rules:
        raise ValueError("priority: at least one rule is required")
    level = first_match([(scope(r.table, r.action), int(r.level)) for r in rules], int(default))
    return lambda df: df.withColumn("priority", level)


def priority_sort() -> Stage:
    """High before low, arrival order within a level."""
    return lambda df: df.orderBy(F.desc("priority"), "seq")


def priority_position(**kw) -> Stage:
    """Add ``pos``: the place of a row in priority order, without sorting everything in one task."""

    def run(df: DataFrame) -> DataFrame:
        ranked = running(df, {"_rank": count_if()}, ["priority"], few_keys=True, **kw)
        higher = Window.orderBy(F.desc("priority")).rowsBetween(Window.unboundedPreceding, -1)
        ahead = (
            df.groupBy("priority")
            .agg(F.count(F.lit(1)).alias("_size"))
            .select(
                F.col("priority").alias("_level"),
                F.coalesce(F.sum("_size").over(higher), F.lit(0)).alias("_ahead"),
            )
        )
        return (
            ranked.join(ahead, F.col("priority") == F.col("_level"))
            .withColumn("pos", F.col("_rank") + F.col("_ahead"))
            .drop("_rank", "_level", "_ahead")
        )

    return run


def partition_bucket(n: int, by: str = "table") -> Column:
    """Bucket number by FNV-1a of the table, the action or the first column's value."""
    if n < 1:
        raise ValueError("partition_by: at least one bucket is needed")
    if by == "action":
        key = F.coalesce("action", F.lit(""))
    elif by == "first_column":
        key = F.when(F.size(F.coalesce(cols(), F.array())) > 0, shown(F.get(cols(), F.lit(0)))).otherwise(F.lit(""))
    else:
        key = F.coalesce("table_name", F.lit(""))
    return fnv1a_32(key) % n


def partition_by(n: int, by: str = "table") -> Stage:
    return lambda df: df.withColumn("bucket", partition_bucket(n, by))


def route_key(strategy: str = "table") -> Column:
    """``table``, ``action`` or ``table.action``; an unknown strategy is ``table``."""
    table, action = F.coalesce("table_name", F.lit("")), F.coalesce("action", F.lit(""))
    kind = strategy.lower()
    if kind == "action":
        return action
    return F.concat_ws(".", table, action) if kind == "table.action" else table


def digest(algorithm: str = "sha256", columns: Sequence[str] = (), field: str = "_digest") -> Stage:
    """Hash of ``name=value;`` over the columns sorted by name, into meta."""
    if algorithm not in ("sha256", "md5"):
        raise ValueError(f"digest: unknown algorithm {algorithm!r}")
    body = last_by_name()
    if columns:
        body = F.filter(body, lambda c: named(c, columns))
    ordered = F.array_sort(F.transform(body, lambda c: F.struct(c["name"], shown(c).alias("shown"))))
    text = F.coalesce(
        F.array_join(F.transform(ordered, lambda c: F.concat(c["name"], F.lit("="), c["shown"], F.lit(";"))), ""),
        F.lit(""),
    )
    return _set_meta(meta.put(field, F.sha2(text, 256) if algorithm == "sha256" else F.md5(text)))


def row_id(length: int = 26) -> Column:
    """Repeatable id of a row from its place in the log."""
    place = F.concat_ws(":", F.col("seq").cast("string"), F.col("lsn").cast("string"))
    return F.substring(F.sha2(place, 256), 1, length)


def trace(table: str | None = None, field: str = "trace_id", hop_field: str = "trace_hop") -> Stage:
    """Trace id where none is set, hop count + 1, and the text in ``trace_line``."""

    def run(df: DataFrame) -> DataFrame:
        inside = scope(table)
        known = F.col("meta")[field]
        id_ = F.when(F.coalesce(known, F.lit("")) == "", row_id()).otherwise(known)
        digits = F.regexp_extract(F.coalesce(F.col("meta")[hop_field], F.lit("")), r"^\s*([+-]?[0-9]+)", 1)
        hop = F.coalesce(digits.try_cast("bigint"), F.lit(0)) + 1
        line = F.concat(
            F.lit("[trace] "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"),
            F.lit(" id="), id_, F.lit(" hop="), hop.cast("string"), F.lit(" table="), F.col("table_name"),
            F.lit(" action="), F.col("action"), F.lit(" lsn="), F.col("lsn").cast("string"),
        )
        stamped = meta.put(hop_field, hop.cast("string"), inside, base=meta.put(field, id_, inside))
        return df.withColumns({"trace_line": F.when(inside, line), "meta": stamped})

    return run


def message_size(into: str = "bytes") -> Stage:
    return lambda df: df.withColumn(into, byte_size())
