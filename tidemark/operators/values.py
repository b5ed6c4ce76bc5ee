"""Column projections and value transforms."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cells import (
    TYPED, cols, first_value, is_text, last_by_name, map_values, named, scope, shown, with_value,
)
from tidemark.functions.text import general_number, general_text, trim_space
from tidemark.model import CELLS
from tidemark.operators.filters import Stage

def _text_type() -> Column:
    return F.lit(None).cast("string")


def project(keep: Sequence[str] = (), exclude: Sequence[str] = (), table: str | None = None) -> Stage:
    """Keep only the listed columns, or all but the listed ones. Column order stays."""
    if keep and exclude:
        raise ValueError("project: keep and exclude cannot both be given")
    if not keep and not exclude:
        return lambda df: df
    wanted = (lambda c: named(c, keep)) if keep else (lambda c: ~named(c, exclude))
    return lambda df: df.withColumn(
        "columns", F.when(scope(table), F.filter(cols(), wanted)).otherwise(cols())
    )


def get_column(name: str, into: str) -> Stage:
    return lambda df: df.withColumn(into, first_value(name))


def flatten(into: str = "flat", with_table: bool = False, sep: str = ".") -> Stage:
    """Columns as a text map in ``into``; a typed value is an error, told in ``flatten_error``."""
    prefix = F.lit("")
    if with_table:
        known = F.coalesce("table_name", F.lit("")) != ""
        prefix = F.when(known, F.concat(F.col("table_name"), F.lit(sep))).otherwise(prefix)
    pairs = F.transform(
        last_by_name(),
        lambda c: F.struct(F.concat(prefix, c["name"]), F.coalesce(c["value"], F.lit(""))),
    )
    typed = F.get(F.filter(cols(), lambda c: c["type"].isin(*TYPED) & c["value"].isNotNull()), F.lit(0))
    error = F.when(
        typed.isNotNull(), F.concat(F.lit("flatten: column "), typed["name"], F.lit(" is not text: "), typed["type"])
    )
    return lambda df: df.withColumns(
        {into: F.when(error.isNull(), F.map_from_entries(pairs)), "flatten_error": error}
    )


def rename_table(old: str, new: str) -> Stage:
    hit = F.lower("table_name") == old.lower()
    return lambda df: df.withColumn("table_name", F.when(hit, F.lit(new)).otherwise(F.col("table_name")))


def mask_columns(*names: str, text: str = "***") -> Stage:
    return lambda df: df.withColumn(
        "columns",
        F.transform(
            cols(),
            lambda c: F.when(named(c, names), with_value(c, F.lit(text), _text_type())).otherwise(with_value(c, c["value"])),
        ),
    )


@dataclass(frozen=True)
class MaskRule:
    column: str
    mode: str = "redact"  # redact | hash | blank
    table: str = ""  # empty or * is every table
    text: str = "***"

    def covers(self, c: Column) -> Column:
        every = self.table in ("", "*")
        here = F.lit(True) if every else F.lower("table_name") == self.table.lower()
        return here & (F.lower(c["name"]) == self.column.lower())

    def masked(self, c: Column) -> Column:
        if self.mode == "hash":
            return F.sha2(shown(c), 256)
        return F.lit("" if self.mode == "blank" else self.text or "***")


def mask_rules(*rules: MaskRule) -> Stage:
    """Apply mask rules; all read the original value and the last matching rule decides."""
    if not rules:
        raise ValueError("mask_rules: at least one rule is required")
    if any(r.mode not in ("redact", "hash", "blank") for r in rules):
        raise ValueError("mask_rules: unknown mode")

    def one(c: Column) -> Column:
        # From the last rule on, so that each rule is tested once at most.
        out = with_value(c, c["value"])
        for rule in rules:
            out = F.when(rule.covers(c), with_value(c, rule.masked(c), F.lit(None).cast("string"))).otherwise(out)
        return out

    return lambda df: df.withColumn("columns", F.transform(cols(), one))


def redact(columns: dict[str, Sequence[str]] | None = None, pattern: str = "", text: str = "[REDACTED]") -> Stage:
    """Replace listed columns of a table, else any text value the pattern matches anywhere.

    The listed names are lower-cased and compared with the column name as it is.
    """
    re.compile(pattern)
    text = text or "[REDACTED]"

    def hit(c: Column) -> Column:
        listed = F.lit(False)
        for table, names in (columns or {}).items():
            listed = listed | ((F.col("table_name") == table) & named(c, [n.lower() for n in names]))
        found = c["value"].rlike(pattern) if pattern else F.lit(False)
        return is_text(c) & F.coalesce(listed | found, F.lit(False))

    return lambda df: df.withColumn(
        "columns", map_values(lambda c: F.when(hit(c), F.lit(text)).otherwise(c["value"]))
    )


@dataclass(frozen=True)
class CastRule:
    column: str
    type: str  # int | float | bool | string
    table: str = ""


# The accepted texts of each type.
_INT = r"^[+-]?[0-9]+$"
_FLOAT = r"^[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"
_TRUE = ("1", "t", "T", "TRUE", "true", "True")
_FALSE = ("0", "f", "F", "FALSE", "false", "False")


def _coerced(raw: Column, type_: str) -> Column:
    """Canonical text of the value as that type, null if it does not parse.

    Most values need no trimming, so the raw text is tried first.
    """
    if type_ == "string":
        return raw
    text = trim_space(raw)
    if type_ == "int":
        whole = lambda v: v.try_cast("bigint").cast("string")
        return F.when(raw.rlike(_INT), whole(raw)).when(text.rlike(_INT), whole(text))
    if type_ == "float":

        def real(v: Column) -> Column:
            number = v.try_cast("double")
            huge = (F.abs(number) == F.lit(float("inf"))) & ~v.rlike("(?i)inf")
            return F.when(~huge, general_number(number))

        return F.when(raw.rlike(_FLOAT), real(raw)).when(text.rlike(_FLOAT), real(text))
    return F.when(text.isin(*_TRUE), F.lit("true")).when(text.isin(*_FALSE), F.lit("false"))


def cast(*rules: CastRule) -> Stage:
    """Cast text values by rule. The first value that does not parse ends the row's casts
    and is told in ``cast_error``; casts done before it stay."""
    if not rules:
        raise ValueError("cast: at least one rule is required")
    for r in rules:
        if r.type not in ("int", "float", "bool", "string"):
            raise ValueError(f"cast: unsupported type {r.type!r} for column {r.column!r}")

    # Only the first rule with another type than string can change a cell: after a cast the
    # value is no text any more, and a failure ends the row's casts.
    active = [(i, r) for i, r in enumerate(rules) if r.type != "string"]

    def taken(c: Column, at: Column) -> Column:
        """The cell with the number of the rule that takes it and its place in the order of work."""
        rule = F.lit(None).cast("int")
        for i, r in reversed(active):
            here = F.lower("table_name") == r.table.lower() if r.table else F.lit(True)
            rule = F.when((F.lower(c["name"]) == r.column.lower()) & here & is_text(c), F.lit(i)).otherwise(rule)
        return F.struct(F.struct(rule.alias("rule"), at.alias("at")).alias("place"), c.alias("cell"))

    def tried(t: Column) -> Column:
        rule, raw = t["place"]["rule"], t["cell"]["value"]
        value, type_ = F.lit(None).cast("string"), F.lit(None).cast("string")
        for i, r in active:
            value = F.when(rule == i, _coerced(raw, r.type)).otherwise(value)
            type_ = F.when(rule == i, F.lit(r.type)).otherwise(type_)
        return F.struct(t["place"].alias("place"), t["cell"].alias("cell"), value.alias("value"), type_.alias("type"))

    def run(df: DataFrame) -> DataFrame:
        work = F.col("_cast")
        failed = F.filter(work, lambda t: t["place"]["rule"].isNotNull() & t["value"].isNull())
        first = F.col("_failed")
        done = lambda t: t["value"].isNotNull() & (first.isNull() | (t["place"] < first["place"]))
        return (
            df.withColumn("_cast", F.transform(F.transform(cols(), taken), tried))
            .withColumn("_failed", F.array_min(failed))
            .withColumns(
                {
                    "columns": F.transform(
                        work,
                        lambda t: with_value(
                            t["cell"],
                            F.when(done(t), t["value"]).otherwise(t["cell"]["value"]),
                            F.when(done(t), t["type"]).otherwise(t["cell"]["type"]),
                        ),
                    ),
                    "cast_error": F.when(
                        first.isNotNull(),
                        F.format_string(
                            'cast: column "%s" value "%s": not a valid %s',
                            first["cell"]["name"], first["cell"]["value"], first["type"],
                        ),
                    ),
                }
            )
            .drop("_cast", "_failed")
        )

    return run


@dataclass(frozen=True)
class ClampRule:
    column: str
    min: float
    max: float
    table: str = ""


def clamp(*rules: ClampRule) -> Stage:
    """Bring numeric values (after ``cast``) into range; whole numbers truncate toward zero."""
    if not rules:
        raise ValueError("clamp: at least one rule is required")
    for r in rules:
        if not r.column:
            raise ValueError("clamp: a rule has no column")
        if r.min > r.max:
            raise ValueError(f"clamp: rule for column {r.column!r} has min above max")

    by_column: dict[str, list[ClampRule]] = {}
    for r in rules:
        by_column.setdefault(r.column, []).append(r)

    def bounded(value: Column, type_: Column, rule: ClampRule) -> Column:
        number = value.try_cast("double")
        text = lambda bound: F.when(type_ == "int", F.lit(str(int(bound)))).otherwise(F.lit(general_text(bound)))
        moved = F.when(number < float(rule.min), text(rule.min)).when(number > float(rule.max), text(rule.max))
        return F.when(scope(rule.table), F.coalesce(moved, value)).otherwise(value)

    def value(c: Column) -> Column:
        out = c["value"]
        for name, chain_ in by_column.items():
            moved = c["value"]
            for rule in chain_:
                moved = bounded(moved, c["type"], rule)
            out = F.when((c["name"] == name) & c["type"].isin("int", "float"), moved).otherwise(out)
        return out

    return lambda df: df.withColumn("columns", map_values(value))


def clamp_wide(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """``clamp`` for tables whose values are ordinary typed columns."""
    out = {}
    for name, (low, high) in bounds.items():
        kind = df.schema[name].dataType
        moved = F.least(F.greatest(F.col(name), F.lit(low)), F.lit(high))
        out[name] = F.when(F.col(name).isNotNull(), moved).cast(kind if isinstance(kind, T.NumericType) else "double")
    return df.withColumns(out)


trim: Callable[[Column], Column] = trim_space
lower: Callable[[Column], Column] = F.lower
upper: Callable[[Column], Column] = F.upper


def normalize(columns: dict[str, Callable[[Column], Column]], table: str | None = None) -> Stage:
    """Rewrite text values per column with a ``Column -> Column`` function."""
    if not columns:
        raise ValueError("normalize: at least one column is required")

    def value(c: Column) -> Column:
        out = c["value"]
        for name, fn in columns.items():
            out = F.when((c["name"] == name) & is_text(c), fn(c["value"])).otherwise(out)
        return out

    return lambda df: df.withColumn("columns", F.when(scope(table), map_values(value)).otherwise(cols()))


@dataclass(frozen=True)
class LookupRule:
    column: str
    values: dict[str, str]
    table: str = ""
    fallback: str = ""


def lookup(*rules: LookupRule) -> Stage:
    """Replace values by map, else by the fallback if there is one. Rules work in turn."""
    if not rules:
        raise ValueError("lookup: at least one rule is required")
    for r in rules:
        if not r.column or not r.values:
            raise ValueError("lookup: a rule needs a column and a map")

    def one(rule: LookupRule):
        pairs = [F.lit(x) for kv in rule.values.items() for x in kv]
        table = F.create_map(*pairs)

        def rewrite(c: Column) -> Column:
            asked = F.when(is_text(c), c["value"]).otherwise(F.lit(""))
            found = F.try_element_at(table, asked)
            if rule.fallback:
                found = F.coalesce(found, F.lit(rule.fallback))
            hit = scope(rule.table, ci=True) & (F.lower(c["name"]) == rule.column.lower())
            return F.when(hit & found.isNotNull(), with_value(c, found, _text_type())).otherwise(with_value(c, c["value"]))

        return rewrite

    def run(df: DataFrame) -> DataFrame:
        for rule in rules:
            df = df.withColumn("columns", F.transform(cols(), one(rule)))
        return df

    return run


def lookup_table(column: str, mapping: DataFrame, fallback: str = "", table: str | None = None) -> Stage:
    """``lookup`` with a large map, given as a DataFrame of unique ``key`` and ``value``.

    The first cell of that name is looked up by join; Catalyst chooses the join by size.
    """
    def run(df: DataFrame) -> DataFrame:
        known = mapping.select(F.col("key").alias("_asked"), F.col("value").alias("_found"))
        asked = F.coalesce(F.get(F.filter(cols(), lambda c: F.lower(c["name"]) == column.lower()), F.lit(0))["value"], F.lit(""))
        found = F.coalesce(F.col("_found"), F.lit(fallback)) if fallback else F.col("_found")
        hit = lambda c: scope(table, ci=True) & (F.lower(c["name"]) == column.lower()) & found.isNotNull()
        return (
            df.withColumn("_ask", asked)
            .join(known, F.col("_ask") == F.col("_asked"), "left")
            .withColumn(
                "columns",
                F.transform(
                    cols(),
                    lambda c: F.when(hit(c), with_value(c, found, _text_type())).otherwise(with_value(c, c["value"])),
                ),
            )
            .drop("_ask", "_asked", "_found")
        )

    return run


def chain(*stages: Stage) -> Stage:
    """Stages in order; a row dropped by one never reaches the next."""
    return lambda df: reduce(lambda d, stage: d.transform(stage), stages, df)


def pivot_columns(names: dict[str, str]) -> Stage:
    """Chosen cells as ordinary typed columns: ``{"value": "double"}``."""
    return lambda df: df.withColumns({n: first_value(n).try_cast(t) for n, t in names.items()})
