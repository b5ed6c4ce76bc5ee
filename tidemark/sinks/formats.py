"""Row formats as string columns, in a registry that users can extend."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import TYPED, cols, shown
from tidemark.functions.text import json_number
from tidemark.functions import meta
from tidemark.operators.filters import Stage
from tidemark.operators.stamping import row_id


def rfc3339(ts: Column | str, fraction: bool = False) -> Column:
    """UTC time text; a fraction is printed without trailing zeros, as needed."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    if not fraction:
        return F.concat(whole, F.lit("Z"))
    return F.concat(whole, F.regexp_replace(F.date_format(ts, ".SSSSSS"), r"\.?0+$", ""), F.lit("Z"))


def quoted(value: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")


def lsn_text(lsn: Column) -> Column:
    """``hi/lo`` form of a log position."""
    return F.concat(F.hex(F.shiftright(lsn, 32)), F.lit("/"), F.hex(lsn.bitwiseAND(0xFFFFFFFF)))


_KEEP_NULLS = {"ignoreNullFields": "false"}


def _bare(c: Column) -> Column:
    """A cast value as JSON writes it, without quotes."""
    real = F.when(c["type"] == "float", json_number(c["value"].try_cast("double")))
    return F.coalesce(real, c["value"])


def _cell_json(c: Column) -> Column:
    plain = F.when(c["type"].isin(*TYPED), _bare(c))
    value = F.coalesce(plain, F.when(c["value"].isNull(), F.lit("null")).otherwise(quoted(c["value"])))
    return F.concat(
        F.lit('{"name":'), quoted(c["name"]), F.lit(',"type":'), quoted(F.coalesce(c["type"], F.lit(""))),
        F.lit(',"value":'), value, F.lit("}"),
    )


def _cells_json(cells: Column) -> Column:
    """JSON of the cells: text in quotes, cast numbers and booleans bare, absent values null."""
    tagged = F.concat(F.lit("["), F.array_join(F.transform(cells, _cell_json), ","), F.lit("]"))
    text = F.to_json(
        F.transform(
            cells,
            lambda c: F.struct(
                c["name"].alias("name"), F.coalesce(c["type"], F.lit("")).alias("type"), c["value"].alias("value")
            ),
        ),
        _KEEP_NULLS,
    )
    # Without type tags the whole array goes through one to_json.
    some_tag = F.exists(cells, lambda c: F.coalesce(c["type"], F.lit("")).isin(*TYPED))
    return F.when(some_tag, tagged).otherwise(text)


def json_line() -> Column:
    """Compact JSON; empty arrays are left out, absent values are written as null."""
    head = F.to_json(
        F.struct(
            lsn_text(F.col("lsn")).alias("lsn"),
            rfc3339("ts", fraction=True).alias("timestamp"),
            F.col("action").alias("action"),
            F.coalesce("schema_name", F.lit("")).alias("schema"),
            F.coalesce("table_name", F.lit("")).alias("table"),
        ),
        _KEEP_NULLS,
    )

    def part(name: str, cells: Column) -> Column:
        body = F.concat(F.lit(f',"{name}":'), _cells_json(cells))
        return F.when(F.size(F.coalesce(cells, F.array())) > 0, body).otherwise(F.lit(""))

    return F.concat(
        F.regexp_replace(head, r"\}$", ""), part("columns", cols()), part("old_keys", F.col("old_keys")), F.lit("}")
    )


def text_line() -> Column:
    """``ACTION schema.table name=value …``"""
    pairs = F.transform(cols(), lambda c: F.concat(c["name"], F.lit("="), shown(c)))
    return F.concat(
        F.col("action"), F.lit(" "), F.coalesce("schema_name", F.lit("")), F.lit("."),
        F.coalesce("table_name", F.lit("")), F.lit(" "), F.coalesce(F.array_join(pairs, " "), F.lit("")),
    )


def pretty_text() -> Column:
    """The JSON over several lines, two spaces per level."""
    pad = lambda n: F.lit("\n" + "  " * n)

    def field(name: str, value: Column) -> Column:
        return F.concat(pad(1), F.lit(f'"{name}": '), value)

    def cell(c: Column) -> Column:
        bare = c["type"].isin(*TYPED) & c["value"].isNotNull()
        value = F.when(F.coalesce(bare, F.lit(False)), _bare(c)).when(c["value"].isNull(), F.lit("null"))
        return F.concat(
            pad(2), F.lit("{"),
            pad(3), F.lit('"name": '), quoted(c["name"]), F.lit(","),
            pad(3), F.lit('"type": '), quoted(F.coalesce(c["type"], F.lit(""))), F.lit(","),
            pad(3), F.lit('"value": '), F.coalesce(value, quoted(c["value"])),
            pad(2), F.lit("}"),
        )

    def part(name: str, cells: Column) -> Column:
        body = F.concat(field(name, F.lit("[")), F.array_join(F.transform(cells, cell), ","), pad(1), F.lit("]"))
        return F.when(F.size(F.coalesce(cells, F.array())) > 0, body)

    fields = F.array(
        field("lsn", quoted(lsn_text(F.col("lsn")))),
        field("timestamp", quoted(rfc3339("ts", fraction=True))),
        field("action", quoted(F.col("action"))),
        field("schema", quoted(F.coalesce("schema_name", F.lit("")))),
        field("table", quoted(F.coalesce("table_name", F.lit("")))),
        part("columns", cols()),
        part("old_keys", F.col("old_keys")),
    )
    return F.concat(F.lit("{"), F.array_join(fields, ","), F.lit("\n}"))


def csv_line() -> Column:
    """lsn, timestamp, action, schema, table and the columns as JSON."""
    return F.to_csv(
        F.struct(
            lsn_text(F.col("lsn")).alias("lsn"), rfc3339("ts", fraction=True).alias("timestamp"),
            F.col("action"), F.col("schema_name"), F.col("table_name"), _cells_json(cols()).alias("columns"),
        )
    )


FORMATTERS: dict[str, Callable[[], Column]] = {
    "json": json_line, "text": text_line, "pretty": pretty_text, "csv": csv_line,
}


def register_format(name: str, build: Callable[[], Column]) -> None:
    """Add a format: a function that gives the line as a string Column."""
    FORMATTERS[name] = build


def formatted(name: str = "json", into: str = "line") -> Stage:
    if name not in FORMATTERS:
        raise ValueError(f"unknown format {name!r}: must be one of {', '.join(sorted(FORMATTERS))}")
    return lambda df: df.withColumn(into, FORMATTERS[name]())


def envelope(source: str = "tidemark", payload: str = "line", into: str = "envelope") -> Stage:
    """Wrap a formatted line: id, time, source, payload and (if there is any) meta."""

    def run(df: DataFrame) -> DataFrame:
        base = [
            row_id().alias("id"), rfc3339("ts", fraction=True).alias("timestamp"),
            F.lit(source).alias("source"), F.col(payload).alias("payload"),
        ]
        plain = F.to_json(F.struct(*base))
        whole = F.to_json(F.struct(*base, meta.current().alias("meta")))
        return df.withColumn(into, F.when(F.size(meta.current()) > 0, whole).otherwise(plain))

    return run


def envelope_text(source: str = "tidemark", payload: str = "line") -> Column:
    return F.concat(
        F.lit("["), row_id(), F.lit(f"] {source} @ "), rfc3339("ts"), F.lit(": "), F.col(payload)
    )


def journal() -> Stage:
    """Journal entries with their line."""
    line = F.concat_ws(
        "\t", rfc3339("ts", fraction=True), "table_name", "action", F.concat(F.lit("lsn="), F.col("lsn").cast("string"))
    )
    return lambda df: df.select("seq", "ts", "table_name", "action", "lsn", "meta", line.alias("line"))


def audit(tables=(), actions=()) -> Stage:
    """Audit lines of rows whose table and action are both listed; an empty list accepts all."""
    keep = F.lit(True)
    if tables:
        keep = keep & F.col("table_name").isin(*tables)
    if actions:
        keep = keep & F.col("action").isin(*actions)
    line = F.concat(
        F.lit("time="), rfc3339("ts"), F.lit(" table="), F.col("table_name"), F.lit(" action="), F.col("action"),
        F.lit(" lsn="), lsn_text(F.col("lsn")),
    )
    return lambda df: df.filter(keep).select("seq", line.alias("line"))


def observe_line(prefix: str = "") -> Column:
    lead = prefix + " " if prefix else ""
    return F.concat(
        F.lit(lead), rfc3339("ts"), F.lit(" action="), F.col("action"), F.lit(" table="), F.col("table_name"),
        F.lit(" lsn="), F.col("lsn").cast("string"), F.lit(" columns="),
        F.size(F.coalesce(cols(), F.array())).cast("string"),
    )
