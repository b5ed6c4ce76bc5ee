"""Helpers over the ``columns`` array of a change row (``name``, ``type``, ``value`` cells)."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import CELLS

# Fixed value: how an absent value prints.
NIL = "<nil>"
# Type tags a value can carry after a cast; anything else is text.
TYPED = ("int", "float", "bool")


def cols() -> Column:
    return F.col("columns")


def is_text(c: Column) -> Column:
    return c["value"].isNotNull() & ~F.coalesce(c["type"], F.lit("")).isin(*TYPED)


def shown(c: Column) -> Column:
    return F.coalesce(c["value"], F.lit(NIL))


def with_value(c: Column, value: Column, type_: Column | None = None) -> Column:
    return F.struct(
        c["name"].alias("name"),
        (c["type"] if type_ is None else type_).alias("type"),
        value.alias("value"),
    )


def map_values(fn: Callable[[Column], Column], over: Column | None = None) -> Column:
    """Rewrite the value of every cell; ``fn`` gets the cell and returns the new value."""
    return F.transform(cols() if over is None else over, lambda c: with_value(c, fn(c)))


def named(c: Column, names: Iterable[str], ci: bool = False) -> Column:
    names = [n.lower() if ci else n for n in names]
    target = F.lower(c["name"]) if ci else c["name"]
    return target.isin(*names) if names else F.lit(False)


def first_cell(name: str, over: Column | None = None) -> Column:
    return F.get(F.filter(cols() if over is None else over, lambda c: c["name"] == name), F.lit(0))


def first_value(name: str, over: Column | None = None) -> Column:
    return first_cell(name, over)["value"]


def last_value_ci(name: str, over: Column | None = None) -> Column:
    """Value of the last cell of that name (any case) that has one."""
    hits = F.filter(cols() if over is None else over, lambda c: (F.lower(c["name"]) == name.lower()) & c["value"].isNotNull())
    return F.try_element_at(hits, F.lit(-1))["value"]


def last_by_name(over: Column | None = None) -> Column:
    """Map view of the cells: one cell per name, the last one.

    Where no name repeats, as in nearly all rows, the cells are that already.
    """
    over = cols() if over is None else over
    at = F.transform(over, lambda c, i: F.struct(c.alias("cell"), i.alias("i")))
    latest = F.transform(
        F.filter(
            at,
            lambda p: ~F.exists(at, lambda q: (q["cell"]["name"] == p["cell"]["name"]) & (q["i"] > p["i"])),
        ),
        lambda p: p["cell"],
    )
    names = F.transform(over, lambda c: c["name"])
    return F.when(F.size(F.array_distinct(names)) == F.size(names), over).otherwise(latest)


def matches(column: str, wanted: str | None, ci: bool = False) -> Column:
    """Scope test where an empty value accepts everything."""
    if not wanted:
        return F.lit(True)
    return F.lower(column) == wanted.lower() if ci else F.col(column) == wanted


def scope(table: str | None = None, action: str | None = None, ci: bool = False) -> Column:
    return F.coalesce(matches("table_name", table, ci) & matches("action", action, ci), F.lit(False))


def first_match(rules: Iterable[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule whose condition holds."""
    out = [F.when(cond, value if isinstance(value, Column) else F.lit(value)) for cond, value in rules]
    if default is not None:
        out.append(default if isinstance(default, Column) else F.lit(default))
    return F.coalesce(*out) if out else F.lit(None)


def joined(sep: str = ";", over: Column | None = None) -> Column:
    """``name=value`` text of the cells in column order."""
    over = cols() if over is None else over
    return F.array_join(F.transform(over, lambda c: F.concat(c["name"], F.lit("="), shown(c))), sep)


def stub(name: str, value: Column) -> Column:
    return F.array(
        F.struct(F.lit(name).alias("name"), F.lit(None).cast("string").alias("type"), value.alias("value"))
    ).cast(CELLS)


def byte_size() -> Column:
    """Estimated size of a row in bytes: identifiers, names and text, 8 for anything not text."""
    ident = sum(
        (F.coalesce(F.octet_length(c), F.lit(0)) for c in ("table_name", "schema_name", "action")),
        start=F.lit(0),
    )
    body = F.aggregate(
        F.coalesce(cols(), F.array().cast(CELLS)),
        F.lit(0),
        lambda acc, c: acc
        + F.coalesce(F.octet_length(c["name"]), F.lit(0))
        + F.when(is_text(c), F.octet_length(c["value"])).otherwise(F.lit(8)),
    )
    return (ident + body).cast("bigint")
