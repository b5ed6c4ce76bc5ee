"""Writing to the ``meta`` map without relying on the session's duplicate-key policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.model import META


def current() -> Column:
    return F.coalesce(F.col("meta"), F.create_map().cast(META))


def _without(base: Column, keys: Column) -> Column:
    return F.map_filter(base, lambda k, _v: ~F.array_contains(keys, k))


def overlay(base: Column, extra: Column) -> Column:
    """``base`` with the entries of ``extra`` on top."""
    return F.map_concat(_without(base, F.map_keys(extra)), extra)


def literal(pairs: dict[str, str]) -> Column:
    flat = [F.lit(x) for kv in pairs.items() for x in kv]
    return (F.create_map(*flat) if flat else F.create_map()).cast(META)


def put(key: str, value: Column, when: Column | None = None, base: Column | None = None) -> Column:
    """Set one key; where ``when`` is not true or the value is null the map stays as it is."""
    base = current() if base is None else base
    cond = value.isNotNull() if when is None else F.coalesce(when, F.lit(False)) & value.isNotNull()
    kept = F.map_filter(base, lambda k, _v: k != key)
    return F.when(cond, F.map_concat(kept, F.create_map(F.lit(key), value.cast("string")))).otherwise(base)


def put_rules(rules: list[tuple[Column, str, Column]], base: Column | None = None) -> Column:
    """Apply (condition, key, value) rules; for one key the last rule that holds wins."""
    keys: dict[str, list[tuple[Column, Column]]] = {}
    for cond, key, value in rules:
        keys.setdefault(key, []).append((cond, value))
    out = current() if base is None else base
    for key, options in keys.items():
        chosen = F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), v) for c, v in reversed(options)])
        out = put(key, chosen, base=out)
    return out
