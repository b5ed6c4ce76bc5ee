"""Stateless filters and predicates, and the filters that follow a control table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.cells import byte_size, first_match, scope, stub
from tidemark.functions.hashing import unit_interval
from tidemark.model import DATA_ACTIONS, instant, span_micros
from tidemark.plans.blocks import count_if, running
from tidemark.plans.intervals import during

Stage = Callable[[DataFrame], DataFrame]


def _in(column: str, values: Sequence[str], ci: bool = False) -> Column:
    if not values:
        return F.lit(False)
    target = F.lower(column) if ci else F.col(column)
    return F.coalesce(target.isin(*[v.lower() if ci else v for v in values]), F.lit(False))


def qualified_name() -> Column:
    return F.concat_ws(".", "schema_name", "table_name")


def allow(tables: Sequence[str] = (), actions: Sequence[str] = (), schemas: Sequence[str] = ()) -> Stage:
    """Keep rows whose ``schema.table``, schema and action are listed; an empty list accepts all."""
    keep = F.lit(True)
    if tables:
        # The name test alone would hide table_name from the scan's filter, so both are given.
        keep = keep & F.col("table_name").isin(*sorted({t.split(".", 1)[-1] for t in tables}))
        keep = keep & qualified_name().isin(*tables)
    if schemas:
        keep = keep & F.col("schema_name").isin(*schemas)
    if actions:
        keep = keep & F.col("action").isin(*actions)
    return lambda df: df.filter(keep)


def skip(tables: Sequence[str] = (), actions: Sequence[str] = ()) -> Stage:
    """Drop rows whose table or action is listed, in any case."""
    if not tables and not actions:
        raise ValueError("skip: a table or an action is needed")
    return lambda df: df.filter(~(_in("table_name", tables, True) | _in("action", actions, True)))


def drop_action(*actions: str) -> Stage:
    return lambda df: df.filter(~_in("action", actions, True))


def data_changes() -> Stage:
    return lambda df: df.filter(F.col("action").isin(*DATA_ACTIONS))


def expire(ttl, as_of=None, table: str | None = None) -> Stage:
    """Drop rows older than ``ttl`` at ``as_of``; equal age and unknown event time stay."""
    micros = span_micros(ttl)
    if micros <= 0:
        raise ValueError("expire: ttl must be positive")
    oldest = instant(as_of) - F.make_dt_interval(secs=F.lit(micros / 1e6).cast("decimal(18,6)"))
    return lambda df: df.filter(~scope(table) | F.col("wal_ts").isNull() | (F.col("wal_ts") >= oldest))


def size_limit(max_bytes: int = 1 << 20, keep_stub: bool = False) -> Stage:
    """Drop rows over the byte limit, or keep them with one column that tells their size."""
    if max_bytes <= 0:
        raise ValueError("size_limit: the limit must be positive")
    if not keep_stub:
        return lambda df: df.filter(byte_size() <= max_bytes)
    note = stub("_truncated", F.concat(F.lit("original_bytes="), byte_size().cast("string")))
    return lambda df: df.withColumn("columns", F.when(byte_size() > max_bytes, note).otherwise(F.col("columns")))


def cap(limit: int, table: str | None = None, action: str | None = None, keys: Sequence[str] = (), **kw) -> Stage:
    """Pass the first ``limit`` rows in scope (per key, if keys are given) and all rows out of scope."""
    if limit <= 0:
        raise ValueError("cap: the limit must be greater than zero")
    inside = scope(table, action)

    def run(df: DataFrame) -> DataFrame:
        numbered = running(df, {"_n": count_if(inside)}, keys, **kw)
        return numbered.filter(~inside | (F.col("_n") <= limit)).drop("_n")

    return run


def cap_remaining(limit: int, table: str | None = None, action: str | None = None) -> Stage:
    """How many more rows the cap would pass."""
    return lambda df: df.agg(
        F.greatest(F.lit(limit) - F.count_if(scope(table, action)), F.lit(0)).cast("bigint").alias("remaining")
    )


def sample_rate(rate: float, salt: str = "", key: str = "seq") -> Stage:
    """Keep a repeatable share of the rows; the rate is clamped to [0, 1]."""
    share = min(max(rate, 0.0), 1.0)
    if share >= 1.0:
        return lambda df: df
    return lambda df: df.filter(unit_interval(F.col(key), salt) < F.lit(share))


def gate(control: DataFrame, initially_open: bool = True, **kw) -> Stage:
    """Drop rows that arrive while the switch is closed. ``control``: ``ts``, ``on``. Works on streams as well.

    Rows without a time meet the switch as it is ``initially``.
    """
    history = control.select("ts", F.struct("on").alias("_switch"))

    def run(df: DataFrame) -> DataFrame:
        seen = during(df, history, "_switch", **kw)
        return seen.filter(F.coalesce(F.col("_switch.on"), F.lit(initially_open))).drop("_switch")

    return run


def hold_release(control: DataFrame, max_buffer: int, **kw) -> Stage:
    """Hold rows while frozen, keep the newest ``max_buffer`` of a freeze, release them at its end.

    ``control``: ``ts``, ``on`` (frozen), one entry per instant. Adds ``release_ts``: the own
    time of a row that was not held, the thaw time of a held one, null while the freeze has
    not ended.
    """
    if max_buffer <= 0:
        raise ValueError("hold_release: the buffer must hold at least one row")
    entries = control.select("ts", F.struct("on", "ts").alias("_hold"))
    thaw = F.when(~F.col("_value.on"), F.col("_value.ts"))

    def run(df: DataFrame) -> DataFrame:
        seen = during(df, entries, "_hold", following={"thaw": thaw}, **kw)
        frozen = F.coalesce(F.col("_hold.on"), F.lit(False))
        # All rows of a freeze share its thaw time; only they are ranked.
        release = F.when(frozen, F.col("_hold.thaw")).otherwise(F.col("ts"))
        placed = seen.withColumns({"release_ts": release, "_held": frozen})
        held = newest(placed.filter("_held"), ["release_ts"], max_buffer)
        return held.unionByName(placed.filter("NOT _held")).drop("_hold", "_held")

    return run


def newest(df: DataFrame, keys: Sequence[str], n: int, order: str = "seq") -> DataFrame:
    """The last ``n`` rows per key. Up to 1000, Spark cuts every task's rows to the last ``n``
    per key before the shuffle; beyond that the rows are ranked in blocks."""
    if n <= 1000:
        last = Window.partitionBy(*keys).orderBy(F.desc(order))
        return df.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= n).drop("_rank")
    ranked = running(df, {"_rank": count_if()}, keys, order=order, descending=True)
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def pin_or(keep: Column, pinned: Sequence[str] = (), key: Column | None = None, pins: DataFrame | None = None) -> Stage:
    """Rows with a pinned key pass, the others must satisfy ``keep``.

    A long list of pins is given as a DataFrame with the column ``key``.
    """
    key = F.col("table_name") if key is None else key
    passes = F.coalesce(keep, F.lit(False))
    if pins is None:
        listed = F.coalesce(key.isin(*pinned), F.lit(False)) if pinned else F.lit(False)
        return lambda df: df.filter(listed | passes)
    known = pins.select(F.col("key").alias("_pin")).distinct()
    return lambda df: (
        df.withColumn("_key", key)
        .join(known, F.col("_key") == F.col("_pin"), "left")
        .filter(F.col("_pin").isNotNull() | passes)
        .drop("_key", "_pin")
    )


@dataclass(frozen=True)
class Check:
    """A validation rule: ``ok`` must hold, else ``message`` is the complaint."""

    name: str
    ok: Column
    message: Column

    def complaint(self) -> Column:
        text = F.concat(F.lit(f'validation rule "{self.name}" failed: '), self.message)
        return F.when(~F.coalesce(self.ok, F.lit(False)), text)


def require_table() -> Check:
    ok = F.coalesce(F.col("table_name"), F.lit("")) != ""
    return Check("require_table", ok, F.lit("table name must not be empty"))


def require_action(*allowed: str) -> Check:
    text = F.concat(
        F.lit('action "'), F.coalesce(F.col("action"), F.lit("")),
        F.lit('" is not in allowed set [' + " ".join(allowed) + "]"),
    )
    return Check("require_action", F.col("action").isin(*allowed), text)


def validate(*checks: Check) -> Stage:
    """Add ``error``: the complaint of the first failing rule, null for a valid row."""
    if not checks:
        raise ValueError("validate: at least one rule is required")
    return lambda df: df.withColumn("error", F.coalesce(*[c.complaint() for c in checks]))


@dataclass(frozen=True)
class RejectRule:
    reason: str
    table: str = ""
    action: str = ""


def reject(*rules: RejectRule) -> Stage:
    """Add ``rejection``: the text of the first matching rule, null for an accepted row."""
    if not rules:
        raise ValueError("reject: at least one rule is required")
    if any(not r.reason for r in rules):
        raise ValueError("reject: every rule needs a reason")
    text = first_match([(scope(r.table, r.action), f"rejecter: message rejected: {r.reason}") for r in rules])
    return lambda df: df.withColumn("rejection", text)


def split_errors(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows without an error (column dropped) and rows with one."""
    return df.filter(F.col(column).isNull()).drop(column), df.filter(F.col(column).isNotNull())


def quorum(policy: str, *voters: Column) -> Column:
    """Whether enough voters agree: ``all``, ``majority`` (more than half) or ``any``."""
    if not voters:
        raise ValueError("quorum: at least one voter is required")
    ayes = sum((F.coalesce(v, F.lit(False)).cast("int") for v in voters), start=F.lit(0))
    if policy == "all":
        return ayes == len(voters)
    if policy == "majority":
        return ayes > len(voters) // 2
    if policy == "any":
        return ayes >= 1
    raise ValueError(f"quorum: unknown policy {policy!r}")
