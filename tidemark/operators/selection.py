"""Row selection and numbering that depends on arrival order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import meta
from tidemark.functions.cells import cols, first_value, named, scope, shown
from tidemark.model import span_micros
from tidemark.operators.filters import Stage
from tidemark.plans.blocks import Running, count_if, running
from tidemark.plans.statescan import BucketRule, SpanRule, anchors, flag_marked, keep_marked, narrow_rows, untimed


def _positive(span, what: str) -> int:
    micros = span_micros(span)
    if micros <= 0:
        raise ValueError(f"{what} must be positive")
    return micros


def dedup_ttl(keys: Sequence[str], ttl=30, **kw) -> Stage:
    """Drop a row whose key was kept less than ``ttl`` ago; the span starts at the kept row.

    Rows without a time pass.
    """
    rule = SpanRule(_positive(ttl, "dedup_ttl: ttl"))
    return lambda df: keep_marked(df, keys, rule, **kw)


def content_hash(columns: Sequence[str] = ()):
    body = F.filter(cols(), lambda c: named(c, columns)) if columns else cols()
    text = F.array_join(F.transform(body, lambda c: F.concat(c["name"], F.lit("="), shown(c), F.lit(";"))), "")
    head = F.concat(
        F.coalesce("table_name", F.lit("")), F.lit(":"), F.coalesce("action", F.lit("")), F.lit(":")
    )
    return F.sha2(F.concat(head, F.coalesce(text, F.lit(""))), 256)


def dedup_content(ttl, columns: Sequence[str] = (), **kw) -> Stage:
    """``dedup_ttl`` on a hash of table, action and (some) column values."""
    rule = SpanRule(_positive(ttl, "dedup_content: ttl"))
    return lambda df: keep_marked(df.withColumn("_content", content_hash(columns)), ["_content"], rule, **kw).drop("_content")


def distinct_key(key_column: str, table: str | None = None) -> Stage:
    """Keep the first row per table, action and key value; rows of other tables pass."""
    if not key_column:
        raise ValueError("distinct_key: a key column is needed")

    def run(df: DataFrame) -> DataFrame:
        inside = scope(table)
        value = F.coalesce(first_value(key_column), F.lit(""))
        # Only the arrival number is aggregated, so the partial aggregate stays small.
        firsts = (
            df.filter(inside)
            .groupBy("table_name", "action", value.alias("_value"))
            .agg(F.min("seq").alias("_seq"))
            .select("_seq")
        )
        kept = df.filter(inside).join(firsts, F.col("seq") == F.col("_seq"), "left_semi")
        return kept if table is None else kept.unionByName(df.filter(~inside))

    return run


def align(**kw) -> Stage:
    """Drop a row whose lsn is behind the highest one its table had before."""

    def run(df: DataFrame) -> DataFrame:
        seen = running(df, {"_high": Running("max", F.col("lsn"), before=True)}, ["table_name"], few_keys=True, **kw)
        passes = (F.coalesce("table_name", F.lit("")) == "") | F.col("_high").isNull() | (F.col("lsn") >= F.col("_high"))
        return seen.filter(passes).drop("_high")

    return run


def last_lsn() -> Stage:
    return lambda df: df.filter(F.col("table_name") != "").groupBy("table_name").agg(F.max("lsn").alias("last_lsn"))


def reorder(buffer: int = 64, field: str = "lsn", **kw) -> Stage:
    """Sort each run of ``buffer`` arrivals by a numeric meta field; adds ``chunk`` and ``out_pos``."""
    if buffer <= 0:
        raise ValueError("reorder: the buffer must be greater than zero")
    if not field:
        raise ValueError("reorder: a field is needed")

    def run(df: DataFrame) -> DataFrame:
        numbered = running(df, {"_n": count_if()}, **kw)
        chunk = F.floor((F.col("_n") - 1) / F.lit(buffer)).cast("bigint")
        rank = F.coalesce(F.expr(f"try_cast(meta['{field}'] AS bigint)"), F.lit(0))
        inside = Window.partitionBy("chunk").orderBy("_rank", "seq")
        return (
            numbered.withColumns({"chunk": chunk, "_rank": rank})
            .withColumn("out_pos", F.row_number().over(inside).cast("bigint"))
            .drop("_n", "_rank")
        )

    return run


def sequence(start: int = 0, table: str | None = None, field: str = "seq", **kw) -> Stage:
    """Stamp rows in scope with start + 1, start + 2, … in arrival order."""

    def run(df: DataFrame) -> DataFrame:
        inside = scope(table)
        numbered = running(df, {"_n": count_if(inside)}, **kw)
        stamped = meta.put(field, (F.col("_n") + start).cast("string"), inside)
        return numbered.withColumn("meta", stamped).drop("_n")

    return run


def batch_assign(max_size: int = 100, **kw) -> Stage:
    """Add ``batch``: the number of the full batch of ``max_size`` arrivals a row falls in."""
    if max_size <= 0:
        max_size = 100

    def run(df: DataFrame) -> DataFrame:
        numbered = running(df, {"_n": count_if()}, **kw)
        return numbered.withColumn("batch", F.floor((F.col("_n") - 1) / F.lit(max_size)).cast("bigint")).drop("_n")

    return run


def burst_spans(window, max_delay) -> tuple[int, int]:
    """Quiet span and longest delay in microseconds; spans that are not positive take the defaults."""
    quiet = span_micros(window) if span_micros(window) > 0 else span_micros(0.2)
    return quiet, span_micros(max_delay) if span_micros(max_delay) > 0 else span_micros(2)


def bursts(narrow: DataFrame, quiet: int, longest: int) -> DataFrame:
    """The bursts of ``narrow_rows``: ``_k`` and first row (``start``), last row (``_last``) and its time (``_to``), the first
    row's time (``anchor``) and ``burst_rows``.

    A row with ``_inside`` goes on with the burst before it, however long ago the row before was.
    """
    seen = running(narrow, {"_prev": Running("last", F.col("at"), before=True)}, ["_k"])
    cut = F.col("_prev").isNull() | (F.col("at") - F.col("_prev") >= quiet)
    if "_inside" in narrow.columns:
        cut = cut & ~F.coalesce("_inside", F.lit(False))
    rows = anchors(seen, SpanRule(longest), reset=cut)
    # A burst is named by its first row, as times may come again; a block of a hot key may begin inside a burst.
    parts = rows.groupBy("_k", "_b", "start").agg(
        F.max("seq").alias("_last"), F.count(F.lit(1)).alias("n"), F.max_by("at", "seq").alias("_to"), F.max("anchor").alias("anchor")
    )
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    open_ = (
        parts.filter("_b IS NOT NULL").groupBy("_k", "_b").agg(F.max("start").alias("_open"))
        .select(F.col("_k").alias("_ok"), F.col("_b").alias("_ob"), F.last("_open", ignorenulls=True).over(earlier).alias("_open"))
    )
    return (
        parts.join(open_, F.col("start").isNull() & (F.col("_k") == F.col("_ok")) & (F.col("_b") == F.col("_ob")), "left")
        .groupBy("_k", F.coalesce("start", "_open").alias("start"))
        .agg(
            F.max_by("_to", "_last").alias("_to"), F.max("_last").alias("_last"),
            F.sum("n").alias("burst_rows"), F.max("anchor").alias("anchor"),
        )
    )


def debounce(keys: Sequence[str], window=0.2, max_delay=2, **kw) -> Stage:
    """One row per burst: the latest, after ``window`` of quiet or ``max_delay`` after the first.

    Adds ``emit_ts`` and ``burst_rows``. A gap equal to the window ends a burst. A row without a time is a
    burst of its own, with no ``emit_ts``.
    """
    quiet, longest = burst_spans(window, max_delay)

    def run(df: DataFrame) -> DataFrame:
        # Whole rows only travel to the last join; the burst plan works on narrow ones.
        ends = bursts(narrow_rows(df, keys, **kw), quiet, longest)
        emit = F.timestamp_micros(F.least(F.col("_to") + quiet, F.col("anchor") + longest))
        alone = untimed(df).select("_seq", F.lit(None).cast("timestamp"), F.lit(1).cast("bigint"))
        last = ends.select("_last", emit.alias("emit_ts"), "burst_rows").union(alone)
        return df.join(last, F.col("seq") == F.col("_last")).drop("_last")

    return run


def sample_max_per_second(limit: int, keys: Sequence[str] = (), second=1, **kw) -> Stage:
    """Pass the first ``limit`` rows of each window; a window opens at the first row that
    arrives at least ``second`` after the last one opened. Rows without a time pass."""
    if limit <= 0:
        return lambda df: df
    rule = SpanRule(_positive(second, "sample_max_per_second: window"))

    def run(df: DataFrame) -> DataFrame:
        # At most ``limit`` rows of a window come out of each block; the rank among those
        # decides, since a block that held more already fills the window.
        first = anchors(narrow_rows(df, keys, **kw), rule, limit=limit)
        rank = F.row_number().over(Window.partitionBy("_k", "anchor").orderBy("seq"))
        hits = first.withColumn("_rank", rank).filter(F.col("_rank") <= limit).select(F.col("seq").alias("_seq"))
        hits = hits.union(untimed(df))
        return df.join(hits, F.col("seq") == F.col("_seq"), "left_semi")

    return run


def bucket_rule(tokens: int, per, burst: int | None = None) -> BucketRule:
    """``tokens`` come in per span ``per``; ``burst`` tokens fit (default: one span's worth)."""
    from math import gcd

    span = _positive(per, "token_bucket: span")
    burst = tokens if burst is None else burst
    if tokens <= 0 or burst <= 0:
        raise ValueError("token_bucket: rate and burst must be positive")
    shared = gcd(tokens, span)
    return BucketRule(tokens // shared, span // shared, span // shared * burst)


BUCKET_BLOCK = 1 << 14  # rows of a hot key that one task summarises for a token bucket
WIDE = 1 << 61  # numbers of a token bucket stay below, so that sums of two fit in 64 bits
YEAR_2200 = 7_258_118_400_000_000


def token_bucket(tokens: int, per=1, burst: int | None = None, keys: Sequence[str] = (), **kw) -> Stage:
    """Add ``admitted``: whether a full token was there when the row arrived. Rows without a time are admitted.

    Time counts in units of the rate. Where that leaves 64 bits for times since 1970, it counts from the
    log's first time, which is looked up once. Summarising a block costs more than for a plain span, so hot keys get
    smaller blocks.
    """
    rule = bucket_rule(tokens, per, burst)
    kw = {"block": BUCKET_BLOCK, **kw}

    def run(df: DataFrame) -> DataFrame:
        timed = df
        if YEAR_2200 * rule.refill + rule.room >= WIDE:
            ends = df.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).select(F.unix_micros("low"), F.unix_micros("high"))
            low, high = ends.first()
            if low is not None and (high - low) * rule.refill + rule.room >= WIDE:
                raise ValueError("token_bucket: the rate and the log's span need more than 64 bits")
            timed = df.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") - (low or 0)))
        flagged = flag_marked(timed, keys, rule, "admitted", **kw)
        return flagged if timed is df else flagged.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + (low or 0)))

    return run
