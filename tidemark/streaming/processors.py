"""Stateful operators for streams. State per key is a number or two (debounce: one row).

A processor gets the rows of one key in one micro-batch in no promised order and sorts them
by arrival; across micro-batches the order is the source's. The TTL, rate and burst rules are
the step functions of the batch plans, so both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import meta
from tidemark.functions.cells import scope
from tidemark.model import span_micros
from tidemark.operators.progress import fingerprint
from tidemark.operators.selection import bucket_rule
from tidemark.operators.filters import Stage
from tidemark.plans.statescan import NONE, BucketRule, SpanRule
from tidemark.streaming.runner import use_rocksdb

_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


_FIELDS = ["_seq", "_at", "_num", "_text", "_row"]


def _long(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names])


class _Sorted(StatefulProcessor):
    """Rows of a key as (seq, at, amount, text, payload) tuples in arrival order."""

    state_schema = _long("state")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.state_schema)

    def read(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        # Columns are taken by place: Spark may hand them over under other names.
        frame = pd.concat([part.iloc[:, 1:6].set_axis(_FIELDS, axis=1) for part in rows])
        frame = frame.sort_values("_seq")
        return list(zip(*[frame[f].tolist() for f in _FIELDS]))

    def close(self) -> None:
        pass


def _out(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=["_row", "_flag", "_n"])


class RuleProcessor(_Sorted):
    """TTL and token bucket: flags the rows that the rule marks.

    With a watermark a timer drops the state once it cannot matter any more.
    """

    def __init__(self, rule: SpanRule | BucketRule, timers: bool = False):
        self.rule, self.timers = rule, timers

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        state = held[0] if held else NONE
        out = []
        for _, at, _, _, row in self.read(rows):
            state, hit = self.rule.step(state, int(at), False)
            out.append((row, hit, 0))
        self.state.update((state,))
        if self.timers:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            per_micro = self.rule.refill if isinstance(self.rule, BucketRule) else 1
            self.handle.registerTimer(state // per_micro // 1000 + 1)
        yield from _out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.state.clear()
        return iter([])


class WindowProcessor(_Sorted):
    """The first ``limit`` rows of each window that opens at a row ``span`` after the last."""

    state_schema = _long("next", "count")

    def __init__(self, rule: SpanRule, limit: int):
        self.rule, self.limit = rule, limit

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        state, count = (held[0], held[1]) if held else (NONE, 0)
        out = []
        for _, at, _, _, row in self.read(rows):
            state, opened = self.rule.step(state, int(at), False)
            count = 1 if opened else count + 1
            out.append((row, count <= self.limit, count))
        self.state.update((state, count))
        yield from _out(out)


class HighProcessor(_Sorted):
    """Flags rows that are not behind the highest number seen. A row without a number (text ``null``) is
    flagged while there is none."""

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        high = held[0] if held else None
        out = []
        for _, _, num, missing, row in self.read(rows):
            out.append((row, high is None or (missing != "null" and num >= high), 0))
            if missing != "null":
                high = int(num) if high is None else max(high, int(num))
        if high is not None:
            self.state.update((high,))
        yield from _out(out)


class CountProcessor(_Sorted):
    """Numbers the rows whose ``_num`` is 1; others get the count so far."""

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        n = held[0] if held else 0
        out = []
        for _, _, num, _, row in self.read(rows):
            n += int(num)
            out.append((row, bool(num), n))
        self.state.update((n,))
        yield from _out(out)


class ChangeProcessor(_Sorted):
    """Counts the changes of a text."""

    state_schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        last, n = (held[0], held[1]) if held else (None, 0)
        out = []
        for _, _, _, text, row in self.read(rows):
            changed = last is None or text != last
            n += changed
            last = text
            out.append((row, changed, n))
        self.state.update((last, n))
        yield from _out(out)


class BurstProcessor(_Sorted):
    """Debounce: holds the newest row of a burst until the quiet span or the delay is over."""

    state_schema = T.StructType(
        [T.StructField(n, T.LongType()) for n in ("first", "last", "rows")] + [T.StructField("row", T.StringType())]
    )

    def __init__(self, quiet: int, longest: int):
        self.quiet, self.longest = quiet, longest

    def due(self, first: int, last: int) -> int:
        return min(last + self.quiet, first + self.longest)

    def handleInputRows(self, key, rows, timerValues):
        burst = self.state.get()
        out = []
        for _, at, _, _, row in self.read(rows):
            at = int(at)
            if burst and at >= self.due(burst[0], burst[1]):
                out.append((burst[3], True, self.due(burst[0], burst[1]), burst[2]))
                burst = None
            burst = (burst[0], at, burst[2] + 1, row) if burst else (at, at, 1, row)
        self.state.update(burst)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-self.due(burst[0], burst[1]) // 1000))
        yield from self.emitted(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        burst = self.state.get()
        if burst:
            self.state.clear()
            yield from self.emitted([(burst[3], True, self.due(burst[0], burst[1]), burst[2])])

    @staticmethod
    def emitted(rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["_row", "_flag", "_n", "_rows"])


_RESULT = "_row string, _flag boolean, _n bigint"


def _stateful(
    df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, num: Column | None = None,
    text: Column | None = None, time_mode: str = "None", schema: str = _RESULT,
) -> DataFrame:
    """Run a processor. Whole rows pass through it as one JSON text and come back typed.

    The numbers that a processor gets are never null, as pandas would turn a column with nulls into floats.
    """
    use_rocksdb(df.sparkSession)
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    at = F.coalesce(F.unix_micros("ts"), F.lit(0)) if "ts" in df.columns else F.lit(0).cast("bigint")
    picked = df.select(
        key.alias("_k"), F.col("seq").alias("_seq"), at.alias("_at"),
        F.coalesce((F.lit(0) if num is None else num).cast("bigint"), F.lit(0)).alias("_num"),
        (F.lit(None) if text is None else text).cast("string").alias("_text"),
        F.to_json(F.struct(*df.columns), {**_TIMES, "ignoreNullFields": "false"}).alias("_row"),
        *([F.col("ts").alias("_event_time")] if time_mode == "EventTime" else []),
    )
    done = picked.groupBy("_k").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="append", timeMode=time_mode
    )
    row = F.from_json("_row", df.schema, _TIMES)
    rest = [c for c in done.columns if c != "_row"]
    return done.select(row.alias("_r"), *rest).select("_r.*", *rest)


def _timed(rule: Stage, **given: Column) -> Stage:
    """``rule`` for rows with a time; the others take no part in it and pass, with the columns ``given``."""
    return lambda df: rule(df.filter("ts IS NOT NULL")).unionByName(df.filter("ts IS NULL").withColumns(given))


def dedup_ttl(keys: Sequence[str], ttl, late: str | None = None) -> Stage:
    """Streaming ``dedup_ttl``. ``late`` sets a watermark, with which old state is dropped."""
    rule = SpanRule(span_micros(ttl))

    def run(df: DataFrame) -> DataFrame:
        timed = df.withWatermark("ts", late) if late else df
        mode = "EventTime" if late else "None"
        return _stateful(timed, keys, RuleProcessor(rule, bool(late)), time_mode=mode).filter("_flag").drop("_flag", "_n")

    return _timed(run)


def token_bucket(tokens: int, per=1, burst: int | None = None, keys: Sequence[str] = ()) -> Stage:
    rule = bucket_rule(tokens, per, burst)
    return _timed(
        lambda df: _stateful(df, keys, RuleProcessor(rule)).drop("_n").withColumnRenamed("_flag", "admitted"), admitted=F.lit(True)
    )


def sample_max_per_second(limit: int, keys: Sequence[str] = (), second=1) -> Stage:
    rule = SpanRule(span_micros(second))
    return _timed(lambda df: _stateful(df, keys, WindowProcessor(rule, limit)).filter("_flag").drop("_flag", "_n"))


def align() -> Stage:
    """Streaming ``align``: state per table. Rows without a table pass, and rows without an lsn before any with one."""

    def run(df: DataFrame) -> DataFrame:
        missing = F.when(F.col("lsn").isNull(), "null")
        done = _stateful(df, ["table_name"], HighProcessor(), num=F.col("lsn"), text=missing)
        return done.filter(F.col("_flag") | (F.coalesce("table_name", F.lit("")) == "")).drop("_flag", "_n")

    return run


def cap(limit: int, table: str | None = None, action: str | None = None, keys: Sequence[str] = ()) -> Stage:
    """Streaming ``cap``, over all rows in scope as in batch, or per key. Rows of one key meet in one task."""

    def run(df: DataFrame) -> DataFrame:
        inside = scope(table, action)
        done = _stateful(df.filter(inside), keys, CountProcessor(), num=F.lit(1))
        kept = done.filter(F.col("_n") <= limit).drop("_flag", "_n")
        return kept if not table and not action else kept.unionByName(df.filter(~inside))

    return run


def sequence(start: int = 0, table: str | None = None, field: str = "seq", keys: Sequence[str] = ()) -> Stage:
    """Streaming ``sequence``, over all rows in scope as in batch, or per key. Rows of one key meet in one task."""

    def run(df: DataFrame) -> DataFrame:
        inside = scope(table)
        done = _stateful(df.filter(inside), keys, CountProcessor(), num=F.lit(1))
        stamped = meta.put(field, (F.col("_n") + start).cast("string"), F.lit(True))
        out = done.withColumn("meta", stamped).drop("_flag", "_n")
        return out if not table else out.unionByName(df.filter(~inside))

    return run


def schema_version() -> Stage:
    def run(relations: DataFrame) -> DataFrame:
        done = _stateful(relations, ["relation_id"], ChangeProcessor(), text=fingerprint())
        return done.withColumnRenamed("_flag", "changed").withColumnRenamed("_n", "version")

    return run


def debounce(keys: Sequence[str], window=0.2, max_delay=2, late: str = "0 seconds") -> Stage:
    """Streaming ``debounce``: a burst comes out when its span is over by row or watermark."""
    processor = BurstProcessor(span_micros(window), span_micros(max_delay))

    def run(df: DataFrame) -> DataFrame:
        done = _stateful(
            df.withWatermark("ts", late), keys, processor, time_mode="EventTime",
            schema=_RESULT + ", _rows bigint",
        )
        return (
            done.withColumn("emit_ts", F.timestamp_micros("_n"))
            .withColumnRenamed("_rows", "burst_rows")
            .drop("_flag", "_n")
        )

    return _timed(run, burst_rows=F.lit(1).cast("bigint"), emit_ts=F.lit(None).cast("timestamp"))


class FirstProcessor(_Sorted):
    """The first row of a key by arrival. A micro-batch is read part by part; one row is held."""

    def handleInputRows(self, key, rows, timerValues):
        seen, best = self.state.get() is not None, None
        for part in rows:
            if seen:
                continue
            frame = part.iloc[:, 1:6].set_axis(_FIELDS, axis=1)
            row = frame.loc[frame["_seq"].idxmin()]
            if best is None or row["_seq"] < best[0]:
                best = (int(row["_seq"]), row["_row"])
        if best is not None:
            self.state.update((best[0],))
            yield from _out([(best[1], True, 0)])


def distinct_key(key: Column, table: str | None = None) -> Stage:
    """Streaming ``distinct_key``: the first row per table, action and key; rows of other tables pass.

    The state keeps every key, as in batch.
    """

    def run(df: DataFrame) -> DataFrame:
        inside = scope(table)
        keyed = df.filter(inside).withColumn("_value", F.coalesce(key, F.lit("")))
        done = _stateful(keyed, ["table_name", "action", "_value"], FirstProcessor()).drop("_value", "_flag", "_n")
        return done if table is None else done.unionByName(df.filter(~inside))

    return run
