"""Greedy per-key rules (TTL, rate, delay) as a blocked scan of state functions.

Such a rule carries one number of state along a key's rows in arrival order, and a row's
fate depends on the state left by the rows before it. A key may hold a third of all rows,
so its rows are never brought together. Instead

1. every block of a hot key is summarised as a function "state in -> state out", which is
   piecewise constant or shifted, with few pieces in practice;
2. functions of neighbouring blocks are composed level by level, ``FAN`` at a time;
3. on the way back the state at the entry of every block is resolved;
4. every block (or whole key, if it is not hot) replays its rows from its entry state.

Each step is a shuffle, a sort within partitions and one pass over the sorted rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import BLOCK, with_block

FAN = 1024
NONE = -(1 << 62)  # state of a key without earlier rows
TOP = 1 << 62
Pieces = list[tuple[int, bool, int]]  # (upper bound, constant?, value or shift)

_TABLE = "_k string, _b bigint, hi array<bigint>, fixed array<boolean>, val array<bigint>"
_ENTRY = "_k string, _b bigint, entry bigint"
_HITS = "_seq bigint"
_ANCHORED = "_k string, _b bigint, anchor bigint, start bigint, seq bigint, at bigint"
_OUT_ROWS = 8192
MANY_PARTS = 24  # of a token bucket's function, from which on rows are handled in vector steps


def _after(pieces: Pieces, highs, state: int) -> int:
    hi, fixed, val = pieces[int(np.searchsorted(highs, state, "left"))]
    return val if fixed else state + val


def _tidy(pieces: Pieces) -> Pieces:
    out: Pieces = []
    for piece in pieces:
        if out and out[-1][1:] == piece[1:]:
            out.pop()
        out.append(piece)
    return out


def compose(first: Pieces, then: Pieces) -> Pieces:
    """The state function of ``first`` followed by ``then``."""
    highs = np.array([p[0] for p in then], dtype=np.int64)
    out: Pieces = []
    low = NONE - 1
    for hi, fixed, val in first:
        if fixed:
            out.append((hi, True, _after(then, highs, val)))
        else:
            i = int(np.searchsorted(highs, low + val, "right")) if low >= NONE else 0
            while True:
                reach = then[i][0] - val if then[i][0] < TOP else TOP
                out.append((min(hi, reach), then[i][1], then[i][2] + (0 if then[i][1] else val)))
                if reach >= hi:
                    break
                i += 1
        low = hi
    return _tidy(out)


@dataclass(frozen=True)
class SpanRule:
    """Mark a row when its time has reached the state, then move the state to time + span.

    A row flagged ``reset`` is marked in any case.
    """

    span: int

    def _next(self, ts: np.ndarray, reset: np.ndarray) -> np.ndarray:
        n = len(ts)
        if n < 2 or (ts[1:] >= ts[:-1]).all():
            nxt = np.searchsorted(ts, ts + self.span, "left")
            nxt = np.maximum(nxt, np.arange(1, n + 1))
        else:
            nxt = np.full(n, n, dtype=np.int64)
            stack_ts: list[int] = []  # negated times of the rows ahead that are still in sight
            stack_at: list[int] = []
            for i in range(n - 1, -1, -1):
                # the nearest visible row ahead with a time of at least ts[i] + span
                lo, hi = 0, len(stack_ts)
                want = int(ts[i]) + self.span
                while lo < hi:
                    mid = (lo + hi) // 2
                    if stack_ts[mid] >= want:
                        lo = mid + 1
                    else:
                        hi = mid
                if lo:
                    nxt[i] = stack_at[lo - 1]
                while stack_ts and stack_ts[-1] <= ts[i]:
                    stack_ts.pop()
                    stack_at.pop()
                stack_ts.append(int(ts[i]))
                stack_at.append(i)
        marks = np.append(np.flatnonzero(reset), n)
        return np.minimum(nxt, marks[np.searchsorted(marks[:-1], np.arange(n), "right")])

    def bound(self, newest: int) -> int:
        """The highest state that rows up to the time ``newest`` can leave."""
        return newest + self.span

    def summary(self, ts: np.ndarray, reset: np.ndarray, bound: int = TOP) -> Pieces:
        """State function of a block, right for entry states up to ``bound``."""
        n = len(ts)
        nxt = self._next(ts, reset)
        at = np.arange(n)
        last = np.where(nxt < n, np.minimum(nxt, n - 1), at)
        while True:
            hop = last[last]
            if (hop == last).all():
                break
            last = hop
        left = ts[last] + self.span
        peak = np.maximum.accumulate(ts)
        record = np.concatenate(([True], ts[1:] > peak[:-1]))
        first_reset = int(np.argmax(reset)) if reset.any() else n
        # No entry state gets past the first row at or after the bound, or the first reset.
        sure = min(int(np.searchsorted(peak, bound, "left")), first_reset)
        rows = np.flatnonzero(record & (at < sure))
        pieces = [(int(ts[i]), True, int(left[i])) for i in rows]
        tail = (TOP, True, int(left[sure])) if sure < n else (TOP, False, 0)
        return _tidy(pieces + [tail])

    def step(self, state: int, now: int, reset: bool) -> tuple[int, bool]:
        if reset or now >= state:
            return now + self.span, True
        return state, False

    def run(self, state: int, times: list[int], resets: list[bool]) -> tuple[int, list[bool]]:
        span, hits = self.span, []
        for now, reset in zip(times, resets):
            hit = reset or now >= state
            if hit:
                state = now + span
            hits.append(hit)
        return state, hits


@dataclass(frozen=True)
class BucketRule:
    """Token bucket. The state is the scaled time at which the bucket would be full again.

    ``refill`` units come in per microsecond, a row costs ``cost`` units and ``room`` units
    fit. A row is marked (admitted) when at least ``cost`` units are there.
    """

    refill: int
    cost: int
    room: int

    def step(self, state: int, now: int, reset: bool = False) -> tuple[int, bool]:
        now *= self.refill
        if state > now + self.room - self.cost:
            return state, False
        return max(state, now) + self.cost, True

    def bound(self, newest: int) -> int:
        return newest * self.refill + self.room

    def summary(self, ts: np.ndarray, reset: np.ndarray, bound: int = TOP) -> Pieces:
        scaled = [int(t) * self.refill for t in ts]
        full = [i for i in range(1, len(scaled)) if scaled[i] - scaled[i - 1] >= self.room]
        if full and all(a <= b for a, b in zip(scaled, scaled[1:])):
            state = NONE
            for t in ts[full[-1]:].tolist():
                state, _ = self.step(state, t)
            return [(TOP, True, state)]
        parts: list[tuple] = [(NONE - 1, bound, False, 0)]  # entry range (low, high], fixed?, value or shift
        for i, now in enumerate(scaled):
            if len(parts) > MANY_PARTS:
                parts = self._many(parts, scaled[i:])
                break
            parts = self._merged(self._advance(parts, now))
            if len(parts) == 1 and parts[0][2]:
                state, _ = self.run(parts[0][3], ts[i + 1:].tolist(), [])
                return [(TOP, True, state)]
        pieces = [p[1:] for p in parts]
        return pieces[:-1] + [(TOP, *pieces[-1][1:])]

    def _many(self, parts: list[tuple], scaled: list[int]) -> list[tuple]:
        """All rows' effect on many parts: ``_advance`` and ``_merged`` with a few vector steps a row."""
        low, high, val = (np.array([p[k] for p in parts], np.int64) for k in (0, 1, 3))
        fixed = np.array([p[2] for p in parts])
        cost = self.cost
        for now in scaled:
            top = now + self.room - cost
            full, open_ = np.where(fixed, high, now - val), np.where(fixed, high, top - val)
            lows = np.stack([low, np.maximum(low, full), np.maximum(low, open_)], 1)
            highs = np.stack([np.minimum(high, full), np.minimum(high, open_), high], 1)
            moved = np.where(val <= top, np.maximum(val, now) + cost, val)
            vals = np.stack([np.where(fixed, moved, now + cost), val + cost, val], 1)
            kinds = np.stack([np.ones(len(val), bool), fixed, fixed], 1)
            there = lows < highs
            there[fixed, 1:] = False
            low, high, val, fixed = lows[there], highs[there], vals[there], kinds[there]
            new = np.concatenate([[True], (val[1:] != val[:-1]) | (fixed[1:] != fixed[:-1])])
            if not new.all():
                low, val, fixed = low[new], val[new], fixed[new]
                high = high[np.append(np.flatnonzero(new)[1:] - 1, len(new) - 1)]
        return list(zip(low.tolist(), high.tolist(), fixed.tolist(), val.tolist()))

    def _advance(self, parts: list[tuple], now: int) -> list[tuple]:
        """One row's effect on the states of every part."""
        cost, top = self.cost, now + self.room - self.cost
        out = []
        for low, high, fixed, val in parts:
            if fixed:
                out.append((low, high, True, max(val, now) + cost if val <= top else val))
                continue
            full, open_ = now - val, top - val  # up to ``full`` the bucket is full, up to ``open_`` the row gets in
            if low < full:
                out.append((low, min(high, full), True, now + cost))
            if max(low, full) < min(high, open_):
                out.append((max(low, full), min(high, open_), False, val + cost))
            if open_ < high:
                out.append((max(low, open_), high, False, val))
        return out

    @staticmethod
    def _merged(parts: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for part in parts:
            if out and out[-1][2:] == part[2:]:
                out[-1] = (out[-1][0], *part[1:])
            else:
                out.append(part)
        return out

    def run(self, state: int, times: list[int], resets: list[bool]) -> tuple[int, list[bool]]:
        refill, cost, slack, hits = self.refill, self.cost, self.room - self.cost, []
        for now in times:
            now *= refill
            hit = state <= now + slack
            if hit:
                state = (state if state > now else now) + cost
            hits.append(hit)
        return state, hits


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {
        "string": pa.string(), "bigint": pa.int64(),
        "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()),
    }
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.record_batch(
        [pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields]
    )


def _emit(schema: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= _OUT_ROWS:
            yield _batch(schema, list(zip(*held)))
            held = []
    if held:
        yield _batch(schema, list(zip(*held)))


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])


def _sorted_pass(df: DataFrame, group: list[str], then: list[str], fn, schema: str) -> DataFrame:
    return df.repartition(*group).sortWithinPartitions(*group, *then).mapInArrow(fn, schema)


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """(key, block) and the row range of each run of equal groups in a sorted batch."""
    n = batch.num_rows
    if not n:
        return
    keys, blocks = batch.column("_k"), batch.column("_b").fill_null(NONE)
    new = pc.or_(pc.not_equal(keys[1:], keys[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
    starts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    for start, end in zip(starts, starts[1:]):
        yield (keys[start].as_py(), blocks[start].as_py()), start, end


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False)


def _summarise(rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One function table per (key, block). A leading row tells the newest time of earlier
    blocks. At most one block is held at a time."""

    def close(group, newest, ts, reset):
        bound = NONE if newest is None else rule.bound(newest)
        pieces = rule.summary(np.concatenate(ts), np.concatenate(reset), bound)
        return (*group, [p[0] for p in pieces], [p[1] for p in pieces], [p[2] for p in pieces])

    def tables(batches):
        open_, newest, ts, reset = None, None, [], []
        for batch in batches:
            at, flags, entry = _numbers(batch, "at"), batch.column("reset").fill_null(False).to_numpy(zero_copy_only=False), batch.column("entry")
            for group, start, end in _groups(batch):
                if group != open_:
                    if ts:
                        yield close(open_, newest, ts, reset)
                    open_, newest, ts, reset = group, None, [], []
                    if entry[start].is_valid:
                        newest = entry[start].as_py()
                        start += 1
                if end > start:
                    ts.append(at[start:end])
                    reset.append(flags[start:end])
        if ts:
            yield close(open_, newest, ts, reset)

    return lambda batches: _emit(_TABLE, tables(batches))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compose the tables of each (key, parent) in block order."""

    def parents():
        open_, total = None, None
        for key, parent, *pieces in _rows(batches, "_k", "_p", "hi", "fixed", "val"):
            table = list(zip(*pieces))
            if (key, parent) == open_:
                total = compose(total, table)
                continue
            if open_ is not None:
                yield (*open_, *map(list, zip(*total)))
            open_, total = (key, parent), table
        if open_ is not None:
            yield (*open_, *map(list, zip(*total)))

    return _emit(_TABLE, parents())


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry state of every block of a (key, parent); a leading row may give the parent's."""

    def entries():
        open_, state = None, NONE
        for key, parent, block, entry, *pieces in _rows(batches, "_k", "_p", "_b", "entry", "hi", "fixed", "val"):
            if (key, parent) != open_:
                open_, state = (key, parent), NONE
            if entry is not None:
                state = entry
                continue
            yield key, block, state
            table = list(zip(*pieces))
            state = _after(table, np.array(pieces[0], dtype=np.int64), state)

    return _emit(_ENTRY, entries())


def _replayed(rule, batches: Iterator[pa.RecordBatch]):
    """Each sorted run of rows with its flags; a leading row may give a block's entry state."""
    open_, state = None, NONE
    for batch in batches:
        at, entry = _numbers(batch, "at"), batch.column("entry")
        flags = batch.column("reset").fill_null(False).to_pylist()
        for group, start, end in _groups(batch):
            fresh = group != open_
            if fresh:
                open_, state = group, NONE
                if entry[start].is_valid:
                    state = entry[start].as_py()
                    start += 1
            before = state
            state, hits = rule.run(state, at[start:end].tolist(), flags[start:end])
            yield batch, group, start, end, fresh, before, at[start:end], np.array(hits, dtype=bool)


def _replay(rule) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The marked rows."""

    def run(batches):
        for batch, _, start, end, _, _, _, hits in _replayed(rule, batches):
            yield batch.column("seq").slice(start, end - start).to_numpy(zero_copy_only=False)[hits]

    return lambda batches: _joined(run(batches), lambda parts: [pa.array(np.concatenate(parts).astype(np.int64))], _HITS)


def _joined(parts: Iterator, build: Callable[[list], list], schema: str) -> Iterator[pa.RecordBatch]:
    """Batches of a fair size from many small arrays."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[-1]) if isinstance(part, tuple) else len(part)
        if size >= _OUT_ROWS:
            yield pa.record_batch(build(held), names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch(build(held), names=names)


def _anchored(rule: SpanRule, limit: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with the time and the ``seq`` (start) of the marked row they follow (or are).

    Where that row stands in an earlier block, ``start`` is null. With a ``limit``, only the first so many rows of an
    anchor in each block.
    """

    def run(batches):
        seen, held = 0, NONE
        for batch, group, start, end, fresh, before, at, hits in _replayed(rule, batches):
            seen, held = (0, NONE) if fresh else (seen, held)
            place = np.arange(len(at))
            last = np.maximum.accumulate(np.where(hits, place, -1)) if len(at) else place
            seq = batch.column("seq").slice(start, end - start).to_numpy(zero_copy_only=False).astype(np.int64)
            anchor = np.where(last >= 0, at[last], before - rule.span)
            opened = np.where(last >= 0, seq[last], held)
            rank = np.where(last >= 0, place - last + 1, seen + place + 1)
            if len(at):
                seen, held = int(rank[-1]), int(opened[-1])
            keep = rank <= limit if limit is not None else np.ones(len(at), dtype=bool)
            yield group, anchor[keep], opened[keep], seq[keep], at[keep]

    def build(parts):
        keys = pa.concat_arrays([pa.repeat(pa.scalar(p[0][0], pa.string()), len(p[4])) for p in parts])
        block, anchor, opened, seq, at = (
            np.concatenate([np.full(len(p[4]), p[0][1]) if i == 0 else p[i] for p in parts]).astype(np.int64) for i in range(5)
        )
        return [keys, pa.array(block, mask=block == NONE), pa.array(anchor), pa.array(opened, mask=opened == NONE), pa.array(seq), pa.array(at)]

    return lambda batches: _joined(run(batches), build, _ANCHORED)


def narrow_rows(
    df: DataFrame, keys: Sequence[str], block: int = BLOCK, few_keys: bool = False, held: DataFrame | None = None
) -> DataFrame:
    """What the scans need of each row with a time: ``_k`` (the keys as one text), ``seq``, ``at`` and ``_block``.

    ``held``: narrow rows of earlier micro-batches, that come before; they may have further columns. Rows without a time
    take no part in a rule: see :func:`untimed`.
    """
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}) if keys else F.lit("")
    narrow = df.select(key.alias("_k"), "seq", F.unix_micros("ts").alias("at")).filter(F.col("at").isNotNull())
    if held is not None:
        narrow = narrow.unionByName(held, allowMissingColumns=True)
    return with_block(narrow, ["_k"] if keys else [], F.col("seq"), block, few_keys)


def _with_entries(narrow: DataFrame, rule, reset: Column | None, levels: int, fan: int) -> DataFrame:
    """The rows together with one leading row per block of a hot key that gives its entry state."""
    flag = F.coalesce(reset if reset is not None else F.lit(False), F.lit(False))
    rows = narrow.select("_k", F.col("_block").alias("_b"), "seq", "at", flag.alias("reset"))

    parent = F.floor(F.col("_b") / F.lit(fan)).cast("bigint").alias("_p")
    hot = rows.filter(F.col("_b").isNotNull())
    # The newest earlier time bounds the entry states of a block, so its table stays short.
    earlier = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    newest = hot.groupBy("_k", "_b").agg(F.max("at").alias("_at")).select("_k", "_b", F.max("_at").over(earlier).alias("entry"))
    hot = hot.unionByName(newest.filter("entry is not null"), allowMissingColumns=True)
    up = [_sorted_pass(hot, ["_k", "_b"], ["seq"], _summarise(rule), _TABLE)]
    for _ in range(levels):
        up.append(_sorted_pass(up[-1].select("*", parent), ["_k", "_p"], ["_b"], _fold, _TABLE))

    entries = _sorted_pass(
        up[-1].select("*", F.lit(0).cast("bigint").alias("_p"), F.lit(None).cast("bigint").alias("entry")),
        ["_k", "_p"], ["_b"], _walk, _ENTRY,
    )
    for tables in reversed(up[:-1]):
        given = entries.select("_k", F.col("_b").alias("_p"), F.lit(None).cast("bigint").alias("_b"), "entry")
        both = tables.select("*", parent).unionByName(given, allowMissingColumns=True)
        entries = _sorted_pass(both, ["_k", "_p"], ["_b"], _walk, _ENTRY)
    return rows.unionByName(entries, allowMissingColumns=True)


def scan(narrow: DataFrame, rule: SpanRule | BucketRule, reset: Column | None = None, levels: int = 1, fan: int = FAN) -> DataFrame:
    """The ``_seq`` of the marked rows of ``narrow_rows``."""
    return _sorted_pass(_with_entries(narrow, rule, reset, levels, fan), ["_k", "_b"], ["seq"], _replay(rule), _HITS)


def anchors(
    narrow: DataFrame, rule: SpanRule, reset: Column | None = None, limit: int | None = None,
    levels: int = 1, fan: int = FAN,
) -> DataFrame:
    """The rows of ``narrow_rows`` with ``anchor``, the time of the newest marked row up to each, and ``start``, its ``seq``.

    ``start`` is null where that row stands in an earlier block ``_b``. Without ``reset`` the marked rows' times of a key only
    rise, so (``_k``, ``anchor``) names a run of rows; with it a time may come again, and only ``start`` does.
    """
    return _sorted_pass(
        _with_entries(narrow, rule, reset, levels, fan), ["_k", "_b"], ["seq"], _anchored(rule, limit), _ANCHORED
    )


def marked(narrow: DataFrame, rule: SpanRule, **kw) -> DataFrame:
    """The marked rows of ``narrow_rows`` themselves: ``_k``, ``seq`` and ``at``."""
    return anchors(narrow, rule, limit=1, **kw).filter("start = seq").select("_k", "seq", "at")


def untimed(df: DataFrame) -> DataFrame:
    """The ``_seq`` of rows without a time. No clock can hold them back, so they always pass."""
    return df.filter("ts IS NULL").select(F.col("seq").alias("_seq"))


def keep_marked(df: DataFrame, keys: Sequence[str], rule, block: int = BLOCK, few_keys: bool = False, **kw) -> DataFrame:
    """The rows that the rule marks, and all rows without a time."""
    hits = scan(narrow_rows(df, keys, block, few_keys), rule, **kw).union(untimed(df))
    return df.join(hits, F.col("seq") == F.col("_seq"), "left_semi")


def flag_marked(
    df: DataFrame, keys: Sequence[str], rule, name: str, block: int = BLOCK, few_keys: bool = False, **kw
) -> DataFrame:
    """All rows, with a boolean column that tells whether the rule marks them (rows without a time: true)."""
    hits = scan(narrow_rows(df, keys, block, few_keys), rule, **kw).union(untimed(df))
    return (
        df.join(hits, F.col("seq") == F.col("_seq"), "left")
        .withColumn(name, F.col("_seq").isNotNull())
        .drop("_seq")
    )
