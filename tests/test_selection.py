"""Order-dependent operators against plain replays, with blocks small enough to be crossed."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import metas, seqs
from tidemark.functions.cells import first_value
from tidemark.model import changes
from tidemark.operators import selection as sel
from tidemark.plans import statescan
from tidemark.plans.blocks import Running, arrival_number, count_if, running
from tidemark.plans.statescan import NONE, BucketRule, SpanRule, compose

SF = "/root/testdata/sf0.001"
SMALL = [{}, {"block": 16}]


@pytest.fixture(scope="module")
def log(spark):
    return changes(spark, SF).withColumn("user", (first_value("user_id").cast("int") % 7).cast("string")).cache()


@pytest.fixture(scope="module")
def rows(log):
    return [
        (r.seq, r.user, r.at, r.lsn, r.table_name)
        for r in log.select("seq", "user", F.unix_micros("ts").alias("at"), "lsn", "table_name").orderBy("seq").collect()
    ]


def replay_span(rows, span, key):
    state, kept = {}, set()
    for seq, user, at, *_ in rows:
        k = key(user)
        if at >= state.get(k, NONE):
            kept.add(seq)
            state[k] = at + span
    return kept


HOUR = 3600
# Few enough rows per block and per fan that several levels are crossed.
SCANS = [{}, {"block": 16, "fan": 3, "levels": 2}, {"block": 50, "fan": 2, "levels": 1, "few_keys": True}]


@pytest.mark.parametrize("kw", SCANS)
def test_dedup_ttl(log, rows, kw):
    got = seqs(log.transform(sel.dedup_ttl(["user"], 12 * HOUR, **kw)))
    assert got == sorted(replay_span(rows, 12 * HOUR * 10**6, lambda u: u))


def test_dedup_ttl_without_key_crosses_all_blocks(log, rows):
    got = seqs(log.transform(sel.dedup_ttl([], 5 * HOUR, block=16, fan=3, levels=2)))
    assert got == sorted(replay_span(rows, 5 * HOUR * 10**6, lambda u: 0))


def test_dedup_expiry_is_exclusive(make):
    log = make({"at": 0}, {"at": 9.9}, {"at": 10}, {"at": 19}, {"at": 20, "table": "x"})
    assert seqs(log.transform(sel.dedup_ttl([], 10))) == [1, 3, 5]
    with pytest.raises(ValueError):
        sel.dedup_ttl([], 0)


def test_dedup_content(make):
    log = make(
        {"columns": {"a": "1", "b": "x"}}, {"columns": {"a": "1", "b": "y"}}, {"columns": {"a": None}},
        {"columns": {"a": "<nil>"}}, {"columns": {"a": "1", "b": "x"}, "action": "UPDATE"}, {"columns": {"a": "1", "b": "x"}},
    )
    assert seqs(log.transform(sel.dedup_content(60))) == [1, 2, 3, 5]
    assert seqs(log.transform(sel.dedup_content(60, ["a"]))) == [1, 3, 5]


def bucket_replay(rows, cost, room):
    held, out = {}, {}
    for seq, user, at, *_ in rows:
        tokens, last = held.get(user, (room, at))
        tokens = min(room, tokens + at - last)
        out[seq] = tokens >= cost
        held[user] = (tokens - cost if out[seq] else tokens, at)
    return out


@pytest.mark.parametrize("kw", SCANS)
def test_token_bucket(log, rows, kw):
    cost = 5 * HOUR * 10**6
    out = log.transform(sel.token_bucket(1, per=5 * HOUR, burst=3, keys=["user"], **kw))
    assert {r.seq: r.admitted for r in out.select("seq", "admitted").collect()} == bucket_replay(rows, cost, 3 * cost)


def test_token_bucket_settings():
    assert sel.bucket_rule(10_000, 1) == BucketRule(1, 100, 1_000_000)
    with pytest.raises(ValueError):
        sel.bucket_rule(0, 1)


def test_token_bucket_of_any_rate(make):
    """3,333 tokens in a second, which is no whole number of microseconds: against a replay in whole numbers."""
    rnd = random.Random(6)
    at = sorted(rnd.random() / 50 for _ in range(400))
    log = make(*[{"at": t} for t in at])
    times = [r.us for r in log.orderBy("seq").selectExpr("unix_micros(ts) AS us").collect()]
    for tokens, burst in ((3333, 5), (3333, None), (999_983, 40)):
        rule, state, want = sel.bucket_rule(tokens, 1, burst), statescan.NONE, []
        for t in times:
            state, hit = rule.step(state, t)
            want.append(hit)
        out = log.transform(sel.token_bucket(tokens, 1, burst, block=64)).orderBy("seq").collect()
        assert [r.admitted for r in out] == want
        assert [r.ts for r in out] == [r.ts for r in log.orderBy("seq").collect()]
        assert burst != 5 or not all(want)


def test_bucket_summary_with_a_large_burst():
    """One block of 2**14 rows that never rests, with room for a million: seconds, and equal to a replay."""
    rnd = np.random.default_rng(3)
    times = np.cumsum(rnd.integers(0, 3, 1 << 14))
    rule = BucketRule(1, 2, 2 * 10**6)
    start = time.perf_counter()
    table = rule.summary(times, np.zeros(len(times), bool))
    assert time.perf_counter() - start < 60
    highs = np.array([p[0] for p in table])
    for state in [NONE, *rnd.integers(0, 2 * 10**6, 20).tolist()]:
        assert statescan._after(table, highs, state) == rule.run(state, times.tolist(), [])[0]


def test_rows_without_a_time_pass(spark, make):
    rows = make(*[{"at": i // 4, "columns": {"k": "a"}} for i in range(40)])
    none = F.when(F.col("seq") % 3 == 0, F.lit(None).cast("timestamp")).otherwise(F.col("ts"))
    mixed = rows.withColumn("ts", none).withColumn("key", F.lit("a"))
    timed = mixed.filter("ts IS NOT NULL")
    empty = {i for i in range(1, 41) if i % 3 == 0}
    stages = [
        sel.dedup_ttl(["key"], 3), sel.dedup_content(3, ["k"]), sel.sample_max_per_second(2), sel.debounce(["key"], 0.5, 3),
        sel.dedup_ttl(["key"], 3, block=8),
    ]
    for stage in stages:
        assert set(seqs(mixed.transform(stage))) == set(seqs(timed.transform(stage))) | empty
    for only in (mixed.filter("ts IS NULL"), mixed.withColumn("ts", F.lit(None).cast("timestamp"))):
        for stage in stages:
            assert seqs(only.transform(stage)) == seqs(only)
    admitted = mixed.transform(sel.token_bucket(1, 1, 1, ["key"])).filter("admitted")
    assert set(seqs(admitted)) == set(seqs(timed.transform(sel.token_bucket(1, 1, 1, ["key"])).filter("admitted"))) | empty
    burst = mixed.transform(sel.debounce(["key"], 0.5, 3)).filter("ts IS NULL").collect()
    assert {(r.emit_ts, r.burst_rows) for r in burst} == {(None, 1)}


@pytest.mark.parametrize("kw", SMALL)
def test_sample_max_per_second(log, rows, kw):
    state, want = {}, set()
    for seq, user, at, *_ in rows:
        start, n = state.get(user, (NONE, 0))
        if at >= start + 24 * HOUR * 10**6:
            start, n = at, 0
        if n < 3:
            want.add(seq)
            n += 1
        state[user] = (start, n)
    assert seqs(log.transform(sel.sample_max_per_second(3, ["user"], 24 * HOUR, **kw))) == sorted(want)


def test_sample_reanchors_after_a_second(make):
    log = make(*[{"at": 0} for _ in range(20)], *[{"at": 1} for _ in range(20)])
    assert seqs(log.transform(sel.sample_max_per_second(5))) == [1, 2, 3, 4, 5, 21, 22, 23, 24, 25]
    assert len(seqs(log.transform(sel.sample_max_per_second(5, block=4)))) == 10
    assert len(seqs(log.transform(sel.sample_max_per_second(0)))) == 40


def burst_replay(rows, quiet, longest):
    open_, out = {}, set()
    for seq, user, at, *_ in rows:
        b = open_.get(user)
        if b and at >= min(b[1] + quiet, b[0] + longest):
            out.add((b[3], min(b[1] + quiet, b[0] + longest), b[2]))
            b = None
        open_[user] = (b[0], at, b[2] + 1, seq) if b else (at, at, 1, seq)
    return out | {(b[3], min(b[1] + quiet, b[0] + longest), b[2]) for b in open_.values()}


@pytest.mark.parametrize("kw", SMALL)
def test_debounce(log, rows, kw):
    out = log.transform(sel.debounce(["user"], 5 * HOUR, 9 * HOUR, **kw))
    got = {(r.seq, r.at, r.burst_rows) for r in out.select("seq", F.unix_micros("emit_ts").alias("at"), "burst_rows").collect()}
    assert got == burst_replay(rows, 5 * HOUR * 10**6, 9 * HOUR * 10**6)


def test_debounce_max_delay(make):
    log = make(*[{"at": i * 0.1} for i in range(30)])
    out = {r.seq: r.burst_rows for r in log.transform(sel.debounce([], 0.2, 1)).collect()}
    assert out == {10: 10, 20: 10, 30: 10}


def test_distinct_key_treats_absent_as_empty(make):
    log = make(
        {"columns": {"id": "1"}}, {"columns": {"id": "1"}}, {"columns": {}}, {"columns": [("id", None)]},
        {"columns": {"id": "1"}, "action": "UPDATE"}, {"table": "o", "columns": {"id": "1"}}, {"table": "o", "columns": {"id": "1"}},
    )
    assert seqs(log.transform(sel.distinct_key("id"))) == [1, 3, 5, 6]
    assert seqs(log.transform(sel.distinct_key("id", "users"))) == [1, 3, 5, 6, 7]


def test_align_drops_rows_behind(make):
    log = make(
        {"lsn": 10}, {"lsn": 9}, {"lsn": 10}, {"lsn": 11}, {"lsn": 5, "table": "o"}, {"lsn": 4, "table": ""}, {"lsn": 3, "table": ""},
    )
    for kw in ({}, {"block": 2}):
        assert seqs(log.transform(sel.align(**kw))) == [1, 3, 4, 5, 6, 7]
    assert {r.table_name: r.last_lsn for r in log.transform(sel.last_lsn()).collect()} == {"users": 11, "o": 5}


def test_reorder_sorts_within_the_buffer(make):
    log = make(*[{"meta": {"lsn": x}} for x in ("3", "1", "2", "9", "oops", "1")], {"meta": None})
    out = log.transform(sel.reorder(3, block=4)).orderBy("chunk", "out_pos").collect()
    assert [r.seq for r in out] == [2, 3, 1, 5, 6, 4, 7]
    for bad in ({"buffer": 0}, {"field": ""}):
        with pytest.raises(ValueError):
            sel.reorder(**bad)


def test_sequence_numbers_rows_in_scope(make):
    log = make({}, {"table": "o"}, {}, {})
    assert metas(log.transform(sel.sequence(10, "users", block=2)), "seq") == ["11", None, "12", "13"]
    batches = log.transform(sel.batch_assign(3, block=2)).orderBy("seq").collect()
    assert [b.batch for b in batches] == [0, 0, 0, 1]


def test_running_in_nested_blocks(log, rows):
    out = running(
        log.select("seq", "user", "lsn"),
        {"n": count_if(), "high": Running("max", F.col("lsn"), before=True), "even": Running("last", F.when(F.col("seq") % 2 == 0, F.col("seq")))},
        ["user"], block=8, levels=2,
    )
    n, high, even = {}, {}, {}
    got = sorted(tuple(r) for r in out.collect())
    for (seq, user, _, lsn, _), row in zip(rows, got):
        n[user] = n.get(user, 0) + 1
        even[user] = seq if seq % 2 == 0 else even.get(user)
        assert row == (seq, user, lsn, n[user], high.get(user), even[user])
        high[user] = max(high.get(user, 0), lsn)


def test_arrival_number_descending(make):
    log = make({}, {}, {})
    assert [r.n for r in arrival_number(log, "n", descending=True, block=2).orderBy("seq").collect()] == [3, 2, 1]


def step_through(rule, times, resets, state):
    out = []
    for t, r in zip(times, resets):
        state, hit = rule.step(state, t, r)
        out.append(hit)
    return state, out


@pytest.mark.parametrize("seed", range(40))
def test_state_functions_equal_a_replay(seed):
    rnd = random.Random(seed)
    n = rnd.randint(1, 40)
    times = [rnd.randint(0, 80) for _ in range(n)]
    if rnd.random() < 0.7:
        times.sort()
    resets = [rnd.random() < 0.08 for _ in times]
    cut = rnd.randint(0, n)
    cost = rnd.randint(1, 9)
    for rule in (SpanRule(rnd.randint(1, 25)), BucketRule(rnd.randint(1, 3), cost, cost * rnd.randint(1, 4))):
        flags = resets if isinstance(rule, SpanRule) else [False] * n
        parts = [(times[:cut], flags[:cut]), (times[cut:], flags[cut:])]
        tables = [rule.summary(np.array(t, dtype=np.int64), np.array(f)) for t, f in parts if t]
        total = tables[0] if len(tables) == 1 else compose(*tables)
        top = min(times) * getattr(rule, "refill", 1) + getattr(rule, "room", 10**6)
        for state in [NONE, *range(-3, min(top, 250), 3)]:
            highs = np.array([p[0] for p in total])
            assert statescan._after(total, highs, state) == step_through(rule, times, flags, state)[0]


def test_running_over_an_order_with_gaps(spark):
    """A block for nearly each row: the default without keys scans the blocks in two levels."""
    rnd = random.Random(8)
    seqs_ = sorted(rnd.sample(range(10**9), 300))
    df = spark.createDataFrame([(s, s % 7) for s in seqs_], "seq long, v long").repartition(4)
    out = running(df, {"n": count_if(), "top": Running("max", F.col("v"), before=True)}, block=1000).orderBy("seq").collect()
    assert [r.n for r in out] == list(range(1, 301))
    assert [r.top for r in out] == [max((s % 7 for s in seqs_[:i]), default=None) for i in range(300)]
