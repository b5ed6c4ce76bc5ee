"""Interval lookups, fanout with a ledger, dead-letter tables, broken lines and buckets."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import T0, seqs
from tidemark.model import CHANGES
from tidemark.operators import filters as f
from tidemark.operators import selection
from tidemark.plans.intervals import during
from tidemark.sinks import deadletters, ledger, writers
from tidemark.sources import changelog
from tidemark.streaming.runner import batch_table


def at(spark, rows, schema):
    """Rows whose first column is seconds after T0 (null: none)."""
    micros = F.lit(int(T0.timestamp() * 10**6)) + (F.col("s") * 10**6).cast("bigint")
    return spark.createDataFrame(rows, f"s double, {schema}").withColumn("ts", F.timestamp_micros(micros))


@pytest.mark.parametrize("most", [0, 1000])
@pytest.mark.parametrize("seed", range(4))
def test_intervals_equal_a_search(spark, seed, most):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(0, 400), [0, 1, 7, 40][seed]))
    entries = at(spark, [(float(t), {"v": i}) for i, t in enumerate(times)], "value struct<v:int>").drop("s")
    probes = [(i, rng.choice([None, -5.0, 1e6, *(float(rng.randrange(-20, 430)) for _ in range(9))])) for i in range(120)]
    rows = at(spark, [(s, i) for i, s in probes], "i int")
    got = {r.i: r.value.v if r.value else None for r in during(rows, entries, "value", broadcast_entries=most).collect()}
    want = {}
    for i, s in probes:
        before = [k for k, t in enumerate(times) if s is not None and t <= s]
        want[i] = before[-1] if before else None
    assert got == want


def test_entries_of_one_instant_keep_the_last(spark):
    entries = at(spark, [(1.0, 1, 7), (1.0, 3, 9), (1.0, 2, 8), (None, 9, 1)], "k int, value int")
    rows = at(spark, [(1.0, 0), (0.5, 1), (None, 2)], "i int")
    assert {r.i: r.value for r in during(rows, entries, "value", tie="k").collect()} == {0: 9, 1: None, 2: None}


def test_gate_does_not_exchange_the_log(spark, make):
    control = at(spark, [(float(i), i % 2 == 0) for i in range(9)], "on boolean")
    rows = make(*[{"at": i / 2} for i in range(20)])
    gated = rows.transform(f.gate(control))
    plan = gated._jdf.queryExecution().executedPlan().toString()
    log_side = plan[: plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in log_side
    assert seqs(gated) == [i + 1 for i in range(20) if min(i // 2, 8) % 2 == 0]
    assert seqs(rows.transform(f.gate(control, broadcast_entries=2))) == seqs(gated)


def test_hold_release_either_way(spark, make):
    rng = random.Random(5)
    control = at(spark, [(float(i), rng.random() < 0.5) for i in range(0, 60, 3)], "on boolean")
    rows = make(*[{"at": i / 3} for i in range(200)])
    out = [
        sorted((r.seq, r.release_ts) for r in rows.transform(f.hold_release(control, 4, broadcast_entries=n)).select("seq", F.col("release_ts").cast("string").alias("release_ts")).na.fill("-").collect())
        for n in (2, 1000)
    ]
    assert out[0] == out[1] and len(out[0]) < 200


# --- a clock that goes back


def bursts(rows, quiet, longest):
    open_, out = {}, set()
    for seq, key, t in rows:
        b = open_.get(key)
        if b and (t - b[1] >= quiet or t >= b[0] + longest):
            out.add((b[3], min(b[1] + quiet, b[0] + longest), b[2]))
            b = None
        open_[key] = (b[0], t, b[2] + 1, seq) if b else (t, t, 1, seq)
    return out | {(b[3], min(b[1] + quiet, b[0] + longest), b[2]) for b in open_.values()}


def test_debounce_of_the_same_time_twice(spark, make):
    rows = make(*[{"at": t, "columns": {}} for t in (1000, 1005, 900, 1000)])
    out = rows.transform(selection.debounce([], 4, 100)).collect()
    assert sorted((r.seq, r.burst_rows) for r in out) == [(1, 1), (3, 2), (4, 1)]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [None, 4])
def test_debounce_with_a_clock_that_goes_back(spark, make, seed, block):
    rng = random.Random(seed)
    now, rows = 500, []
    for seq in range(1, 80):
        now = max(0, now + rng.choice([0, 1, 1, 2, 3, 9, 30, -5, -40]))
        rows.append((seq, rng.choice("ab"), now))
    log = make(*[{"seq": s, "at": t, "table": k} for s, k, t in rows])
    kw = {"block": block} if block else {}
    out = log.transform(selection.debounce(["table_name"], 5, 12, **kw))
    base = int(T0.timestamp())
    got = {(r.seq, r.e // 10**6 - base, r.burst_rows) for r in out.select("seq", F.unix_micros("emit_ts").alias("e"), "burst_rows").collect()}
    assert got == bursts(rows, 5, 12)


# --- fanout with a ledger


def test_a_failing_target_does_not_repeat_the_others(spark, make, tmp_path):
    wrote, runs = [], spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    def target(name, fail=()):
        def write(df, batch_id):
            wrote.append(name)
            if wrote.count(name) in fail:
                raise OSError(f"{name} is down")
            batch_table(str(tmp_path / name))(df, batch_id)

        return write

    rows = make({}, {}, {}).select("seq").mapInArrow(count, "seq bigint")
    write = ledger.fanout_once({"a": target("a"), "b": target("b", (1, 2)), "c": target("c", (1,))}, str(tmp_path / "once"))
    with pytest.raises(RuntimeError, match=r"fanout\[b\].*fanout\[c\]"):
        write(rows, 3)
    with pytest.raises(RuntimeError, match=r"^fanout\[b\]: b is down$"):
        write(rows, 3)
    write(rows, 3)
    write(rows, 3)
    assert wrote == ["a", "b", "c", "b", "c", "b"] and runs.value == 3  # the plan ran once
    for name in "abc":
        assert seqs(spark.read.parquet(str(tmp_path / name / "batch=3"))) == [1, 2, 3]
    assert ledger.Ledger(spark, str(tmp_path / "once/ledger")).entries() == [(3, "a"), (3, "b"), (3, "c")]
    for bad in ({}, {"a/b": target("x")}, {"_staged": target("x")}):
        with pytest.raises(ValueError):
            ledger.fanout_once(bad, str(tmp_path))


# --- dead letters


def test_dead_letters_age_and_replay(spark, tmp_path):
    letters = deadletters.DeadLetters(spark, str(tmp_path / "d"), "k long, reason string, dead_at timestamp", 2 * 3600)
    rows = lambda *r: at(spark, [(s, k, "down") for s, k in r], "k long, reason string").select("k", "reason", F.col("ts").alias("dead_at"))
    now = "2024-01-01 14:00:00"
    assert letters.read(now).count() == 0 and letters.expire(now) == 0
    letters.append(rows((-0.5, 1), (0.0, 2), (60.0, 3)))  # noon is two hours ago
    letters.append(rows((-7200.0, 4), (3600.0, 5)).unionByName(rows((3.0, 6)).withColumn("reason", F.lit(None).cast("string"))))
    assert sorted(r.k for r in letters.read(now).collect()) == [2, 3, 5]
    assert letters.expire(now) == 2 and sorted(r.k for r in letters.read(now).collect()) == [2, 3, 5]
    passed = []

    def retry(df):
        return df.withColumn("reason", F.when(F.col("k") == 3, "still down"))

    def sink(df):
        passed.extend(r.k for r in df.collect())
        letters.append(rows((5000.0, 7)))  # while the replay runs

    letters.replay(retry, sink, now)
    assert sorted(passed) == [2, 5]
    assert sorted((r.k, r.reason) for r in letters.read(now).collect()) == [(3, "still down"), (7, "down")]
    with pytest.raises(ValueError):
        deadletters.DeadLetters(spark, "x", "k long", 0)


# --- broken lines, buckets


def test_broken_lines_are_set_apart(spark, make, tmp_path):
    path = str(tmp_path / "lines")
    good = [r.value for r in make({"columns": {"a": "1"}}, {"meta": {"k": "v"}}).select(F.to_json(F.struct("*")).alias("value")).collect()]
    lines = [*good, "", "{", good[0][:-3], '{"seq": "x"}', '{"lsn": 4}', "null", "[1]", '{"seq": 9, "unknown": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").write.text(path)
    rows, broken = changelog.part_malformed(changelog.scan_lines(spark, path))
    assert rows.columns == [c.name for c in CHANGES.fields] and seqs(rows) == [1, 2, 9]
    assert sorted(r.line for r in broken.collect()) == sorted(["", "{", good[0][:-3], '{"seq": "x"}', '{"lsn": 4}', "null", "[1]"])
    live, bad = changelog.part_malformed(changelog.stream_lines(spark, path))
    from tidemark.streaming import runner

    assert seqs(runner.drain(live, str(tmp_path / "o"), str(tmp_path / "p"))) == [1, 2, 9]


def test_buckets_join_without_exchange(spark, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("left", "right"):
            df = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias(name))
            writers.bucket_sink(f"bucketed_{name}", ["k"], 4, str(tmp_path / name))(df)
        joined = spark.table("bucketed_left").join(spark.table("bucketed_right"), "k")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == sum(len([i for i in range(50) if i % 7 == k]) ** 2 for k in range(7))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    with pytest.raises(ValueError):
        writers.bucket_sink("x", [], 4)
