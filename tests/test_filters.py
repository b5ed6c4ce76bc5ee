import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import T0, seqs, values
from tidemark.functions.cells import byte_size
from tidemark.operators import filters as f


def test_allow_is_exact_and_empty_accepts_all(make):
    rows = make(
        {"table": "users"}, {"table": "orders"}, {"table": "Users"}, {"table": "users", "schema": "audit"},
        {"table": "users", "action": "DELETE"},
    )
    assert seqs(rows.transform(f.allow(["public.users"]))) == [1, 5]
    assert seqs(rows.transform(f.allow(["public.users"], ["INSERT"]))) == [1]
    assert seqs(rows.transform(f.allow(schemas=["audit"]))) == [4]
    assert seqs(rows.transform(f.allow())) == [1, 2, 3, 4, 5]


def test_allow_reaches_the_scan(spark, make, tmp_path):
    path = str(tmp_path / "log")
    make({"table": "users"}, {"table": "orders"}).write.parquet(path)
    plan = spark.read.parquet(path).transform(f.allow(["public.users"], ["INSERT"]))
    text = plan._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(table_name), IsNotNull(action), EqualTo(table_name,users), EqualTo(action,INSERT)]" in text


def test_skip_any_case_and_needs_a_rule(make):
    rows = make({"table": "Users"}, {"table": "orders"}, {"table": "orders", "action": "DELETE"})
    assert seqs(rows.transform(f.skip(["users"], ["delete"]))) == [2]
    with pytest.raises(ValueError):
        f.skip()


def test_drop_action_and_data_changes(make):
    rows = make({"action": "INSERT"}, {"action": "TRUNCATE"}, {"action": "DELETE"})
    assert seqs(rows.transform(f.drop_action("truncate"))) == [1, 3]
    assert seqs(rows.transform(f.data_changes())) == [1, 3]


def test_expire_keeps_equal_age_and_unknown_time(make):
    rows = make(
        {"wal_ts": T0 - dt.timedelta(seconds=60)}, {"wal_ts": T0 - dt.timedelta(seconds=61)}, {"wal_ts": None},
        {"wal_ts": T0 - dt.timedelta(seconds=90), "table": "orders"},
    )
    assert seqs(rows.transform(f.expire(60, "2024-01-01 12:00:00"))) == [1, 3]
    assert seqs(rows.transform(f.expire(60, "2024-01-01 12:00:00", "users"))) == [1, 3, 4]
    with pytest.raises(ValueError):
        f.expire(0)


def test_size_limit_counts_typed_and_absent_values_as_eight(make):
    rows = make(
        {"table": "t", "schema": "s", "action": "INSERT", "columns": [("ab", "xyz"), ("n", "int", "12345"), ("z", None)]}
    )
    size = 1 + 1 + 6 + (2 + 3) + (1 + 8) + (1 + 8)
    assert rows.select(byte_size().alias("b")).first().b == size
    assert seqs(rows.transform(f.size_limit(size))) == [1]
    assert seqs(rows.transform(f.size_limit(size - 1))) == []
    stubbed = rows.transform(f.size_limit(size - 1, keep_stub=True))
    assert values(stubbed, "_truncated") == [f"original_bytes={size}"]
    with pytest.raises(ValueError):
        f.size_limit(0)


def test_cap_passes_rows_out_of_scope(make):
    rows = make(*[{"table": "orders" if i % 2 else "users"} for i in range(10)])
    assert seqs(rows.transform(f.cap(2, "orders", block=4))) == [1, 2, 3, 4, 5, 7, 9]
    assert seqs(rows.transform(f.cap(3, block=4))) == [1, 2, 3]
    assert rows.transform(f.cap_remaining(3, "orders")).first().remaining == 0
    assert rows.transform(f.cap_remaining(30, "orders")).first().remaining == 25
    with pytest.raises(ValueError):
        f.cap(0)


def test_sample_rate_bounds(make):
    rows = make(*[{} for _ in range(200)])
    assert len(seqs(rows.transform(f.sample_rate(7)))) == 200
    assert seqs(rows.transform(f.sample_rate(-1))) == []
    half = seqs(rows.transform(f.sample_rate(0.5)))
    assert 60 < len(half) < 140 and half == seqs(rows.transform(f.sample_rate(0.5)))


def switch(spark, *points):
    return spark.createDataFrame([(T0 + dt.timedelta(seconds=s), on) for s, on in points], "ts timestamp, on boolean")


def test_gate_follows_the_switch(spark, make):
    rows = make(*[{"at": s} for s in (0, 10, 15, 20, 30)])
    control = switch(spark, (10, False), (20, True))
    assert seqs(rows.transform(f.gate(control))) == [1, 4, 5]
    assert seqs(rows.transform(f.gate(control, initially_open=False))) == [4, 5]


@pytest.mark.parametrize("buffer", [2, 2000])
def test_hold_release_keeps_the_newest(spark, make, buffer):
    rows = make(*[{"at": s} for s in (0, 10, 11, 12, 20, 31, 32)])
    control = switch(spark, (10, True), (12.5, True), (20, False), (30, True))
    out = {r.seq: r.release_ts for r in rows.transform(f.hold_release(control, buffer)).collect()}
    held = [3, 4] if buffer == 2 else [2, 3, 4]
    assert sorted(out) == sorted([1, 5, 6, 7] + held)
    thaw = (T0 + dt.timedelta(seconds=20)).replace(tzinfo=None)
    assert all(out[s] == thaw for s in held) and out[6] is None
    assert out[1] == T0.replace(tzinfo=None)


def test_newest_in_blocks(make):
    rows = make(*[{"table": "ab"[i % 2]} for i in range(20)])
    assert seqs(f.newest(rows, ["table_name"], 2)) == [17, 18, 19, 20]


def test_pins_bypass_the_filter(spark, make):
    rows = make({"table": "a"}, {"table": "b"}, {"table": "c"})
    assert seqs(rows.transform(f.pin_or(F.col("seq") > 2, ["a"]))) == [1, 3]
    pins = spark.createDataFrame([("b",), ("b",)], "key string")
    assert seqs(rows.transform(f.pin_or(F.lit(None).cast("boolean"), pins=pins))) == [2]


def test_validate_gives_the_first_complaint(make):
    rows = make({"table": ""}, {"table": "t", "action": "DROP"}, {})
    out = rows.transform(f.validate(f.require_table(), f.require_action("INSERT", "UPDATE"))).orderBy("seq").collect()
    assert [r.error for r in out] == [
        'validation rule "require_table" failed: table name must not be empty',
        'validation rule "require_action" failed: action "DROP" is not in allowed set [INSERT UPDATE]',
        None,
    ]
    with pytest.raises(ValueError):
        f.validate()


def test_reject_first_rule_and_split(make):
    rows = make({"table": "users", "action": "DELETE"}, {"table": "Users", "action": "DELETE"}, {})
    marked = rows.transform(f.reject(f.RejectRule("a", "users", "DELETE"), f.RejectRule("b", action="DELETE")))
    good, bad = f.split_errors(marked, "rejection")
    assert seqs(good) == [3] and "rejection" not in good.columns
    assert [r.rejection for r in bad.orderBy("seq").collect()] == [
        "rejecter: message rejected: a", "rejecter: message rejected: b",
    ]
    with pytest.raises(ValueError):
        f.reject(f.RejectRule(""))


def test_quorum_policies(make):
    rows = make({})
    yes, no, unknown = F.lit(True), F.lit(False), F.lit(None).cast("boolean")
    vote = lambda policy, *v: rows.select(f.quorum(policy, *v).alias("q")).first().q
    assert vote("all", yes, yes) and not vote("all", yes, unknown)
    assert vote("majority", yes, yes, no) and not vote("majority", yes, no)
    assert vote("any", no, yes) and not vote("any", no, unknown)
    with pytest.raises(ValueError):
        f.quorum("all")
    with pytest.raises(ValueError):
        f.quorum("most", yes)
