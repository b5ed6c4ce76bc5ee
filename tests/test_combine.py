import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import T0, seqs, values
from tidemark.functions.cells import first_value
from tidemark.operators import combine as c


def keyed(df):
    return df.withColumn("key", first_value("id"))


def body(row):
    return [(x["name"], x["value"]) for x in row["columns"]]


def test_merge_prefers_a_side_and_appends(make):
    dst = keyed(make({"columns": [("id", "1"), ("a", "x"), ("a", "y")]}, {"columns": {"id": "2"}}))
    src = keyed(make({"columns": [("id", "1"), ("a", "p"), ("a", "q"), ("n", "5")]}))
    out = dst.transform(c.merge(src, ["key"])).orderBy("seq").collect()
    assert body(out[0]) == [("id", "1"), ("a", "x"), ("a", "q"), ("n", "5")] and body(out[1]) == [("id", "2")]
    kept = dst.transform(c.merge(src, ["key"], "dst")).orderBy("seq").collect()
    assert body(kept[0]) == [("id", "1"), ("a", "x"), ("a", "y"), ("n", "5")]


def test_merge_table_scope_needs_both_sides(make):
    dst = keyed(make({"columns": {"id": "1"}}, {"table": "orders", "columns": {"id": "2"}}))
    src = keyed(make({"columns": {"id": "1", "n": "1"}}, {"columns": {"id": "2", "n": "2"}}))
    out = dst.transform(c.merge(src, ["key"], table="orders")).orderBy("seq").collect()
    assert [body(r) for r in out] == [[("id", "1")], [("id", "2")]]
    with pytest.raises(ValueError):
        c.merge(src, ["key"], "both")


def test_merge_into_absent_columns(make):
    dst = make({"columns": None}).withColumn("key", F.lit("1"))
    src = keyed(make({"columns": {"id": "1"}}))
    assert body(dst.transform(c.merge(src, ["key"])).first()) == [("id", "1")]


def test_coalesce_last_write_wins(make):
    rows = make(
        {"columns": {"id": "A", "x": "1", "y": "1"}, "lsn": 5}, {"columns": {"id": "a", "x": "2"}, "lsn": 9, "action": "UPDATE"},
        {"columns": {"x": "7"}}, {"columns": [("id", None), ("x", "8")], "lsn": 3}, {"table": "log", "columns": {"id": "a"}},
    )
    out = rows.transform(c.coalesce_rows("id", ["USERS"])).orderBy("seq").collect()
    assert [(r.seq, r.lsn, r.action) for r in out] == [(1, 9, "INSERT"), (3, 3, "INSERT"), (5, 5, "INSERT")]
    assert body(out[0]) == [("id", "a"), ("x", "2"), ("y", "1")]
    assert body(out[1]) == [("id", None), ("x", "8")] and body(out[2]) == [("id", "a")]
    with pytest.raises(ValueError):
        c.coalesce_rows("  ")


def test_coalesce_of_rows_without_columns(make):
    out = make({"columns": {}}, {"columns": None, "lsn": 7}).transform(c.coalesce_rows("id")).collect()
    assert [(r.seq, r.lsn) for r in out] == [(1, 7)] and not out[0]["columns"]


def test_stash_refuses_keys_beyond_capacity(make):
    rows = keyed(make(*[{"columns": {"id": k}} for k in ("a", "b", "a", "c", "b", "")]))
    assert seqs(rows.transform(c.stash_latest("key", 2))) == [3, 5]
    assert seqs(rows.transform(c.stash_latest("key", 0))) == [3, 4, 5]


def ops(spark, *items):
    rows = [(k, T0 + dt.timedelta(seconds=s), i, op, v) for i, (k, s, op, v) in enumerate(items)]
    return spark.createDataFrame(rows, "key string, ts timestamp, seq long, op string, value string")


def test_ttl_lookup_hits_up_to_the_ttl(spark, make):
    rows = keyed(make(*[{"at": s, "columns": {"id": k}} for s, k in ((0, "a"), (5, "a"), (15, "a"), (15.000001, "a"), (5, "b"), (30, "a"), (31, "a"))]))
    cache = ops(spark, ("a", 5, "set", "old"), ("a", 5, "set", "v"), ("a", 29, "set", "w"), ("a", 31, "delete", None), ("b", 9, "set", "z"))
    out = rows.transform(c.ttl_lookup(cache, "key", 10)).orderBy("seq").collect()
    assert [r.cached for r in out] == [None, "v", "v", None, None, "w", None]
    at = F.to_timestamp(F.lit("2024-01-01 12:00:40Z"))
    assert c.ttl_purge(cache, 10, at).first().purged == 1


def test_ttl_lookup_of_a_hot_key_in_blocks(spark, make):
    rows = keyed(make(*[{"at": i * 40, "columns": {"id": "a"}} for i in range(60)]))
    cache = ops(spark, *[("a", i * 100, "set", str(i)) for i in range(20)])
    from tidemark.plans import asof

    entries = cache.select("key", "ts", "seq", F.struct("value").alias("e"))
    out = asof.asof_by_time(rows, entries, ["key"], "e", tie="seq", block=1 << 20)
    assert values(out, "id") and [r.e.value for r in out.orderBy("seq").collect()] == [str(min(i * 40 // 100, 19)) for i in range(60)]
