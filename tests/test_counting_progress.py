import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Observation

from conftest import T0
from tidemark.model import RELATIONS, parse_lsn
from tidemark.operators import counting as n
from tidemark.operators import progress as p
from tidemark.sources import changelog
from tidemark.model import RAW_CHANGES


def pairs(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_aggregates(make):
    rows = make({}, {"action": "DELETE"}, {"table": "o"})
    assert pairs(rows.transform(n.aggregate("table")), "table_name", "n") == [("o", 1), ("users", 2)]
    assert pairs(rows.transform(n.aggregate("action")), "action", "n") == [("DELETE", 1), ("INSERT", 2)]
    with pytest.raises(ValueError):
        n.aggregate("schema")


def test_census_dense_fills_zero(make):
    rows = make({}, {"action": "DELETE"}, {"table": "o"})
    dense = {(r.table_name, r.action): r.n for r in rows.transform(n.census(dense=True)).collect()}
    assert dense[("o", "DELETE")] == 0 and dense[("users", "INSERT")] == 1 and len(dense) == 8
    assert "  users/DELETE: 1" in [r.line for r in rows.transform(n.census_lines()).collect()]
    assert rows.transform(n.snapshot_total()).first().total == 3
    assert ("users:DELETE", 1, "users:DELETE=1") in pairs(rows.transform(n.snapshot()), "key", "n", "text")


def test_summarize_has_totals(make):
    rows = make({}, {"action": "DELETE"}, {"table": "o"})
    got = {(r.table_name, r.action): r.n for r in rows.transform(n.summarize()).collect()}
    assert got[(None, None)] == 3 and got[("users", None)] == 2
    one = {(r.table_name, r.action): r.n for r in rows.transform(n.summarize("o")).collect()}
    assert one[(None, None)] == 1


def test_metrics_by_observe(make):
    rows = make({}, {"action": "DELETE"}, {})
    seen = Observation("metrics")
    rows.observe(seen, *n.pipeline_metrics(F.col("action") == "INSERT")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"received": 3, "filtered": 1, "formatted": 2, "decode_errors": 0, "format_errors": 0}


def test_window_count_drops_old_buckets(make):
    rows = make({"at": 0}, {"at": 0.05}, {"at": 0.1}, {"at": 0.45})
    out = rows.transform(n.window_count(3, 0.1)).orderBy("bucket").collect()
    assert [(r.n, r.window_n) for r in out] == [(2, 2), (1, 3), (1, 1)]
    for bad in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            n.window_count(*bad)


def test_watermark_status(make):
    rows = make({"lsn": 5, "at": 0}, {"lsn": 9, "at": 10}, {"lsn": 9, "at": 20}, {"lsn": 0, "at": 30})
    row = rows.transform(p.watermark_status("2024-01-01 12:00:40", 30)).first()
    assert (row.lsn, row.updated_at, row.stale) == (9, (T0 + dt.timedelta(seconds=10)).replace(tzinfo=None), False)
    assert rows.transform(p.watermark_status("2024-01-01 12:00:41", 30)).first().stale
    never = make({"lsn": 0}).transform(p.watermark_status("2024-01-01 12:00:00")).first()
    assert (never.lsn, never.updated_at, never.stale) == (0, None, True)


def relation(seq, id_, *cols, table="events", deleted=False):
    return (seq, id_, "public", table, list(cols), deleted)


def test_schema_versions(spark):
    a, b = ("id", 23), ("name", 25)
    log = spark.createDataFrame(
        [relation(1, 1, a), relation(2, 1, a), relation(3, 2, a), relation(4, 1, a, b), relation(5, 1, a), relation(6, 1, a)], RELATIONS
    )
    for kw in ({}, {"block": 2}):
        out = log.transform(p.schema_version(**kw)).orderBy("seq").collect()
        assert [(r.version, r.changed) for r in out] == [(1, True), (1, False), (1, True), (2, True), (3, True), (3, False)]
    assert [r.seq for r in log.transform(p.schema_evolve("events")).orderBy("seq").collect()] == [1, 3, 4, 5]
    assert log.transform(p.schema_evolve("other")).count() == 0


def test_relation_dictionary(spark):
    log = spark.createDataFrame(
        [relation(1, 1, ("id", 23)), relation(2, 1, ("id", 20), table="new"), relation(3, 2, ("id", 23)), relation(4, 2, deleted=True)], RELATIONS
    )
    known = changelog.relation_dictionary(log)
    assert [(r.relation_id, r.table_name) for r in known.collect()] == [(1, "new")]
    asked = changelog.lookup_relation(spark.createDataFrame([(1,), (2,)], "relation_id long"), known)
    assert {r.relation_id: r.error for r in asked.collect()} == {1: None, 2: "unknown relation id 2"}


def test_decode(spark):
    relations = spark.createDataFrame(
        [relation(1, 1, ("id", 23), ("name", 25), table="users"), relation(6, 1, ("id", 23), table="people")], RELATIONS
    )
    t, nul, toast = lambda v: ("t", v), ("n", None), ("u", None)
    raw = spark.createDataFrame(
        [
            (0, 1, T0, "insert", 1, [t("0")], None), (2, 2, T0, "begin", None, None, None),
            (3, 3, T0, "insert", 1, [t("42"), t("alice")], None), (4, 4, T0, "update", 1, [toast, nul, t("x")], [t("1")]),
            (5, 5, T0, "delete", 1, None, [t("42")]), (7, 7, T0, "truncate", None, None, None), (8, 8, T0, "insert", 1, [t("9")], None),
            (9, 9, T0, "insert", 999, [t("9")], None), (10, 10, T0, "commit", None, None, None),
        ],
        RAW_CHANGES,
    )
    for out in (changelog.decode_changes(raw, relations), changelog.decode_changes(raw, relations, block=2), changelog.decode_stream(raw, relations)):
        rows = {r.seq: r for r in out.collect()}
        assert sorted(rows) == [0, 3, 4, 5, 7, 8, 9]
        cells = lambda r, f="columns": r[f] and [(c["name"], c["value"]) for c in r[f]]
        assert cells(rows[3]) == [("id", "42"), ("name", "alice")] and rows[3].action == "INSERT"
        assert cells(rows[4]) == [("id", None), ("name", None), ("", "x")] and cells(rows[4], "old_keys") == [("id", "1")]
        assert cells(rows[5]) is None and cells(rows[5], "old_keys") == [("id", "42")]
        assert (rows[7].action, rows[7].table_name, rows[7].decode_error) == ("TRUNCATE", None, None)
        assert rows[8].table_name == "people"
        assert rows[0].decode_error == "unknown relation id 1" and rows[9].decode_error == "unknown relation id 999"


def test_parse_lsn(spark):
    df = spark.createDataFrame([("0/0",), ("1/0",), ("16/B374D848",)], "t string")
    assert [r.n for r in df.select(parse_lsn(F.col("t")).alias("n")).collect()] == [0, 2**32, 0x16B374D848]
