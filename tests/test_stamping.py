import hashlib

import pytest
from pyspark.sql import functions as F

from conftest import metas
from tidemark.functions.hashing import fnv1a_32
from tidemark.functions.text import general_number, json_number
from tidemark.operators import stamping as s


def test_annotate_later_rule_wins_in_any_case(make):
    rows = make({"table": "Orders", "meta": {"k": "old", "z": "1"}}, {"meta": None})
    out = rows.transform(s.annotate(s.MetaRule("k", "a", "orders"), s.MetaRule("k", "b", action="insert")))
    assert metas(out, "k") == ["b", "b"] and metas(out, "z") == ["1", None]
    with pytest.raises(ValueError):
        s.annotate(s.MetaRule("", "x"))
    with pytest.raises(ValueError):
        s.annotate()


def test_enrich_tables(make):
    out = make({"table": "A", "meta": {"k": "0"}}, {"table": "b"}).transform(s.enrich({"k": "1"}, ["a"]))
    assert metas(out, "k") == ["1", None]


def test_label_keeps_what_is_there(make):
    rows = make({"meta": {"env": "dev"}}, {})
    assert metas(rows.transform(s.label({"ENV": "prod"})), "env") == ["dev", "prod"]
    assert metas(rows.transform(s.label({"ENV": "prod"}, overwrite=True)), "env") == ["prod", "prod"]
    with pytest.raises(ValueError):
        s.label({})


def test_tag_rules_on_top_of_static(make):
    rows = make({"action": "DELETE"}, {})
    out = rows.transform(s.tag({"risk": "low"}, s.MetaRule("risk", "high", action="delete")))
    assert metas(out, "risk") == ["high", "low"]


def test_pick_and_promote(make):
    rows = make({"columns": [("id", None), ("ID", "7"), ("id", "8")]}, {"table": "orders", "columns": {"id": "9"}})
    assert metas(rows.transform(s.pick("id")), "id") == [None, "9"]
    assert metas(rows.transform(s.pick("id", "key", "orders")), "key") == [None, "9"]
    promoted = rows.transform(s.promote(s.PromoteRule("Id", "k", "USERS")))
    assert metas(promoted, "k") == ["8", None]
    with pytest.raises(ValueError):
        s.promote(s.PromoteRule("a", ""))


def test_promote_absent_value_does_not_hide_an_earlier_rule(make):
    rows = make({"columns": [("a", "1"), ("b", None)]})
    assert metas(rows.transform(s.promote(s.PromoteRule("a", "k"), s.PromoteRule("b", "k"))), "k") == ["1"]


def test_correlate_groups(make):
    rows = make(
        {"columns": {"order": "5"}, "table": "orders"}, {"columns": {"order": "5"}, "table": "items"}, {"columns": {}},
    ).transform(s.correlate("order", "cid"))
    group = rows.transform(s.correlation_groups("cid")).collect()
    assert [tuple(g) for g in group] == [("5", 2, 2, 1, 2)]


def test_score_text_and_first_match(make):
    rows = make({"table": "orders"}, {"table": "payments"}, {"action": "DELETE"}, {})
    rules = [s.ScoreRule(10, "orders", "INSERT"), s.ScoreRule(5.5, "payments"), s.ScoreRule(1, action="DELETE")]
    assert metas(rows.transform(s.score(rules)), "score") == ["10", "5.5", "1", "0"]
    with pytest.raises(ValueError):
        s.score(rules, field="")


def test_priority_first_match_and_stable_order(make):
    rows = make({"table": "a"}, {"table": "b"}, {"table": "a"}, {"table": "c"}, {"table": "b", "action": "DELETE"})
    rules = [s.PriorityRule(s.HIGH, "b"), s.PriorityRule(s.LOW, action="DELETE"), s.PriorityRule(s.LOW, "a")]
    ranked = rows.transform(s.priority(rules))
    assert [r.seq for r in ranked.transform(s.priority_sort()).collect()] == [2, 5, 4, 1, 3]
    at = {r.seq: r.pos for r in ranked.transform(s.priority_position(block=2)).collect()}
    assert [q for q, _ in sorted(at.items(), key=lambda x: x[1])] == [2, 5, 4, 1, 3]


def fnv(text):
    h = 2166136261
    for b in text.encode():
        h = ((h ^ b) * 16777619) % 2**32
    return h


def test_fnv(spark):
    texts = ["", "orders", "é", "日本語 x", "a" * 300, "ÿ\u0080"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.h for r in df.select(fnv1a_32(F.col("t")).alias("h")).collect()] == [fnv(t) for t in texts]


def test_partition_bucket(make):
    rows = make({"columns": {"a": "é1"}}, {"columns": [("a", None)]}, {"columns": {}}, {"columns": None})
    got = [r.b for r in rows.orderBy("seq").select(s.partition_bucket(97, "first_column").alias("b")).collect()]
    assert got == [fnv("é1") % 97, fnv("<nil>") % 97, fnv("") % 97, fnv("") % 97]
    with pytest.raises(ValueError):
        s.partition_bucket(0)


def test_route_key(make):
    row = make({"table": "t"}).select(s.route_key("TABLE.action").alias("a"), s.route_key("x").alias("b")).first()
    assert (row.a, row.b) == ("t.INSERT", "t")


def test_digest_ignores_column_order_and_keeps_the_last_duplicate(make):
    rows = make({"columns": [("b", "2"), ("a", "0"), ("a", None)]}, {"columns": [("a", None), ("b", "2")]}, {"columns": {}})
    out = metas(rows.transform(s.digest()), "_digest")
    assert out[0] == out[1] == hashlib.sha256(b"a=<nil>;b=2;").hexdigest()
    assert out[2] == hashlib.sha256(b"").hexdigest()
    assert metas(rows.transform(s.digest("md5", ["b"], "d")), "d")[0] == hashlib.md5(b"b=2;").hexdigest()
    with pytest.raises(ValueError):
        s.digest("crc")


def test_trace_keeps_the_id_and_counts_hops(make):
    rows = make({"meta": {"trace_id": "abc", "trace_hop": "4x"}}, {"meta": {"trace_id": ""}}, {"table": "o"})
    out = rows.transform(s.trace("users")).orderBy("seq").collect()
    assert out[0].meta == {"trace_id": "abc", "trace_hop": "5"}
    assert len(out[1].meta["trace_id"]) == 26 and out[1].meta["trace_hop"] == "1"
    assert out[2].meta in (None, {}) and out[2].trace_line is None
    assert " id=abc hop=5 table=users action=INSERT lsn=1" in out[0].trace_line


def test_general_number(spark):
    df = spark.createDataFrame([(10.0,), (0.25,), (-3.0,)], "x double")
    assert [r.t for r in df.select(general_number(F.col("x")).alias("t")).collect()] == ["10", "0.25", "-3"]


# How the two text forms print doubles.
NUMBERS = [
    (1e5, "100000", "100000"), (1e6, "1e+06", "1000000"), (1e7, "1e+07", "10000000"), (1234567.0, "1.234567e+06", "1234567"),
    (12345678.5, "1.23456785e+07", "12345678.5"), (1e20, "1e+20", "100000000000000000000"), (1e21, "1e+21", "1e+21"),
    (1e-4, "0.0001", "0.0001"), (1e-5, "1e-05", "0.00001"), (1.5e-7, "1.5e-07", "1.5e-7"), (9.5e-5, "9.5e-05", "0.000095"),
    (-2.5, "-2.5", "-2.5"), (-1e6, "-1e+06", "-1000000"), (0.0, "0", "0"), (999999.5, "999999.5", "999999.5"),
    (float("inf"), "+Inf", "+Inf"), (float("-inf"), "-Inf", "-Inf"), (float("nan"), "NaN", "NaN"), (None, None, None),
    (1.7976931348623157e308, "1.7976931348623157e+308", "1.7976931348623157e+308"), (0.001, "0.001", "0.001"),
]


def test_number_text(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NUMBERS)], "i int, x double").orderBy("i")
    got = df.select(general_number(F.col("x")).alias("g"), json_number(F.col("x")).alias("j")).collect()
    assert [(r.g, r.j) for r in got] == [n[1:] for n in NUMBERS]
