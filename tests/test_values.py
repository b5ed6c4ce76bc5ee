import hashlib
import random

import pytest
from pyspark.sql import functions as F

from conftest import metas, seqs, values
from tidemark.functions.cells import first_value
from tidemark.functions.text import general_number, general_text
from tidemark.operators import values as v


def names(df):
    return [[c["name"] for c in r["columns"]] for r in df.orderBy("seq").collect()]


def test_project(make):
    rows = make({"columns": {"a": "1", "b": "2", "c": "3"}}, {"table": "other", "columns": {"a": "1", "b": "2"}})
    assert names(rows.transform(v.project(["c", "a"], table="users"))) == [["a", "c"], ["a", "b"]]
    assert names(rows.transform(v.project(exclude=["a"]))) == [["b", "c"], ["b"]]
    assert names(rows.transform(v.project())) == [["a", "b", "c"], ["a", "b"]]
    with pytest.raises(ValueError):
        v.project(["a"], ["b"])


def test_absent_columns_stay_absent(make):
    rows = make({"columns": None})
    for stage in (v.project(["a"]), v.mask_columns("a"), v.redact(pattern="x"), v.cast(v.CastRule("a", "int"))):
        assert rows.transform(stage).first()["columns"] is None


def test_get_column_takes_the_first(make):
    rows = make({"columns": [("a", "1"), ("a", "2")]}, {"columns": {}})
    assert [r.x for r in rows.transform(v.get_column("a", "x")).orderBy("seq").collect()] == ["1", None]


def test_flatten(make):
    rows = make({"columns": [("a", "1"), ("b", None), ("a", "2")]}, {"columns": [("n", "int", "5")]}, {"table": "", "columns": {"a": "1"}})
    out = rows.transform(v.flatten()).orderBy("seq").collect()
    assert out[0].flat == {"a": "2", "b": ""} and out[0].flatten_error is None
    assert out[1].flat is None and "not text" in out[1].flatten_error
    named = rows.transform(v.flatten(with_table=True, sep="/")).orderBy("seq").collect()
    assert named[0].flat == {"users/a": "2", "users/b": ""} and named[2].flat == {"a": "1"}


def test_rename_any_case(make):
    rows = make({"table": "USERS"}, {"table": "orders"})
    assert [r.table_name for r in rows.transform(v.rename_table("users", "people")).orderBy("seq").collect()] == ["people", "orders"]


def test_mask_columns_exact_names(make):
    rows = make({"columns": {"email": "a@b", "Email": "c@d"}})
    out = rows.transform(v.mask_columns("email"))
    assert values(out, "email") == ["***"] and values(out, "Email") == ["c@d"]


def test_mask_rules_last_match_reads_the_original(make):
    rows = make({"columns": {"Email": "alice", "x": None}}, {"table": "orders", "columns": {"email": "bob"}})
    out = rows.transform(v.mask_rules(
        v.MaskRule("email", "blank"), v.MaskRule("EMAIL", "hash", "Users"), v.MaskRule("x", "hash"),
    ))
    assert values(out, "Email") == [hashlib.sha256(b"alice").hexdigest(), None]
    assert values(out, "email") == [None, ""]
    assert values(out, "x")[0] == hashlib.sha256(b"<nil>").hexdigest()
    with pytest.raises(ValueError):
        v.mask_rules()


def test_redact(make):
    rows = make(
        {"columns": [("email", "a@b"), ("Email", "a@b"), ("note", "ssn 123-45-6789 here"), ("n", "int", "5"), ("z", None)]},
        {"table": "Users", "columns": {"email": "a@b"}},
    )
    out = rows.transform(v.redact({"users": ["EMAIL", "n"]}, r"\d{3}-\d{2}-\d{4}"))
    assert values(out, "email") == ["[REDACTED]", "a@b"]
    assert values(out, "Email")[0] == "a@b" and values(out, "note")[0] == "[REDACTED]"
    assert values(out, "n")[0] == "5" and values(out, "z")[0] is None
    with pytest.raises(Exception):
        v.redact(pattern="(")


@pytest.mark.parametrize("type_,raw,want", [
    ("int", " 42 ", "42"), ("int", "+7", "7"), ("int", "4.0", None), ("int", "9223372036854775808", None), ("int", "12d", None),
    ("float", "1.50", "1.5"), ("float", "1e3", "1000"), ("float", ".5", "0.5"), ("float", "5.", "5"), ("float", "12d", None),
    ("float", "1e999", None), ("float", "x", None), ("bool", "T", "true"), ("bool", "0", "false"), ("bool", "yes", None),
    ("bool", "tRuE", None), ("string", " a ", " a "),
])
def test_cast_values(make, type_, raw, want):
    row = make({"columns": {"x": raw}}).transform(v.cast(v.CastRule("X", type_, "USERS"))).first()
    got = row["columns"][0]
    if want is None:
        assert row.cast_error == f'cast: column "x" value "{raw}": not a valid {type_}' and got["value"] == raw
    else:
        assert row.cast_error is None and got["value"] == want
        assert got["type"] == (None if type_ == "string" else type_)


def test_cast_stops_at_the_first_error_and_skips_typed(make):
    rows = make({"columns": [("a", "1"), ("b", "x"), ("c", "3"), ("a", "2")]})
    row = rows.transform(v.cast(v.CastRule("a", "int"), v.CastRule("b", "int"), v.CastRule("c", "int"))).first()
    assert [(c["value"], c["type"]) for c in row["columns"]] == [("1", "int"), ("x", None), ("3", None), ("2", "int")]
    assert "column \"b\"" in row.cast_error
    again = rows.transform(v.cast(v.CastRule("a", "int"), v.CastRule("a", "bool"))).first()
    assert again["columns"][0]["type"] == "int" and again.cast_error is None
    mixed = make({"columns": [("a", "1"), ("a", "x"), ("a", "2")]}).transform(v.cast(v.CastRule("a", "int"))).first()
    assert [c["type"] for c in mixed["columns"]] == ["int", None, None]
    with pytest.raises(ValueError):
        v.cast(v.CastRule("a", "date"))
    with pytest.raises(ValueError):
        v.cast()


def test_clamp(make):
    rows = make({"columns": [("a", "int", "500"), ("a", "500"), ("f", "float", "-3.5"), ("f", "float", "2")]})
    row = rows.transform(v.clamp(v.ClampRule("a", 0, 99.9), v.ClampRule("f", -1.5, 10))).first()
    assert [c["value"] for c in row["columns"]] == ["99", "500", "-1.5", "2"]
    other = rows.transform(v.clamp(v.ClampRule("a", 0, 1, "Users"))).first()
    assert other["columns"][0]["value"] == "500"
    for bad in (v.ClampRule("a", 2, 1), v.ClampRule("", 0, 1)):
        with pytest.raises(ValueError):
            v.clamp(bad)


def test_normalize(make):
    rows = make({"columns": [("a", " \t  Hi \x85\n"), ("a", "int", "5"), ("b", " x ")]}, {"table": "o", "columns": {"a": " x "}})
    row = rows.transform(v.normalize({"a": v.trim}, "users")).orderBy("seq").collect()
    assert [c["value"] for c in row[0]["columns"]] == ["Hi", "5", " x "] and row[1]["columns"][0]["value"] == " x "
    custom = rows.transform(v.normalize({"b": lambda c: F.concat(F.lit("<"), c, F.lit(">"))}))
    assert values(custom, "b")[0] == "< x >"
    with pytest.raises(ValueError):
        v.normalize({})


def test_lookup_rules_chain(make):
    rows = make({"columns": {"S": "1", "t": "zz"}}, {"columns": [("s", None)]}, {"columns": [("s", "int", "1")]})
    stage = v.lookup(v.LookupRule("s", {"1": "one", "": "none"}, "USERS"), v.LookupRule("s", {"one": "ONE"}), v.LookupRule("t", {"a": "b"}, fallback="?"))
    out = rows.transform(stage)
    assert values(out, "S")[0] == "ONE" and values(out, "t")[0] == "?"
    assert values(out, "s")[1:] == ["none", "none"]
    with pytest.raises(ValueError):
        v.lookup(v.LookupRule("s", {}))


def test_chain_stops_at_a_dropped_row(make):
    rows = make({}, {"action": "DELETE"})
    from tidemark.operators import filters

    assert seqs(rows.transform(v.chain(filters.drop_action("delete"), v.mask_columns("a")))) == [1]


def test_pivot_columns(make):
    rows = make({"columns": {"n": "5", "x": "no"}})
    row = rows.transform(v.pivot_columns({"n": "int", "x": "double"})).first()
    assert (row.n, row.x) == (5, None)
    assert rows.select(first_value("n").alias("n")).first().n == "5" and metas(rows, "k") == [None]


def test_text_of_known_numbers(spark):
    rng = random.Random(4)
    numbers = [0.0, -0.0, 1.0, 999999.0, 1e6, 123456.75, 0.0001, 0.00009999, 1e21, 1e-300, float("inf"), float("-inf"), float("nan")]
    numbers += [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 15) for _ in range(300)] + [float(rng.randrange(10**7)) for _ in range(100)]
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(numbers)], "i int, n double")
    got = {r.i: r.t for r in rows.select("i", general_number(F.col("n")).alias("t")).collect()}
    assert got == {i: general_text(n) for i, n in enumerate(numbers)}
