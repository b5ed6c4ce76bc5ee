import json

import pytest
from pyspark.sql import functions as F

from conftest import T0, seqs
from tidemark.operators import filters, values
from tidemark.plans.flow import Flow
from tidemark.sinks import formats, writers
from tidemark.sources import changelog


def lines(df, name):
    return [r.line for r in df.transform(formats.formatted(name)).orderBy("seq").collect()]


@pytest.fixture()
def mixed(make):
    return make(
        {"lsn": 0x16B374D848, "at": 0.5, "columns": [("id", "int", "7"), ("q", 'a"b'), ("z", None)], "old_keys": {"id": "6"}, "action": "UPDATE"},
        {"columns": {}, "action": "DELETE"},
        {"columns": None, "action": "TRUNCATE", "schema": None, "table": None},
    )


def test_json(mixed):
    out = lines(mixed, "json")
    assert json.loads(out[0]) == {
        "lsn": "16/B374D848", "timestamp": "2024-01-01T12:00:00.5Z", "action": "UPDATE", "schema": "public", "table": "users",
        "columns": [
            {"name": "id", "type": "int", "value": 7}, {"name": "q", "type": "", "value": 'a"b'}, {"name": "z", "type": "", "value": None},
        ],
        "old_keys": [{"name": "id", "type": "", "value": "6"}],
    }
    assert "\n" not in out[0] and ": " not in out[0]
    assert json.loads(out[1]) == {
        "lsn": "0/2", "timestamp": "2024-01-01T12:00:01Z", "action": "DELETE", "schema": "public", "table": "users",
    }
    assert json.loads(out[2])["table"] == ""


def test_pretty_is_the_same_json_indented(mixed):
    for compact, pretty in zip(lines(mixed, "json"), lines(mixed, "pretty")):
        assert pretty == json.dumps(json.loads(compact), indent=2, ensure_ascii=False)


def test_text(mixed):
    assert lines(mixed, "text") == [
        'UPDATE public.users id=7 q=a"b z=<nil>', "DELETE public.users ", "TRUNCATE . ",
    ]


def test_csv_and_registry(mixed):
    first = lines(mixed, "csv")[1]
    assert first.startswith("0/2,2024-01-01T12:00:01Z,DELETE,public,users,")
    with pytest.raises(ValueError):
        formats.formatted("xml")
    formats.register_format("short", lambda: F.concat(F.col("action"), F.lit("!")))
    assert lines(mixed, "short")[0] == "UPDATE!"


def test_envelope(make):
    rows = make({"meta": {"k": "v"}}, {}).transform(formats.formatted("text")).transform(formats.envelope("shop"))
    one, two = [json.loads(r.envelope) for r in rows.orderBy("seq").collect()]
    assert one["meta"] == {"k": "v"} and "meta" not in two and one["payload"] == "INSERT public.users "
    assert one["source"] == "shop" and len(one["id"]) == 26 and one["id"] != two["id"]
    text = rows.orderBy("seq").select(formats.envelope_text("shop").alias("t")).first().t
    assert text == f"[{one['id']}] shop @ 2024-01-01T12:00:00Z: INSERT public.users "


def test_lines_of_journal_audit_and_observer(make):
    rows = make({"at": 0.25, "columns": {"a": "1"}}, {"table": "o", "action": "DELETE"})
    assert [r.line for r in rows.transform(formats.journal()).orderBy("seq").collect()][0] == "2024-01-01T12:00:00.25Z\tusers\tINSERT\tlsn=1"
    assert [r.line for r in rows.transform(formats.audit(["o"], ["DELETE"])).collect()] == ["time=2024-01-01T12:00:01Z table=o action=DELETE lsn=0/2"]
    assert rows.transform(formats.audit(["o"], ["INSERT"])).count() == 0
    out = [r.x for r in rows.orderBy("seq").select(formats.observe_line("p").alias("x"), "seq").collect()]
    assert out[0] == "p 2024-01-01T12:00:00Z action=INSERT table=users lsn=1 columns=1"


def test_text_sinks(spark, make, tmp_path):
    rows = make({}, {}).transform(formats.formatted("text"))
    path = str(tmp_path / "out")
    for _ in range(2):
        writers.text_sink("file", path)(rows)
    assert spark.read.text(path).count() == 4
    writers.text_sink("null")(rows)
    packed = str(tmp_path / "gz")
    writers.compressed(packed)(rows)
    assert spark.read.text(packed).count() == 2 and list((tmp_path / "gz").glob("*.gz"))
    for bad in (("file", ""), ("tape", "x")):
        with pytest.raises(ValueError):
            writers.text_sink(*bad)
    with pytest.raises(ValueError):
        writers.compressed(packed, "zip")


def test_fanout_tries_all(make):
    seen = []

    def broken(df):
        raise OSError("disk full")

    write = writers.fanout({"a": broken, "b": lambda df: seen.append(df.count()), "c": broken})
    with pytest.raises(RuntimeError, match=r"fanout\[a\]: disk full; fanout\[c\]: disk full"):
        write(make({}, {}))
    assert seen == [2]
    with pytest.raises(ValueError):
        writers.fanout({})


def test_route_and_dispatch(make):
    rows = make({"table": "orders"}, {"table": "users"}, {"table": "orders", "action": "DELETE"})
    routes = {"all": None, "orders": F.col("table_name") == "orders", "none": F.lit(None).cast("boolean")}
    assert sorted((r.seq, r.route) for r in rows.transform(writers.route(routes)).collect()) == [
        (1, "all"), (1, "orders"), (2, "all"), (3, "all"), (3, "orders"),
    ]
    got = {}

    def broken(df):
        raise OSError("first")

    with pytest.raises(OSError, match="first"):
        writers.dispatch({
            "bad": (None, broken), "o": (routes["orders"], lambda df: got.update(o=df.count())), "a": (None, lambda df: got.update(a=df.count())),
        })(rows)
    assert got == {"o": 2, "a": 3}


def test_forward_keeps_failed_rows_back(make):
    rows = make({}, {"action": "DELETE"})
    main, side = [], []
    pred = F.col("action") == "DELETE"
    writers.forward(pred, lambda df: side.extend(seqs(df)), lambda df: main.extend(seqs(df)))(rows)
    assert (side, main) == ([2], [1, 2])

    def broken(df):
        raise OSError("down")

    main.clear()
    with pytest.raises(OSError):
        writers.forward(pred, broken, lambda df: main.extend(seqs(df)))(rows)
    assert main == [1]


def test_split_is_exhaustive(make):
    rows = make({"columns": {"n": "1"}}, {"columns": {"n": "2"}}, {"columns": {}})
    from tidemark.functions.cells import first_value

    left, right = writers.split(first_value("n") == "1")
    assert seqs(rows.transform(left)) == [1] and seqs(rows.transform(right)) == [2, 3]


def test_shard(make):
    rows = make({"table": "a"}, {"table": "b"}, {"table": "x"}).transform(writers.shard(["a", "b", "c"]))
    assert {r.shard: r.n for r in writers.shard_sizes(rows, ["a", "b", "c"]).collect()} == {"a": 1, "b": 1, "c": 0}
    for bad in ([], [""]):
        with pytest.raises(ValueError):
            writers.shard(bad)


def test_dead_letters_retention_and_replay(make):
    rows = make(*[{"at": s, "table": t} for s, t in ((0, "a"), (10, "a"), (20, "b"), (30, "a"))])
    failed = rows.withColumn("reason", F.lit("old")).withColumn("dead_at", F.col("ts"))
    kept = writers.dead_letters(failed, "reason", "2024-01-01 12:00:40", ttl=30, max_size=2)
    assert seqs(kept) == [3, 4]
    assert seqs(writers.dead_letters(failed, "reason", "2024-01-01 12:00:40", ttl=30)) == [2, 3, 4]
    retry = lambda df: filters.reject(filters.RejectRule("still", "a"))(df).withColumnRenamed("rejection", "reason")
    again = writers.replay_dead(kept, retry).collect()
    assert [(r.seq, r.reason) for r in again] == [(4, "rejecter: message rejected: still")]


def test_replay_takes_the_newest_before_the_age(make):
    rows = make({"at": 100}, {"at": 0}, {"at": 50})
    stage = writers.replay_recent("2024-01-01 12:01:40", 2, 50)
    assert seqs(rows.transform(stage)) == [3]


def test_flow_order_and_checkpoint(spark, make, tmp_path):
    rows = make({"lsn": 3}, {"lsn": 9, "table": "x"}, {"lsn": 5, "columns": {"a": "1"}}).withColumn("decode_error", F.lit(None).cast("string"))
    bad = rows.limit(1).withColumn("decode_error", F.lit("unknown"))
    marks = []
    out = str(tmp_path / "flow")
    flow = Flow([filters.allow(["public.users"])], [values.mask_columns("a")], "text", writers.text_sink("file", out), lambda df: marks.extend(r.lsn for r in df.collect()))
    flow.run(rows.unionByName(bad))
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["INSERT public.users ", "INSERT public.users a=***"]
    assert marks == [5]
    with pytest.raises(ValueError):
        Flow(format="xml")
    with pytest.raises(ValueError):
        Flow().run(rows)


def test_scan_formats(spark, make, tmp_path):
    rows = make({"columns": {"a": None}, "meta": {"k": "v"}})
    for fmt in changelog.FORMATS:
        path = str(tmp_path / fmt)
        rows.write.format(fmt).options(timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").save(path)
        back = changelog.scan_changes(spark, path, fmt).first()
        assert (back.seq, back.meta, back.ts) == (1, {"k": "v"}, T0.replace(tzinfo=None)) and back["columns"][0]["name"] == "a"
    with pytest.raises(ValueError):
        changelog.scan_changes(spark, "x", "xls")
