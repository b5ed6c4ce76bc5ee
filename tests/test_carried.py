"""Streams whose state is a table: carried steps, keyed tables, live metrics."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import T0, seqs
from tidemark.functions.cells import first_value
from tidemark.model import CHANGES, RAW_CHANGES, RELATIONS, changes
from tidemark.operators import combine, counting, filters, progress, selection
from tidemark.sources import changelog
from tidemark.streaming import carried, keyed, metrics, processors, runner

SF = "/root/testdata/sf0.001"
HOUR = 3600


@pytest.fixture(scope="module")
def log(spark):
    return changes(spark, SF).filter("seq < 60").withColumn("user", (first_value("user_id").cast("int") % 3).cast("string")).cache()


def batches(step, path, *parts):
    """Run the parts as micro-batches and give the rows of each."""
    write, out = carried.advance(step, path), []
    for i, part in enumerate(parts):
        write(part, i)
    for i in range(len(parts)):
        out.append(parts[0].sparkSession.read.parquet(f"{path}/rows/batch={i}"))
    return out


def thirds(df, last=60):
    return [df.filter((F.col("seq") >= a) & (F.col("seq") < a + last // 3)) for a in range(0, last, last // 3)]


def rows_of(df, *names):
    return sorted((tuple(str(v) for v in r) for r in df.select(*names).collect()))


STEPS = [
    (lambda: (carried.cap(15, action="UPDATE"), filters.cap(15, action="UPDATE")), ["seq"]),
    (lambda: (carried.cap(4, keys={"user": "string"}), filters.cap(4, keys=["user"])), ["seq"]),
    (lambda: (carried.sequence(7, "orders"), selection.sequence(7, "orders")), ["seq", "meta.seq"]),
    (lambda: (carried.sequence(), selection.sequence()), ["seq", "meta.seq"]),
    (lambda: (carried.align(), selection.align()), ["seq"]),
]


@pytest.mark.parametrize("both, names", STEPS)
def test_steps_equal_the_batch_and_repeat(log, tmp_path, both, names):
    step, stage = both()
    mixed = log.withColumn("lsn", F.when(F.col("seq") % 7 == 0, None).otherwise(F.col("lsn") - (F.col("seq") % 5) * 40 + (1 << 55)))
    parts, path = thirds(mixed), str(tmp_path / "out")
    got = batches(step, path, *parts)
    want = rows_of(mixed.transform(stage), *names)
    assert sorted(r for part in got for r in rows_of(part, *names)) == want
    before = rows_of(got[1], *names)
    carried.advance(step, path)(parts[1], 1)  # the batch runs again
    carried.advance(step, path)(parts[2], 2)
    assert rows_of(log.sparkSession.read.parquet(f"{path}/rows/batch=1"), *names) == before
    assert rows_of(log.sparkSession.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/batch=*"), *names) == want


def test_steps_stay_in_the_engine(log, tmp_path):
    step = carried.align()
    rows, tables = step.apply(log, carried.tables_before(step, log.sparkSession, str(tmp_path), 0))
    for df in (rows, *tables.values()):
        plan = df._jdf.queryExecution().toString()
        assert "Pandas" not in plan and "Python" not in plan


def test_old_tables_go(log, tmp_path):
    step, path = carried.sequence(), str(tmp_path / "out")
    for i in range(6):
        carried.advance(step, path)(log.filter(F.col("seq") % 6 == i), i)
    from tidemark.sinks import files

    assert files.numbered(log.sparkSession, f"{path}/tables", "batch") == [3, 4, 5]


def test_schema_versions_are_carried(spark, tmp_path):
    a, b = ("id", 23), ("name", 25)
    rows = [(i, 1 + i % 2, "public", "t", cols, False) for i, cols in enumerate([[a], [a], [a], [a, b], [a, b], [a], [a], [a]])]
    log = spark.createDataFrame(rows, RELATIONS)
    got = batches(carried.schema_version(), str(tmp_path), log.filter("seq < 3"), log.filter("seq = 3"), log.filter("seq > 3"))
    want = rows_of(log.transform(progress.schema_version()), "seq", "version", "changed")
    assert sorted(r for g in got for r in rows_of(g, "seq", "version", "changed")) == want


# --- relations in a log of their own


def raw(spark, *rows):
    return spark.createDataFrame([(s, s, T0, "insert", rid, [("t", str(s))], None) for s, rid in rows], RAW_CHANGES)


def relations(spark, *rows):
    return spark.createDataFrame([(s, rid, "public", name, [("id", 20)], gone) for s, rid, name, gone in rows], RELATIONS)


def test_rows_wait_for_their_relation(spark, tmp_path):
    both = carried.with_relations
    step = carried.decode(RAW_CHANGES, RELATIONS)
    got = batches(
        step, str(tmp_path),
        both(raw(spark, (2, 1), (4, 1), (6, 1)), relations(spark, (1, 1, "old", False))),
        both(raw(spark), relations(spark, (5, 1, "new", False))),
        both(raw(spark, (8, 2), (10, 1)), relations(spark, (7, 2, "two", False), (9, 1, "newer", False))),
    )
    name = lambda df: sorted((r.seq, r.table_name) for r in df.collect())
    assert [name(g) for g in got] == [[], [(2, "old"), (4, "old")], [(6, "new"), (8, "two")]]
    assert name(carried.decode_rest(step, spark, str(tmp_path))) == [(10, "newer")]


def test_rows_that_lag_find_old_relations(spark, tmp_path):
    rels = relations(spark, (1, 1, "a", False), (5, 1, "b", False), (9, 1, "b", True), (13, 1, "c", False))
    step, both = carried.decode(RAW_CHANGES, RELATIONS), carried.with_relations
    got = batches(
        step, str(tmp_path), both(raw(spark), rels), both(raw(spark, (2, 1)), relations(spark)),
        both(raw(spark, (6, 1), (10, 1), (12, 3)), relations(spark)), both(raw(spark, (14, 1)), relations(spark, (15, 2, "z", False))),
    )
    out = sorted((r.seq, r.table_name, r.decode_error) for g in got for r in g.collect())
    assert [(s, t) for s, t, e in out if not e] == [(2, "a"), (6, "b"), (14, "c")]
    assert [s for s, _, e in out if e] == [10, 12]


@pytest.mark.parametrize("seed", range(3))
def test_logs_at_any_pace(spark, tmp_path, seed):
    rng = random.Random(seed)
    rels = [(2 * i, rng.randrange(3), f"t{i}", rng.random() < 0.2) for i in range(12)]
    rows = [(2 * i + 1, rng.randrange(4)) for i in range(12)]
    step, path, parts = carried.decode(RAW_CHANGES, RELATIONS), str(tmp_path), []
    a = b = 0
    while a < len(rels) or b < len(rows):
        na, nb = rng.randrange(5), rng.randrange(5)
        parts.append(carried.with_relations(raw(spark, *rows[b:b + nb]), relations(spark, *rels[a:a + na])))
        a, b = a + na, b + nb
    got = batches(step, path, *parts)
    out = [r for g in [*got, carried.decode_rest(step, spark, path)] for r in g.collect()]
    want = changelog.decode_changes(raw(spark, *rows), relations(spark, *rels)).collect()
    key = lambda r: (r.seq, r.table_name, r.decode_error)
    assert sorted(map(key, out), key=str) == sorted(map(key, want), key=str)


def test_cache_entries_expire(spark, tmp_path):
    at = lambda s: F.timestamp_micros(F.lit(int(T0.timestamp()) * 10**6) + F.col(s) * 10**6)
    ops = spark.createDataFrame([(1, 0, "k", "set", "a"), (2, 5, "k", "delete", None), (3, 6, "k", "set", "b"), (4, 6, "q", "set", "c")],
                                "seq long, at long, key string, op string, value string").withColumn("ts", at("at")).drop("at")
    rows = spark.createDataFrame([(10, 4, "k"), (11, 5, "k"), (12, 16, "k"), (13, 17, "k"), (14, 16, "q"), (15, None, "k")],
                                 "seq long, at long, user string").withColumn("ts", at("at")).drop("at")
    step = carried.ttl_lookup("user", 10)
    parts = [("seq < 11", "seq = 1"), ("seq = 11", "seq IN (2, 3, 4)"), ("seq IN (12, 14)", "seq > 9"), ("seq IN (13, 15)", "seq > 9")]
    got = batches(step, str(tmp_path), *[carried.with_ops(rows.filter(r), ops.filter(o)) for r, o in parts])
    out = {r.seq: r.cached for g in got for r in g.collect()}
    assert out == {r.seq: r.cached for r in rows.transform(combine.ttl_lookup(ops, "user", 10)).collect()}
    assert out == {10: "a", 11: None, 12: "b", 13: None, 14: "c", 15: None}
    assert spark.read.parquet(f"{tmp_path}/tables/batch=3/cache").count() == 0


# --- rows without a time or a position in stateful streams


def streamed(spark, df, tmp_path, stage, parts=3):
    path = str(tmp_path / "in")
    for part in thirds(df)[:parts]:
        part.coalesce(1).write.mode("append").parquet(path)
    live = changelog.stream_changes(spark, path, schema=df.schema, files_per_trigger=1)
    return runner.drain(live.transform(stage), str(tmp_path / "out"), str(tmp_path / "progress"))


TIMED = [
    (lambda: (processors.dedup_ttl(["user"], 12 * HOUR), selection.dedup_ttl(["user"], 12 * HOUR)), ["seq"]),
    (lambda: (processors.dedup_ttl(["user"], 12 * HOUR, "1 day"), selection.dedup_ttl(["user"], 12 * HOUR)), ["seq"]),
    (lambda: (processors.token_bucket(1, 9 * HOUR, 2, ["user"]), selection.token_bucket(1, 9 * HOUR, 2, ["user"])), ["seq", "admitted"]),
    (lambda: (processors.sample_max_per_second(2, ["user"], 24 * HOUR), selection.sample_max_per_second(2, ["user"], 24 * HOUR)), ["seq"]),
    (lambda: (processors.align(), selection.align()), ["seq", "lsn"]),
]


@pytest.mark.parametrize("both, names", TIMED)
def test_streams_pass_rows_without_a_time(spark, log, tmp_path, both, names):
    live, batch = both()
    mixed = log.withColumns({
        "ts": F.when(F.col("seq") % 4 == 1, None).otherwise(F.col("ts")),
        "lsn": F.when(F.col("seq") % 5 == 2, None).otherwise(F.col("lsn") - (F.col("seq") % 3) + (1 << 54) + 1),
    })
    assert rows_of(streamed(spark, mixed, tmp_path, live), *names) == rows_of(mixed.transform(batch), *names)


def test_debounced_streams_pass_rows_without_a_time(spark, log, tmp_path):
    mixed = log.withColumn("ts", F.when(F.col("seq") % 4 == 1, None).otherwise(F.col("ts")))
    names = ["seq", "emit_ts", "burst_rows"]
    got = rows_of(streamed(spark, mixed, tmp_path, processors.debounce(["user"], 2 * HOUR, 9 * HOUR)), *names)
    want = rows_of(mixed.transform(selection.debounce(["user"], 2 * HOUR, 9 * HOUR)), *names)
    assert set(got) <= set(want) and {r for r in want if r[1] == "None"} <= set(got) and len(got) > 15


# --- tables by key


def test_upserts_equal_the_batch_and_repeat(spark, log, tmp_path):
    short = F.when(F.col("action") == "DELETE", F.filter("columns", lambda c: c["name"] == "user_id")).otherwise(F.col("columns"))
    rows = log.drop("user").withColumn("columns", short)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    table = keyed.upserts(spark, str(tmp_path), schema, "user_id", 4)
    parts = thirds(rows)
    for i in (0, 1, 1, 2, 1, 2):  # batches that run again
        table.write(parts[i], i)
    whole = lambda df: sorted(str(r.asDict(True)) for r in df.select(*rows.columns).collect())
    want = whole(rows.transform(combine.coalesce_rows("user_id")))
    assert whole(table.read()) == want
    table.vacuum()
    assert whole(table.read()) == want
    table.write(parts[2], 2)
    assert whole(table.read()) == want


def test_updates_replace_by_key(spark, tmp_path):
    df = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    table = keyed.update_table(spark, str(tmp_path), df(), ["k"], 4)
    assert table.read().count() == 0
    table.write(df(("a", 1), (None, 1), ("b", 1)), 0)
    table.write(df(("a", 2), (None, 3)), 1)
    table.write(df(), 2)
    assert sorted(map(tuple, table.read().collect()), key=str) == sorted([("a", 2), (None, 3), ("b", 1)], key=str)


def test_metrics_of_each_batch(spark, log, tmp_path):
    counters = counting.pipeline_metrics(F.col("action") == "UPDATE")
    path = str(tmp_path / "in")
    for part in thirds(log):
        part.coalesce(1).write.mode("append").parquet(path)
    with metrics.MetricsLog(spark, str(tmp_path / "metrics"), "m") as kept:
        for _ in range(2):  # the second run finds nothing new
            live = changelog.stream_changes(spark, path, schema=log.schema, files_per_trigger=1)
            seen = metrics.counted(live, "m", counters).select("seq")
            runner.start(seen, str(tmp_path / "progress"), runner.batch_table(str(tmp_path / "out"))).awaitTermination()
    updates = log.filter("action = 'UPDATE'").count()
    total = log.count()
    assert tuple(kept.totals().first()) == (total, total - updates, updates, 0, 0)
    assert sorted(r.batch for r in kept.read().collect()) == [0, 1, 2]


# ------------------------------------------------------------------ TTL and burst rules


def clocked(log):
    """Times that stand still and go back, and rows without one."""
    shift = F.expr("make_interval(0, 0, 0, 0, cast((seq * 37) % 11 as int) - IF(seq % 20 > 15, 30, 0))")
    return log.withColumn("ts", F.when(F.col("seq") % 9 != 4, F.col("ts") + shift)).select("seq", "ts", "user", "columns")


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_dedup_ttl_over_batches_equals_the_batch(log, tmp_path, block):
    rows, path = clocked(log), str(tmp_path / "out")
    step = carried.dedup_ttl(["user"], 20 * HOUR, block=block)
    got = batches(step, path, *thirds(rows))
    want = rows_of(rows.transform(selection.dedup_ttl(["user"], 20 * HOUR)), "seq", "columns")
    assert sorted(r for part in got for r in rows_of(part, "seq", "columns")) == want
    before = rows_of(got[1], "seq")
    carried.advance(step, path)(thirds(rows)[1], 1)  # the batch runs again
    assert rows_of(log.sparkSession.read.parquet(f"{path}/rows/batch=1"), "seq") == before
    assert carried.tables_before(step, log.sparkSession, path, 9)["kept"].count() == 3  # a row for each key


def test_dedup_ttl_forgets_keys_whose_span_is_over(make, tmp_path):
    rows = [make({"seq": 1, "at": 0, "table": "a"}, {"seq": 2, "at": 50, "table": "b"}), make({"seq": 3, "at": 100, "table": "b"}),
            make({"seq": 4, "at": 109, "table": "b"}, {"seq": 5, "at": 109, "table": "a"})]
    step = carried.dedup_ttl(["table_name"], 60, late=30)
    assert [seqs(part) for part in batches(step, str(tmp_path), *rows)] == [[1, 2], [], [5]]
    step = carried.dedup_ttl(["table_name"], 10, late=30)
    batches(step, str(tmp_path / "b"), *rows[:2])
    assert carried.tables_before(step, rows[0].sparkSession, str(tmp_path / "b"), 9)["kept"].count() == 1


@pytest.mark.parametrize("block", [8, 1 << 20])
def test_debounce_over_batches_equals_the_batch(log, tmp_path, block):
    rows, spark = clocked(log), log.sparkSession
    args = (["user"], 9 * HOUR, 30 * HOUR)
    # The clock stays behind all open bursts until the last batch, whose one row closes them.
    last = rows.agg(F.max("ts").alias("ts")).select(
        F.lit(99).cast("bigint").alias("seq"), (F.col("ts") + F.expr("INTERVAL 99 DAYS")).alias("ts"),
        F.lit(None).cast("string").alias("user"), F.lit(None).cast(rows.schema["columns"].dataType).alias("columns"),
    )
    step, path = carried.debounce(rows.schema, *args, late=99 * 24 * HOUR, block=block), str(tmp_path / "out")
    parts = [*thirds(rows), last]
    write = [carried.advance(step, path)] * 3 + [carried.advance(carried.debounce(rows.schema, *args, block=block), path)]
    for i, part in enumerate(parts):
        write[i](part, i)
    names = ["seq", "emit_ts", "burst_rows", "columns"]
    want = rows_of(rows.transform(selection.debounce(*args)), *names)
    got = [rows_of(spark.read.parquet(f"{path}/rows/batch={i}"), *names) for i in range(4)]
    assert sorted(r for part in got for r in part) == want and all(got) and any(int(r[2]) > 3 for r in want)
    write[3](parts[3], 3)  # the batch runs again
    assert rows_of(spark.read.parquet(f"{path}/rows/batch=3"), *names) == got[3]
    assert not list((tmp_path / "out" / "prepared").iterdir())  # worked off


def test_the_clock_ends_a_burst(make, tmp_path):
    rows = [make({"seq": 1, "at": 0, "table": "a"}, {"seq": 2, "at": 3, "table": "a"}), make({"seq": 3, "at": 20, "table": "b"})]
    step = carried.debounce(rows[0].schema, ["table_name"], 5, 60)
    got = batches(step, str(tmp_path), *rows)
    assert [seqs(part) for part in got] == [[], [2]] and got[1].first().burst_rows == 2


@pytest.mark.parametrize("name, table", [("stream_debounce", "debounce"), ("stream_dedup_ttl", "dedup")])
def test_rules_of_streams_keep_tables_and_call_nothing_per_key(spark, tmp_path, monkeypatch, name, table):
    from tidemark import queries

    monkeypatch.setattr(queries, "scratch", lambda spark, name: str(tmp_path / name))
    queries.QUERIES[name](spark, SF).count()
    assert (tmp_path / table / "progress" / "commits").exists()
    assert (tmp_path / table / "tables").exists() and not (tmp_path / table / "progress" / "state").exists()


# ------------------------------------------------------------------ parts and blocks that many tasks share


@pytest.fixture()
def uncoalesced(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.files.maxPartitionBytes")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def tasks_of(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


@pytest.mark.parametrize("name, log", [("stream_decode", "raw"), ("stream_coalesce", "log"), ("stream_sequence_all", "log"),
                                       ("stream_ttl_lookup", "rows"), ("stream_metrics", "raw"), ("stream_summarize", "log")])
def test_a_part_of_a_log_is_written_by_many_tasks(spark, uncoalesced, monkeypatch, name, log):
    from tidemark import queries

    class Seen(Exception):
        pass

    def seen(spark, sf, name, logs, go, places=1):
        raise Seen(logs)

    monkeypatch.setattr(queries, "arriving", seen)
    with pytest.raises(Seen) as e:
        queries.QUERIES[name](spark, SF)
    rows = e.value.args[0][log]
    assert tasks_of(rows.filter((F.col("seq") >= 100) & (F.col("seq") < 400))) == 3  # as many as the shuffle has


def test_an_upsert_reads_a_batch_once_for_each_use(make, tmp_path):
    rows = make({"seq": 5, "columns": {"id": "1", "a": "x"}})
    table = keyed.upserts(rows.sparkSession, str(tmp_path), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in CHANGES), "id")
    leaves = lambda df: df._jdf.queryExecution().optimizedPlan().collectLeaves().size()
    assert leaves(table.merge(rows, rows)) == 2 * leaves(rows.transform(combine.coalesce_rows("id")))


def test_numbers_without_keys_come_from_many_tasks(spark, uncoalesced, tmp_path):
    rows = spark.range(0, 1 << 20, 1 << 12).select(F.col("id").alias("seq"), F.lit("t").alias("table_name"), F.expr("map()").cast("map<string,string>").alias("meta"))
    step = carried.sequence()
    out, _ = step.apply(rows, carried.tables_before(step, spark, str(tmp_path), 0))
    assert len({r.p for r in out.select("meta.seq", F.spark_partition_id().alias("p")).collect()}) > 1
    assert rows_of(out, "seq", "meta.seq") == sorted((str(i << 12), str(i + 1)) for i in range(256))
