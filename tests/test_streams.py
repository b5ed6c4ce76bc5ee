"""Streams over several micro-batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from conftest import seqs
from tidemark.functions.cells import first_value
from tidemark.model import RELATIONS, changes
from tidemark.operators import filters, progress, selection, values
from tidemark.plans.flow import Flow
from tidemark.sources import changelog
from tidemark.functions.cells import first_value
from tidemark.streaming import processors, runner

SF = "/root/testdata/sf0.001"
HOUR = 3600


@pytest.fixture(scope="module")
def log(spark):
    return changes(spark, SF).withColumn("user", (first_value("user_id").cast("int") % 7).cast("string"))


@pytest.fixture(scope="module")
def files(log, tmp_path_factory):
    """The log in three files that arrive one after the other."""
    path = str(tmp_path_factory.mktemp("log"))
    cuts = [0, 300, 650, 10**9]
    for low, high in zip(cuts, cuts[1:]):
        log.filter((F.col("seq") >= low) & (F.col("seq") < high)).coalesce(1).write.mode("append").parquet(path)
    return path


@pytest.fixture()
def run(spark, log, files, tmp_path):
    def go(stage, mode="append"):
        live = changelog.stream_changes(spark, files, schema=log.schema, files_per_trigger=1)
        return runner.drain(live.transform(stage), str(tmp_path / "out"), str(tmp_path / "progress"), mode)

    return go


@pytest.mark.parametrize("late", [None, "0 seconds"])
def test_dedup(run, log, late):
    out = run(processors.dedup_ttl(["user"], 12 * HOUR, late))
    assert seqs(out) == seqs(log.transform(selection.dedup_ttl(["user"], 12 * HOUR)))
    assert out.select("batch").distinct().count() == 3


def test_whole_rows_come_through(run, log):
    out = run(processors.sequence(5, "orders")).drop("batch")
    want = log.transform(selection.sequence(5, "orders"))
    assert [r.asDict(True) for r in out.orderBy("seq").collect()] == [r.asDict(True) for r in want.orderBy("seq").collect()]


def test_align(run, log):
    assert seqs(run(processors.align())) == seqs(log.transform(selection.align()))


def test_token_bucket(run, log):
    args = (1, 5 * HOUR, 3, ["user"])
    got = {r.seq: r.admitted for r in run(processors.token_bucket(*args)).collect()}
    assert got == {r.seq: r.admitted for r in log.transform(selection.token_bucket(*args)).collect()}


def test_sample(run, log):
    args = (3, ["user"], 24 * HOUR)
    assert seqs(run(processors.sample_max_per_second(*args))) == seqs(log.transform(selection.sample_max_per_second(*args)))


def test_cap_over_all_rows(run, log):
    assert seqs(run(processors.cap(40, action="UPDATE"))) == seqs(log.transform(filters.cap(40, action="UPDATE")))


def test_sequence_over_all_rows(run, log):
    stamps = lambda df: {r.seq: r["meta"]["seq"] for r in df.collect()}
    assert stamps(run(processors.sequence(7))) == stamps(log.transform(selection.sequence(7)))


@pytest.mark.parametrize("table", [None, "orders"])
def test_distinct_key_keeps_the_first_row(spark, log, files, tmp_path, table):
    # All files in one micro-batch: rows of a key come in no order.
    live = changelog.stream_changes(spark, files, schema=log.schema)
    out = runner.drain(live.transform(processors.distinct_key(first_value("user_id"), table)), str(tmp_path / "o"), str(tmp_path / "p"))
    assert seqs(out) == seqs(log.transform(selection.distinct_key("user_id", table)))


def test_cap_per_table(run, log):
    assert seqs(run(processors.cap(40, action="UPDATE", keys=["table_name"]))) == seqs(
        log.transform(filters.cap(40, action="UPDATE", keys=["table_name"]))
    )


def test_debounce(run, log):
    args = (["user"], 5 * HOUR, 9 * HOUR)
    key = lambda df: {(r.seq, r.emit_ts, r.burst_rows) for r in df.collect()}
    got, want = key(run(processors.debounce(*args))), key(log.transform(selection.debounce(*args)))
    # What is missing has not come to its end at the last row's time.
    end = log.agg(F.max("ts").alias("t")).first().t
    assert got <= want and all(emit > end for _, emit, _ in want - got)


def test_schema_version(spark, tmp_path):
    path = str(tmp_path / "relations")
    a, b = ("id", 23), ("name", 25)
    for i, cols in enumerate([[a], [a], [a, b], [a]]):
        spark.createDataFrame([(i, 1, "public", "t", cols, False)], RELATIONS).coalesce(1).write.mode("append").parquet(path)
    live = changelog.stream_changes(spark, path, schema=RELATIONS, files_per_trigger=1)
    out = runner.drain(live.transform(processors.schema_version()), str(tmp_path / "out"), str(tmp_path / "progress"))
    batch = spark.read.schema(RELATIONS).parquet(path).transform(progress.schema_version())
    rows = lambda df: [(r.seq, r.version, r.changed) for r in df.orderBy("seq").collect()]
    assert rows(out) == rows(batch) == [(0, 1, True), (1, 1, False), (2, 2, True), (3, 3, True)]


def test_flow_resumes_where_it_stopped(spark, log, files, tmp_path):
    flow = Flow([filters.allow(["public.orders"])], [values.mask_columns("user_id")], "text")
    out, mark = str(tmp_path / "out"), str(tmp_path / "progress")
    live = lambda: changelog.stream_changes(spark, files, schema=log.schema, files_per_trigger=1)
    runner.run_stream(live(), flow, out, mark).awaitTermination()
    first = spark.read.text(f"{out}/lines/batch=*").count()
    runner.run_stream(live(), flow, out, mark).awaitTermination()
    assert spark.read.text(f"{out}/lines/batch=*").count() == first == log.filter("table_name = 'orders'").count()
    highs = [r.lsn for r in spark.read.parquet(f"{out}/checkpoint/batch=*").collect()]
    assert len(highs) == 3 and max(highs) == log.filter("table_name = 'orders'").agg(F.max("lsn")).first()[0]


def test_checkpoint_folder(spark):
    from tidemark.session import checkpoint_root

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_root(spark) == (named or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints").rstrip("/")
    assert checkpoint_root(spark, "/x/") == (named.rstrip("/") if named else "/x")
