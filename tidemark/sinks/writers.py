"""Writers and routing. All work on batch DataFrames, so they serve ``foreachBatch`` too."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.filters import Stage
from tidemark.model import instant, span_micros

Writer = Callable[[DataFrame], None]


def text_sink(kind: str, target: str = "", column: str = "line", compression: str = "none") -> Writer:
    """One line per row: ``file`` or ``null``. See :func:`preview` for a look at the console."""
    if compression not in ("none", "gzip"):
        raise ValueError(f"sink: unknown compression {compression!r}")
    if kind == "file":
        if not target:
            raise ValueError("sink: file target path must not be empty")
        return lambda df: df.select(column).write.mode("append").option("compression", compression).text(target)
    if kind == "null":
        return lambda df: df.select(column).write.format("noop").mode("overwrite").save()
    raise ValueError(f"sink: unknown type {kind!r}")


def preview(rows: int = 20, column: str = "line") -> Writer:
    """The first ``rows`` lines on the console: a look, not a sink."""
    return lambda df: df.select(column).write.format("console").option("truncate", "false").option("numRows", rows).save()


def table_sink(path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "append", **options) -> Writer:
    return lambda df: df.write.mode(mode).format(fmt).partitionBy(*partition_by).options(**options).save(path)


def bucket_sink(table: str, keys: Sequence[str], buckets: int, path: str | None = None, mode: str = "overwrite") -> Writer:
    """A catalog table in hash buckets of ``keys``, sorted by them: joins and counts by these keys then need no exchange.

    Rows are dealt by the same hash first, so that a bucket is one file.
    """
    if buckets <= 0 or not keys:
        raise ValueError("bucket_sink: keys and a number of buckets are needed")

    def write(df: DataFrame) -> None:
        out = df.repartition(buckets, *keys).write.mode(mode).format("parquet").bucketBy(buckets, *keys).sortBy(*keys)
        (out.option("path", path) if path else out).saveAsTable(table)

    return write


def fanout(writers: dict[str, Writer], reuse: bool = False) -> Writer:
    """Every row to every writer. All are tried; the errors are raised together at the end.

    Each writer runs the plan. ``reuse`` keeps the rows on the executors' disks in between,
    which pays when the plan costs more than its result takes to store.
    """
    if not writers:
        raise ValueError("fanout: at least one writer is required")

    def run(df: DataFrame) -> None:
        errors = []
        if reuse:
            df.persist(StorageLevel.DISK_ONLY)
        try:
            for name, write in writers.items():
                try:
                    write(df)
                except Exception as e:  # every writer gets its turn
                    errors.append(f"fanout[{name}]: {e}")
        finally:
            if reuse:
                df.unpersist()
        if errors:
            raise RuntimeError("; ".join(errors))

    return run


def route(routes: dict[str, Column | None]) -> Stage:
    """A row per route whose condition holds (None takes every row), with the name in ``route``."""
    hits = F.array(
        *[
            F.when(F.lit(True) if cond is None else F.coalesce(cond, F.lit(False)), F.lit(name))
            for name, cond in routes.items()
        ]
    )
    return lambda df: df.withColumn("route", F.explode(F.filter(hits, lambda r: r.isNotNull())))


def dispatch(routes: dict[str, tuple[Column | None, Writer]]) -> Writer:
    """Write each route's rows; the first error is raised after all routes had their turn."""

    def run(df: DataFrame) -> None:
        first: Exception | None = None
        for cond, write in routes.values():
            try:
                write(df if cond is None else df.filter(F.coalesce(cond, F.lit(False))))
            except Exception as e:
                first = first or e
        if first:
            raise first

    return run


def forward(pred: Column, target: Writer, main: Writer) -> Writer:
    """Matching rows also go to ``target``; if that fails they do not reach ``main``."""
    hit = F.coalesce(pred, F.lit(False))

    def run(df: DataFrame) -> None:
        try:
            target(df.filter(hit))
        except Exception:
            main(df.filter(~hit))
            raise
        main(df)

    return run


def tapped(pred: Column) -> Stage:
    """All rows with a flag for those that also go to the side target."""
    return lambda df: df.withColumn("tapped", F.coalesce(pred, F.lit(False)))


def split(pred: Column) -> tuple[Stage, Stage]:
    """The rows where the predicate is true, and all others."""
    yes = F.coalesce(pred, F.lit(False))
    return (lambda df: df.filter(yes)), (lambda df: df.filter(~yes))


def shard(names: Sequence[str], key: Column | None = None) -> Stage:
    """Rows whose key is a shard name, with the name in ``shard``; the others are dropped."""
    if not names:
        raise ValueError("shard: at least one shard name is required")
    if any(not n for n in names):
        raise ValueError("shard: a shard name must not be empty")
    key = F.col("table_name") if key is None else key
    return lambda df: df.withColumn("shard", key).filter(F.col("shard").isin(*names))


def shard_sizes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows per shard, 0 for an empty one."""
    counts = [F.count_if(F.col("shard") == n).alias("n") for n in names]
    pairs = F.array(*[F.struct(F.lit(n).alias("shard"), c) for n, c in zip(names, counts)])
    return df.agg(pairs.alias("_all")).select(F.inline("_all"))


def dead_letters(rows: DataFrame, reason: str, as_of=None, ttl=1800, max_size: int = 1000) -> DataFrame:
    """Failed rows (``reason`` column, ``dead_at``) within the retention: not older than ``ttl``
    at ``as_of`` (equal age stays) and the newest ``max_size``."""
    size = max_size if max_size > 0 else 1000
    span = span_micros(ttl) if span_micros(ttl) > 0 else span_micros(1800)
    alive = F.unix_micros("dead_at") >= F.unix_micros(instant(as_of)) - span
    return (
        rows.filter(F.col(reason).isNotNull())
        .filter(alive)
        .orderBy(F.desc("dead_at"), F.desc("seq"))
        .limit(size)
    )


def replay_dead(letters: DataFrame, retry: Stage, reason: str = "reason") -> DataFrame:
    """Run the failing stage again: rows that fail again stay, with the new reason."""
    again = letters.drop(reason).transform(retry)
    return again.filter(F.col(reason).isNotNull())


def replay_recent(as_of=None, max_messages: int = 512, ttl=300, order: str = "seq") -> Stage:
    """The newest ``max_messages`` arrivals, of which those not older than ``ttl`` are replayed."""
    size = max_messages if max_messages > 0 else 512
    span = span_micros(ttl) if span_micros(ttl) > 0 else span_micros(300)

    def run(df: DataFrame) -> DataFrame:
        newest = df.orderBy(F.desc(order)).limit(size)
        return newest.filter(F.unix_micros("ts") >= F.unix_micros(instant(as_of)) - span)

    return run


def compressed(path: str, fmt: str = "gzip") -> Writer:
    if fmt not in ("gzip", "none"):
        raise ValueError(f"compress: unknown format {fmt!r}")
    return text_sink("file", path, compression=fmt)
