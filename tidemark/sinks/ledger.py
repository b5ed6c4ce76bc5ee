"""Fanout that runs the plan once and remembers which target has which batch.

Rows are staged in one pass, targets read the stage, and a ledger has a file for every (batch, target) that is written. When a
target fails, the others still get the batch; a retry takes the staged rows, which are the same, and leaves out what is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sinks import files

BatchWriter = Callable[[DataFrame, int], None]
_STAGED = "_staged"


class Ledger:
    """Files ``path/batch=<id>/<target>``: which targets have which batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def done(self, batch_id: int) -> set[str]:
        return set(files.names(self.spark, f"{self.path}/batch={batch_id}"))

    def commit(self, batch_id: int, target: str) -> None:
        files.touch(self.spark, f"{self.path}/batch={batch_id}/{target}")

    def entries(self) -> list[tuple[int, str]]:
        return [(b, t) for b in files.numbered(self.spark, self.path, "batch") for t in sorted(self.done(b)) if t != _STAGED]


def fanout_once(targets: dict[str, BatchWriter], path: str) -> BatchWriter:
    """A ``foreachBatch`` writer to all ``targets``; for a batch job, call it with a batch id of its own.

    A target that fails between its write and the ledger's entry gets the batch again, so targets should overwrite by
    batch id (``streaming.runner.batch_table``). The errors of all targets are raised together. The stage goes when all have the batch.
    """
    if not targets:
        raise ValueError("fanout: at least one writer is required")
    if bad := [t for t in targets if not t or "/" in t or t[0] in "._"]:
        raise ValueError(f"fanout: not a name for a target: {bad[0]!r}")

    def write(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        ledger, stage = Ledger(spark, f"{path}/ledger"), f"{path}/stage/batch={batch_id}"
        done = ledger.done(batch_id)
        if targets.keys() <= done:
            return
        if _STAGED not in done:
            df.write.mode("overwrite").parquet(stage)
            ledger.commit(batch_id, _STAGED)
        rows, errors = spark.read.schema(df.schema).parquet(stage), []
        for name, target in targets.items():
            if name in done:
                continue
            try:
                target(rows, batch_id)
                ledger.commit(batch_id, name)
            except Exception as e:  # every target gets its turn
                errors.append(f"fanout[{name}]: {e}")
        if errors:
            raise RuntimeError("; ".join(errors))
        files.delete(spark, stage)

    return write
