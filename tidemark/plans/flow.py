"""A flow as one object: filter, transform, format, write, checkpoint, in this order.

The same plan serves a batch and a stream. A row that a filter or transform drops does not
move the checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.filters import Stage
from tidemark.operators.values import chain
from tidemark.sinks.formats import formatted
from tidemark.sinks.writers import Writer


def watch_lsn(lines: DataFrame) -> tuple[DataFrame, Observation]:
    high = Observation()
    return lines.observe(high, F.max("lsn").alias("lsn")), high


def reached(lines: DataFrame, high: Observation) -> DataFrame:
    """The observed highest lsn as a row, none if no row had one above 0."""
    lsn = high.get.get("lsn")
    return lines.sparkSession.createDataFrame([(lsn,)] if lsn and lsn > 0 else [], "lsn bigint")


@dataclass(frozen=True)
class Flow:
    filters: Sequence[Stage] = ()
    transforms: Sequence[Stage] = ()
    format: str = "json"
    sink: Writer | None = None
    checkpoint: Writer | None = None

    def __post_init__(self):
        formatted(self.format)  # an unknown format fails when the flow is made

    def plan(self, changes: DataFrame) -> DataFrame:
        """Decoded changes to formatted lines."""
        rows = changes
        if "decode_error" in rows.columns:
            rows = rows.filter(F.col("decode_error").isNull()).drop("decode_error")
        return chain(*self.filters, *self.transforms, formatted(self.format))(rows)

    def write(self, lines: DataFrame) -> None:
        """One pass over the lines: the highest lsn is observed while the sink writes."""
        if self.sink is None:
            raise ValueError("flow: no sink")
        if self.checkpoint is None:
            self.sink(lines)
            return
        watched, high = watch_lsn(lines)
        self.sink(watched)
        self.checkpoint(reached(lines, high))

    def run(self, changes: DataFrame) -> None:
        self.write(self.plan(changes))
