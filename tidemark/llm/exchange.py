"""Counts of keys over a whole corpus, brought back to the texts that hold them.

Texts are packed into chunks of a few MB, which are shuffled once, compressed. Each chunk sums its keys first and sends sorted
blocks, one for each range of key values; a range adds up the blocks of all chunks and answers each
block with the totals, in the block's order; a chunk then meets its answers. A key thus crosses the
network once for each chunk that holds it (however often the chunk does), at 4 to 6 bytes, and an
answer comes back at about a bit. No key, however common, makes a task larger: it has one entry for
each chunk. Nothing passes through the driver but the number of bytes.

Chunks and ranges both grow with the corpus, so blocks grow with its square and shrink meanwhile: at 30 GB a block has some
two thousand keys, at 1 TB some fifty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import pack, pack_sorted, slices, unpack, unpack_sorted

CHUNK_BYTES = 8 << 20
RANGES = 2  # chunks for each range of keys


class Corpus(NamedTuple):
    chunks: DataFrame  # _chunk, _blob
    count: int
    bytes: int


def _blob(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _texts(table: pa.Table) -> pa.Table:
    """The rows of a chunk."""
    return pa.ipc.open_stream(table["_blob"][0].as_buffer()).read_all()


def dealt(docs: DataFrame, text: str, chunk_bytes: int = CHUNK_BYTES) -> Corpus:
    """``docs`` in chunks of about ``chunk_bytes`` of text; a longer text is one alone."""
    row = docs.agg(F.sum(F.octet_length(text)).alias("size"), F.count("*").alias("rows")).first()
    size = row["size"] or 0
    count = max(1, -(-(size + 64 * row["rows"]) // chunk_bytes))

    def pack_up(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, held, full = TaskContext.get().partitionId(), 0, [], 0

        def chunk() -> pa.RecordBatch:
            blob = _blob(pa.Table.from_batches(held).combine_chunks())
            return pa.RecordBatch.from_pydict({"_chunk": pa.array([(part << 24) + k], pa.int64()), "_blob": pa.array([blob], pa.binary())})

        for batch in batches:
            for piece in slices(batch, text, most=chunk_bytes // 8):
                more = piece.column(text).nbytes + 64 * piece.num_rows
                if held and full + more > chunk_bytes:
                    yield chunk()
                    k, held, full = k + 1, [], 0
                held.append(piece)
                full += more
        if held:
            yield chunk()

    # Where the rows stand decides their chunk, so the chunks are made once: both passes read this shuffle.
    return Corpus(docs.mapInArrow(pack_up, "_chunk long, _blob binary").repartition(count, "_chunk"), count, size)


_BLOCKS = "_bucket int, _chunk long, keys binary, counts binary, mass long"
_ANSWERS = "_chunk long, _bucket int, totals binary, mass long"


def with_totals(
    corpus: Corpus,
    keys: Callable[[pa.Table], tuple[np.ndarray, int]],
    finish: Callable[[pa.Table, np.ndarray, np.ndarray, int], pa.Table],
    schema: str,
    most: int | None = None,
) -> DataFrame:
    """``finish(texts, ids, totals, mass)`` for each chunk.

    ``keys`` gives the keys of a chunk (repeated as often as they occur), the same on each call, and a mass that is only summed
    up. ``ids`` has the place in ``totals`` of each key, in the order of ``keys``. ``most`` bounds what a chunk reports of a
    key, where only "more than" counts.
    """
    buckets = max(1, -(-corpus.count // RANGES))
    edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)

    def send(chunk: pa.Table) -> pa.Table:
        found, mass = keys(_texts(chunk))
        found, counts = np.unique(found, return_counts=True)
        counts = counts if most is None else np.minimum(counts, most)
        cut = np.searchsorted(found, edges)
        blocks = [
            (b, pack_sorted(k), pack(c, squeeze=True))
            for b, (k, c) in enumerate(zip(np.split(found, cut), np.split(counts, cut)))
        ]
        return pa.table(
            {
                "_bucket": pa.array([b for b, _, _ in blocks], pa.int32()),
                "_chunk": pa.array([chunk["_chunk"][0].as_py()] * len(blocks), pa.int64()),
                "keys": pa.array([k for _, k, _ in blocks], pa.binary()),
                "counts": pa.array([c for _, _, c in blocks], pa.binary()),
                "mass": pa.array([mass] * len(blocks), pa.int64()),
            }
        )

    def add(table: pa.Table) -> pa.Table:
        blocks = [unpack_sorted(k.as_py()) for k in table["keys"]]
        ends = np.cumsum([len(k) for k in blocks])
        every = np.concatenate(blocks)
        counts = np.concatenate([unpack(c.as_py(), squeezed=True) for c in table["counts"]])
        order = np.argsort(every)
        new = np.append(True, np.diff(every[order]) != 0)[:len(every)]
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(counts[order], starts) if len(starts) else counts
        totals = np.empty(len(every), np.uint64)
        totals[order] = np.repeat(sums, np.diff(np.append(starts, len(every))))
        answers = [pack(part, squeeze=True) for part in np.split(totals, ends[:-1])]
        mass = int(table["mass"].to_numpy().sum())
        return pa.table(
            {
                "_chunk": table["_chunk"], "_bucket": table["_bucket"], "totals": pa.array(answers, pa.binary()),
                "mass": pa.array([mass] * len(answers), pa.int64()),
            }
        )

    def meet(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _texts(chunk)
        found, ids = np.unique(keys(texts)[0], return_inverse=True)
        order = np.argsort(answers["_bucket"].to_numpy())
        parts = [unpack(answers["totals"][int(i)].as_py(), squeezed=True) for i in order]
        mass = answers["mass"][0].as_py()
        return finish(texts, ids, np.concatenate(parts), mass)

    answers = (
        corpus.chunks.groupBy("_chunk").applyInArrow(send, _BLOCKS)
        .repartitionById(buckets, F.col("_bucket")).groupBy("_bucket").applyInArrow(add, _ANSWERS)
    )
    answers = answers.repartition(corpus.count, "_chunk")
    return corpus.chunks.groupBy("_chunk").cogroup(answers.groupBy("_chunk")).applyInArrow(meet, schema)
