"""Fingerprints of documents: quartile codes of hashed byte triplets, compared with a bounded difference score.

Every three consecutive bytes of a text (with two bytes of 0xFF before and after it, which no UTF-8 holds) are hashed to one
of ``BUCKETS``. A bucket's code counts the quartiles of all buckets that its count exceeds (0 to 3). A
digest is one byte for the length, in eighths of a doubling, and the codes, four a byte, as hex.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import slices
from tidemark.llm.store import stored

BUCKETS = 256
MULTIPLIER = 2654435761  # of the triplet's hash, modulo 2 ** 32; its upper 8 bits are the bucket
BOUND = 320  # of the difference: what independent codes come to, 1.25 a bucket
LENGTH_WEIGHT, LENGTH_MOST = 2, 32
STEP_BYTES, STEP_ROWS = 2 << 20, 2048


def codes(texts: list[bytes]) -> np.ndarray:
    """A row for each text: the length byte and ``BUCKETS`` quartile codes."""
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(b"\xff\xff" + t + b"\xff\xff" for t in texts), np.uint8).astype(np.uint32)
    triplet = data[:-2] | (data[1:-1] << 8) | (data[2:] << 16)
    bucket = (triplet * np.uint32(MULTIPLIER)) >> 24
    text = np.repeat(np.arange(len(texts)), size + 4)[:-2]
    inside = np.ones(len(text), bool)
    borders = np.cumsum(size + 4)[:-1]
    inside[borders - 1] = inside[borders - 2] = False  # these triplets reach into the next text
    count = np.bincount((text * BUCKETS + bucket)[inside], minlength=len(texts) * BUCKETS).reshape(-1, BUCKETS)
    ranked = np.sort(count, axis=1)
    out = np.empty((len(texts), BUCKETS + 1), np.uint8)
    out[:, 0] = np.minimum(255, np.floor(8 * np.log2(size + 1)))
    out[:, 1:] = sum((count > ranked[:, [q * BUCKETS // 4 - 1]]).astype(np.uint8) for q in (1, 2, 3))
    return out


def digests(coded: np.ndarray) -> list[str]:
    """The hex text of each row of :func:`codes`."""
    four = coded[:, 1:].reshape(len(coded), -1, 4)
    packed = four[:, :, 0] | (four[:, :, 1] << 2) | (four[:, :, 2] << 4) | (four[:, :, 3] << 6)
    return [row.tobytes().hex() for row in np.concatenate([coded[:, :1], packed.astype(np.uint8)], axis=1)]


def parsed(fingerprints: list[str]) -> np.ndarray:
    """The rows of :func:`codes` of hex digests."""
    raw = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(len(fingerprints), -1)
    split = (raw[:, 1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.concatenate([raw[:, :1], split.reshape(len(raw), -1)], axis=1)


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The score of each pair of rows, from 0 (same digest) to ``BOUND``."""
    apart = np.abs(a.astype(np.int16) - b.astype(np.int16))
    return np.minimum(BOUND, apart[:, 1:].sum(axis=1) + LENGTH_WEIGHT * np.minimum(apart[:, 0], LENGTH_MOST))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - difference(a, b) / BOUND


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the digest of each text in ``name`` (a column of that name is replaced); null counts as empty."""
    digest = F.pandas_udf(_digest_series, "string")
    return docs.withColumn(name, digest(F.coalesce(F.col(text), F.lit(""))))


def _digest_series(texts: pd.Series) -> pd.Series:
    found = [d for part in _runs([t.encode() for t in texts]) for d in digests(codes(part))]
    return pd.Series(found, index=texts.index, dtype=object)


def _runs(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of about ``STEP_BYTES`` in all; a longer text is one alone."""
    size = np.cumsum([len(t) + STEP_BYTES // STEP_ROWS for t in texts]) // STEP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
    yield from (texts[a:b] for a, b in zip(cuts, cuts[1:]) if b > a)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points (or all) from the start of ``following``."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in COMPARED.split(", ")]


def _compared(texts: list[str], following: list[str]) -> dict[str, list]:
    """The columns of ``COMPARED`` for texts and the texts that follow them."""
    out: dict[str, list] = {n: [] for n in _NAMES}
    at = 0
    for run in _runs([t.encode() for t in texts]):
        mine, after = texts[at:at + len(run)], following[at:at + len(run)]
        at += len(run)
        other = [edited(a, b).encode() for a, b in zip(mine, after)]
        own, new, later = codes(run), codes(other), codes([t.encode() for t in after])
        columns = (
            [len(t) for t in mine], [hashlib.sha256(t).hexdigest() for t in other], digests(own), digests(new),
            likeness(own, new).tolist(), likeness(own, later).tolist(),
        )
        for n, values in zip(_NAMES, columns):
            out[n] += values
    return out


def _along(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order against their next ones; the partition's first and last row also come out with their texts.

    Only one run of texts is held, and the row before it.
    """
    part, held = TaskContext.get().partitionId(), None  # held: the last row, whose next one is not known yet

    def rows(keys, body, border="", texts=None):
        n = len(keys)
        arrays = [pa.array(keys, pa.string()), pa.array([part] * n, pa.int32()), pa.array([border] * n, pa.string())]
        arrays.append(pa.array(texts or [None] * n, pa.string()))
        kinds = [pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        arrays += [pa.array(body[c] if body else [None] * n, k) for c, k in zip(_NAMES, kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["_key", "_part", "_border", "_text", *_NAMES])

    for batch in batches:
        for piece in slices(batch, "_text"):
            keys, texts = piece.column("_key").to_pylist(), piece.column("_text").to_pylist()
            if held is None:
                yield rows(keys[:1], None, "first", texts[:1])
            else:
                keys, texts = [held[0], *keys], [held[1], *texts]
            held = keys[-1], texts[-1]
            if len(keys) > 1:
                yield rows(keys[:-1], _compared(texts[:-1], texts[1:]))
    if held is not None:
        yield rows([held[0]], None, "last", [held[1]])


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # at most a row for each partition
            one = batch.slice(i, 1)
            body = _compared(one.column("_text").to_pylist(), one.column("_next").to_pylist())
            yield pa.RecordBatch.from_arrays([one.column("_key"), *(pa.array(body[n]) for n in _NAMES)], ["_key", *_NAMES])


def compare_neighbours(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and the columns of ``COMPARED``: each text against its edited form and against the next document.

    The next document is the next row by ``key`` (null first, equal keys by length and text), after the last the first; a
    table of one row is its own next. A range partition brings rows into order with one shuffle; inside a partition they are
    worked off as a stream. Only the partitions' border rows wait for a join, one row for each partition.

    A null text counts as empty; an empty text has the digest of its borders alone and is as like another empty one as can be.
    Very long texts are held one at a time (with the next). Equal rows are rows of their own. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_order"), F.col(key).cast("string").alias("_key"), F.length(body).alias("_size"), body.alias("_text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "_order", "_size").sortWithinPartitions("_order", "_size", "_text").select("_key", "_text")
    schema = f"_key string, _part int, _border string, _text string, {COMPARED}"
    found = stored(ranged.mapInArrow(_along, schema), "neighbours")
    lasts = found.filter("_border = 'last'").select("_key", "_text", "_part")
    here = sorted(r["_part"] for r in lasts.select("_part").collect())  # the partitions that have rows
    follows = spark.createDataFrame(list(zip(here, here[1:] + here[:1])), "_part int, _to int")
    firsts = found.filter("_border = 'first'").select(F.col("_part").alias("_to"), F.col("_text").alias("_next"))
    pairs = lasts.join(follows, "_part").join(firsts, "_to").select("_key", "_text", "_next")
    ends = pairs.mapInArrow(_pairs, f"_key string, {COMPARED}")
    out = found.filter("_border = ''").select("_key", *_NAMES).union(ends)
    back = F.col("_key").cast(docs.schema[key].dataType)
    return out.select(back.alias(key), *_NAMES)
