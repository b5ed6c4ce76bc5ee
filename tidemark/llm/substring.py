"""Substring deduplication: every word under a window that the corpus holds twice goes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import find_words, rolling, starts_within, word_hashes
from tidemark.llm.exchange import CHUNK_BYTES, dealt, with_totals

WINDOW = 35


def _runs(marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.diff(marked.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def remove_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """Each row's words without those that a repeated window covers.

    Windows of ``window`` consecutive words of one text get Rabin-Karp hashes (64 bits); Spark counts
    them over the corpus, and repeated windows of a text merge into maximal intervals. All windows
    are judged on the input. Returns key, n_words, n_removed, intervals (array of word ranges, end
    excluded) and kept (the words left, joined by one space), one row for each input row.

    Null and empty texts, and texts shorter than a window, have no window and lose nothing. Repeated
    rows repeat all their windows. Other columns are not carried. Two different windows share a hash
    with probability 2**-64 a pair.
    """
    picked = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    corpus = dealt(picked, "_text", chunk_bytes)
    kind = docs.schema[key].dataType.simpleString()

    def hashes(table: pa.Table) -> np.ndarray:
        words = find_words(table["_text"])
        return rolling(word_hashes(words), window)[starts_within(words, window)]

    def finish(table: pa.Table, ids: np.ndarray, totals: np.ndarray, mass: int) -> pa.Table:
        words = find_words(table["_text"])
        again = starts_within(words, window)[totals[ids] > 1]
        n = len(words.starts)
        depth = np.zeros(n + 1, np.int64)
        np.add.at(depth, again, 1)
        np.add.at(depth, again + window, -1)
        gone = np.cumsum(depth[:n]) > 0
        kept, removed, spans = [], [], []
        raw = words.data.tobytes()
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            mark = gone[a:b]
            removed.append(int(mark.sum()))
            pieces = [raw[s:e] for s, e in zip(words.starts[a:b][~mark].tolist(), words.ends[a:b][~mark].tolist())]
            kept.append(b" ".join(pieces).decode("utf-8", "surrogateescape"))
            spans.append([{"start": int(s), "end": int(e)} for s, e in zip(*_runs(mark))])
        return pa.table(
            {
                key: table["_id"],
                "n_words": pa.array(words.counts(), pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "intervals": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "kept": pa.array(kept, pa.string()),
            }
        )

    schema = f"`{key}` {kind}, n_words long, n_removed long, intervals array<struct<start: long, end: long>>, kept string"
    return with_totals(corpus, lambda t: (hashes(t), 0), finish, schema, most=2)
