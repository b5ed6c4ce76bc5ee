"""Stupid-backoff scores of documents under the n-gram counts of the other documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import find_words, ngrams, starts_within, word_hashes
from tidemark.llm.exchange import CHUNK_BYTES, dealt, with_totals

ORDER = 3
BACKOFF = 0.4


def key_bits(total_bytes: int, order: int) -> int:
    """Bits that give two to the 20th keys for each n-gram of the corpus, up to 64; a word takes five bytes or so.

    Only a measure: :func:`score_documents` uses all 64 bits at any size, as n-grams whose keys agree share their counts.
    """
    return min(64, 20 + max(1, total_bytes // 5 * order).bit_length())


def score_documents(
    docs: DataFrame, text: str = "text", key: str = "doc_id", order: int = ORDER, backoff: float = BACKOFF,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """Log score of every document: key, n_words, n_backoff, log10_score, log10_per_word.

    The score of a word after its history of up to ``order - 1`` words of the same text is
    ``count(history + word) / count(history)`` where the n-gram occurs, else ``backoff`` times the
    score with one history word less; an unseen word gets ``backoff / N``-like mass
    ``1 / (N + 1)``. Counts run over all rows less those of the scored row itself (``N``: words of
    all other rows), so that a text does not vouch for itself. ``n_backoff`` counts steps down.

    Null and empty texts score 0.0 over no words, with a null log10_per_word. Each input row is a
    document, also where keys repeat: repeated rows vouch for one another. Count tables are split by
    hash; n-grams are told apart by all 64 bits of it.
    """
    picked = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    corpus = dealt(picked, "_text", chunk_bytes)

    def grams(table: pa.Table):
        words = find_words(table["_text"])
        hashes = word_hashes(words)
        return words, [
            (at := starts_within(words, n), ngrams(hashes, n)[at]) for n in range(1, order + 1)
        ]

    def keys(table: pa.Table) -> tuple[np.ndarray, int]:
        words, levels = grams(table)
        return np.concatenate([k for _, k in levels]), len(words.starts)

    def finish(table: pa.Table, ids: np.ndarray, totals: np.ndarray, all_words: int) -> pa.Table:
        words = find_words(table["_text"])
        n, doc = len(words.starts), words.texts()
        lens = words.counts()
        others = np.maximum(all_words - lens, 0)[doc].astype(float)
        counts: list[np.ndarray] = []  # by order, at the n-gram's first word; 0 where none starts
        first = 0
        for size in range(1, order + 1):
            at = starts_within(words, size)
            where, first = ids[first:first + len(at)], first + len(at)
            pair = doc[at].astype(np.uint64) * np.uint64(len(totals)) + where.astype(np.uint64)
            _, back, own = np.unique(pair, return_inverse=True, return_counts=True)
            c = np.zeros(n)
            c[at] = totals[where].astype(float) - own[back]
            counts.append(c)
        place = np.arange(n) - words.bounds[:-1][doc]  # of a word in its text
        score = np.zeros(n)
        open_, factor, steps = np.ones(n, bool), np.ones(n), np.zeros(n, np.int64)
        for m in range(order, 0, -1):
            here = np.flatnonzero(open_ & (place >= m - 1))
            c = counts[m - 1][here - (m - 1)]
            hit = c > 0
            base = counts[m - 2][here - (m - 1)][hit] if m > 1 else others[here][hit]
            score[here[hit]] = np.log10(factor[here[hit]] * c[hit] / base)
            open_[here[hit]] = False
            factor[here[~hit]] *= backoff
            steps[here[~hit]] += 1
        score[open_] = np.log10(factor[open_] / (others[open_] + 1))
        docs_n = len(lens)
        sums = np.bincount(doc, weights=score, minlength=docs_n)
        return pa.table(
            {
                key: table["_id"],
                "n_words": pa.array(lens, pa.int64()),
                "n_backoff": pa.array(np.bincount(doc, weights=steps, minlength=docs_n).astype(np.int64)),
                "log10_score": pa.array(sums),
                "log10_per_word": pa.array(sums / np.maximum(lens, 1), mask=lens == 0),
            }
        )

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_words long, n_backoff long, log10_score double, log10_per_word double"
    return with_totals(corpus, keys, finish, schema)
