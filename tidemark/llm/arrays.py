"""Numpy helpers for tasks: words and their hashes from Arrow strings, and packed sorted keys.

Words are runs of bytes other than space and ``\\x09-\\x0D``. A batch of texts is handled as one
byte buffer, so the cost is a few vector steps a batch and no step a word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, padded
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    bounds: np.ndarray  # text i has the words bounds[i] to bounds[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def texts(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def find_words(texts: pa.Array | pa.ChunkedArray) -> Words:
    """The words of every text; a null text has none."""
    column = pa.chunked_array(texts) if not isinstance(texts, (pa.Array, pa.ChunkedArray)) else texts
    if isinstance(column, pa.ChunkedArray):
        parts = [c.cast(pa.large_string()) for c in column.chunks]
        column = pa.concat_arrays(parts) if parts else pa.array([], pa.large_string())
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(8, np.uint8), none, none, np.zeros(1, np.int64))
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, count=column.offset + n + 1)[column.offset:]
    size = int(at[-1] - at[0])
    raw = np.zeros(size + 16, np.uint8)
    if size:
        raw[:size] = np.frombuffer(data, np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    space = _SPACE[raw[:size]]
    before = np.empty(size, bool)  # a word may start here
    before[1:] = space[:-1]
    before[at[:-1][at[:-1] < size]] = True
    after = np.empty(size, bool)  # a word may end with this byte
    after[:-1] = space[1:]
    inner = at[1:][at[1:] > 0] - 1
    after[inner] = True
    word = ~space
    starts = np.flatnonzero(word & before)
    ends = np.flatnonzero(word & after) + 1
    return Words(raw, starts, ends, np.searchsorted(starts, at))


SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, *names: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text in the columns ``names``; a longer text is one alone.

    A task's memory is then bounded by the longest text, not by the rows of an Arrow batch.
    """
    size = sum(pc.fill_null(pc.binary_length(batch.column(n)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for n in names)
    run = np.cumsum(size + 64) // most
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """64 bits for each word, from all its bytes and its length."""
    lanes = np.lib.stride_tricks.as_strided(words.data[:-8].view(np.uint8), (len(words.data) - 8, 8), (1, 1))
    size = words.ends - words.starts
    h = mix(size.astype(np.uint64) + np.uint64(seed) * _STEP + _STEP)
    which, lane = np.arange(len(size)), 0
    while len(which):
        left = size[which] - 8 * lane
        value = lanes[words.starts[which] + 8 * lane].reshape(-1).view("<u8").copy()
        short = left < 8
        value[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[which] = mix(h[which] * _M2 + value)
        which, lane = which[left > 8], lane + 1
    return h


def ngrams(hashes: np.ndarray, order: int) -> np.ndarray:
    """A hash for the ``order`` words that start at each place (also across text borders)."""
    n = len(hashes) - order + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, order, np.uint64)
    for k in range(order):
        h = mix(h * _M1 + hashes[k:k + n])
    return h


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash modulo 2**64 of each window of ``width`` words, then mixed.

    Prefix sums of ``hash[i] * base**i`` give each window's value with one subtraction; the odd
    base has an inverse, which takes the start's power out again.
    """
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    base = 0x2545F4914F6CDD1D
    up = np.full(n, base, np.uint64)
    up[0] = 1
    np.cumprod(up, out=up)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    down = np.full(n - width + 1, pow(base, -1, 1 << 64), np.uint64)
    down[0] = 1
    np.cumprod(down, out=down)
    return mix((total[width:] - total[:-width]) * down)


def starts_within(words: Words, width: int) -> np.ndarray:
    """Words at which ``width`` consecutive words of one text start."""
    n = len(words.starts)
    left = np.repeat(words.bounds[1:], words.counts()) - np.arange(n)
    return np.flatnonzero(left >= width)


def pack(values: np.ndarray, squeeze: bool = False) -> bytes:
    """Unsigned numbers as a width byte and that many bytes each; ``squeeze`` for few distinct ones."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T  # bytes of one weight together: most are zero
    return bytes([width]) + (zlib.compress(planes.tobytes(), 6) if squeeze else planes.tobytes())


def unpack(blob: bytes, squeezed: bool = False) -> np.ndarray:
    width, body = blob[0], zlib.decompress(blob[1:]) if squeezed else blob[1:]
    planes = np.frombuffer(body, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<u8").astype(np.uint64, copy=False)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences; the upper byte of these is squeezed, as small values are the most common."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    planes = np.ascontiguousarray(steps, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    coder = zlib.compressobj(1, zlib.DEFLATED, -15, 9, zlib.Z_HUFFMAN_ONLY)
    top = coder.compress(planes[-1].tobytes()) + coder.flush()
    return bytes([width]) + len(steps).to_bytes(4, "little") + planes[:-1].tobytes() + top


def unpack_sorted(blob: bytes) -> np.ndarray:
    width, n = blob[0], int.from_bytes(blob[1:5], "little")
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width - 1] = np.frombuffer(blob, np.uint8, (width - 1) * n, 5).reshape(width - 1, n).T
        out[:, width - 1] = np.frombuffer(zlib.decompress(blob[5 + (width - 1) * n:], -15), np.uint8)
    return np.cumsum(out.reshape(-1).view("<u8").astype(np.uint64, copy=False), dtype=np.uint64)
