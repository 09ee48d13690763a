"""Vectorised text primitives shared by the operators: whole Arrow batches are hashed with numpy, no per-word Python.

A *word* is a maximal run of bytes other than ASCII white space. Word and n-gram hashes are 64-bit polynomial hashes
(odd base, arithmetic modulo 2**64) finished with an avalanche mix, so they are the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash; x is left alone."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, n of each at least; kept per worker."""
    if len(_POW[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    return _POW


def spans_hasher(values: np.ndarray):
    """A function of starts and ends: the hash of values[s:e] for each span, in time independent of the spans' lengths."""
    power, inverse = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return lambda starts, ends: mix64((sums[ends] - sums[starts]) * inverse[starts])


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return spans_hasher(values)(starts, ends)


class Piece:
    """Some rows of a batch: their bytes end to end, the words in them and the row each word is in."""

    def __init__(self, rows: pa.RecordBatch, text: pa.Array, folded: bool = False):
        self.rows = rows
        if not pa.types.is_large_string(text.type):
            text = text.cast(pa.large_string())
        if text.null_count:
            text = text.fill_null("")
        buffers = text.buffers()
        at = np.frombuffer(buffers[1], np.int64, len(text) + 1, text.offset * 8)
        self.offsets = at - at[0]
        size = int(at[-1] - at[0])
        self.data = np.frombuffer(buffers[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)

    def words(self) -> None:
        """Sets starts, ends (byte positions), row (of each word) and first (of each row, and one more: its first word)."""
        word = ~WHITE[self.data]
        edge = np.empty(len(word) + 1, bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[0] = edge[-1] = False
        begin, finish = np.zeros(len(word) + 1, bool), np.zeros(len(word) + 1, bool)
        begin[:-1], finish[1:] = word, word
        cuts = self.offsets[1:-1]
        joined = np.zeros(len(word) + 1, bool)
        joined[1:-1] = word[1:] & word[:-1]
        joined[cuts[(cuts > 0) & (cuts < len(word))]] = False
        self.starts = np.flatnonzero(begin & ~joined)
        self.ends = np.flatnonzero(finish & ~joined)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.row = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))

    def word_hashes(self) -> np.ndarray:
        return spans_hash(self.data, self.starts, self.ends)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row] : self.offsets[row + 1]].tobytes()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = PIECE_BYTES) -> Iterator[Piece]:
    """Cuts batches between rows into pieces of about `size` bytes of text; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())
        at = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        begin = 0
        while begin < len(text):
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + size, "right")) - 1)
            yield Piece(batch.slice(begin, end - begin), text.slice(begin, end - begin))
            begin = end


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position, as far as n words are left."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = words[:count].copy()
    for k in range(1, n):
        total *= _BASE
        total += words[k : k + count]
    return mix64(total)


def window_min(values: np.ndarray, width: int, op=np.minimum, pad=None) -> np.ndarray:
    """op over values[i:i+width] for each i with a whole window, in two passes over blocks."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values.copy()
    fill = pad if pad is not None else np.iinfo(values.dtype).max
    size = -(-len(values) // width) * width
    v = np.full(size, fill, values.dtype)
    v[: len(values)] = values
    v = v.reshape(-1, width)
    left = op.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    right = op.accumulate(v, axis=1).ravel()
    return op(left[:n], right[width - 1 : width - 1 + n])


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
