"""Whole-batch word hashing in numpy for the Arrow-side operators.

A batch's texts lie one after another in Arrow's data buffer, so words, word
hashes and hashes of word runs are computed for all its documents at once,
without a Python object per word.

Words are the maximal runs of bytes outside ``[\\x20\\x09-\\x0D]``, unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []

#: Batches go through in pieces of about this many bytes, so memory stays bounded; one text may be longer.
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; wraps modulo 2**64."""
    x = x ^ U((seed * 0xD6E8FEB86659FD93 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]), dtype=U) for b in (_BASE, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut at rows so that each holds about `most` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = texts(batch.column(column))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


class Words:
    """Words of several texts: byte range and hash of each word, and each text's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, n = data, len(data)
        dark = np.ones(n + 2, bool)  # white space, and a white border on both sides
        dark[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
        step = dark[1:] != dark[:-1]
        # a text's border ends a word, too
        inner = offsets[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < n)])  # once, where empty texts lie between
        cut = inner[~dark[inner] & ~dark[inner + 1]]
        edges = np.flatnonzero(step)
        if len(cut):
            edges = np.sort(np.concatenate([edges, cut, cut]), kind="stable")
        self.start, self.end = edges[0::2], edges[1::2]
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum((data.astype(U) + U(1)) * up[:n], dtype=U, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U))
        self.first = np.searchsorted(self.start, offsets)  # text i has words first[i] to first[i + 1]
        self.count = np.diff(self.first)

    def runs(self, length: int, seed: int = 1) -> np.ndarray:
        """Hash of the `length` words from each word on (it may cross into the next text); fewer than words by length - 1."""
        n = len(self.hash) - length + 1
        if n <= 0:
            return np.empty(0, U)
        up, down = _powers(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, U)
        np.cumsum(mix(self.hash, seed) * up[: len(self.hash)], dtype=U, out=sums[1:])
        return mix((sums[length:] - sums[:-length]) * down[:n], seed)
