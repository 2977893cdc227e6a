"""Whole texts as one array of bytes: words, their hashes and spans by numpy, without a Python string a word.

Hashes are 64-bit: a polynomial over a fixed table of byte values, modulo 2**64, then mixed with the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20260101)
#: Value of each byte; the base is odd, so it has an inverse modulo 2**64.
VALUES = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are looked at together; a longer document is looked at alone.
SLICE = 2 << 20
#: Powers that are made at least.
FEW_POWERS = 1 << 18

_powers = {"up": np.ones(1, U), "down": np.ones(1, U)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, kept while at most four slices long; few until more than FEW_POWERS are wanted."""
    if len(_powers["up"]) < n:
        inverse, size = pow(BASE, -1, 1 << 64), FEW_POWERS if n <= FEW_POWERS else max(n, SLICE + 1)
        out = []
        for b in (BASE, inverse):
            x = np.full(size, b, U)
            x[0] = 1
            out.append(np.cumprod(x, dtype=U))
        if size > 4 * SLICE:
            return out[0][:n], out[1][:n]
        _powers["up"], _powers["down"] = out
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts(NamedTuple):
    """Some documents: first row in the batch, their bytes one after the other, and offsets (one more than documents)."""

    row: int
    data: np.ndarray
    offsets: np.ndarray


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Texts]:
    """The documents of a batch, in slices of about size bytes."""
    data, offsets = flat(column)
    row, n = 0, len(offsets) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield Texts(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with h[i] the sum over data[:i]; span_hashes() takes differences."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum(VALUES[data] * up, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start] + (stop - start).astype(U) * U(0xD6E8FEB86659FD93))


class Words(NamedTuple):
    """The words of a slice in order: spans in data (which is lower-cased), and for each document the place of its first word (and the end)."""

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        return span_hashes(prefix_hashes(self.data), self.start, self.stop)


def words(texts: Texts, lower: bool = True) -> Words:
    data = LOWER[texts.data] if lower else texts.data
    n = len(data)
    solid = ~IS_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    edge = texts.offsets[:-1]
    edge = edge[edge < n]
    begins[edge] = solid[edge]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = texts.offsets[1:] - 1
    last = last[last >= 0]
    ends[last] = solid[last]
    start = np.flatnonzero(begins)
    return Words(data, start, np.flatnonzero(ends) + 1, np.searchsorted(start, texts.offsets))


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (length[0] of them), start[1], ..."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(length)
    return np.arange(total) + np.repeat(start - (ends - length), length)


def gather(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans one after the other, and their offsets."""
    length = stop - start
    return data[ranges(start, length)], np.concatenate(([0], np.cumsum(length)))


def strings(data: np.ndarray, offsets: np.ndarray) -> list[str]:
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))).to_pylist()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the place of one of each, and the place in the distinct keys of every key."""
    if not len(keys):
        return keys, np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.empty(len(keys), bool)
    new[0] = True
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    inverse = np.empty(len(keys), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ranked[new], order[new], inverse
