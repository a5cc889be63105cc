"""Words of many texts at once: hashes by prefix sums over an Arrow string column's bytes, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: An odd multiplier has an inverse modulo 2**64, which lets prefix sums stand for the hash of any stretch of bytes.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once (a longer text is worked on alone).
CHUNK = 1 << 20


class Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + (CHUNK >> 2))
            out = []
            for base in (BASE, _INVERSE):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                out.append(np.multiply.accumulate(p))
            self.up, self.down = out
        return self.up[:n], self.down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's bounds in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), bounds


def chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = min(n, max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1))
        yield first, last
        first = last


def prefix_hash(data: np.ndarray, powers: Powers) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.upto(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def words(data: np.ndarray, bounds: np.ndarray, powers: Powers, fold: bool, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Of consecutive texts (bounds from 0): the 64-bit hash of each word and the row that it is in.  fold: A-Z count as a-z.

    With prefixes, a row of hashes a word: its own and those of its first so many bytes (its own where it is no longer).
    """
    if not len(data):
        return np.zeros((0, 1 + len(prefixes)) if prefixes else 0, np.uint64), np.zeros(0, np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    if fold:
        data = data + ((data >= 65) & (data <= 90)) * np.uint8(32)
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([True], space[:-1])) | edge[:-1]
    after = np.concatenate((space[1:], [True])) | edge[1:]
    start, end = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    sums = prefix_hash(data, powers)
    down = powers.upto(len(data) + 1)[1]
    row = np.searchsorted(bounds, start, "right") - 1
    stretch = lambda to: mix((sums[to] - sums[start]) * down[start] + (to - start).astype(np.uint64))
    return np.stack([stretch(end), *(stretch(np.minimum(end, start + n)) for n in prefixes)], 1) if prefixes else stretch(end), row


def word_chunks(column: pa.Array, powers: Powers, fold: bool, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, word hashes, row of each word from the first) of each run of rows."""
    data, bounds = buffers(column)
    for a, b in chunks(bounds):
        own = bounds[a : b + 1]
        h, row = words(data[own[0] : own[-1]], own - own[0], powers, fold, prefixes)
        yield a, b, h, row
