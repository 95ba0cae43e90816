"""Vectorised byte-level text primitives: words, rolling hashes, window minima.

Texts are handled as UTF-8 in blocks of a few megabytes: all texts of a block lie in one byte
array with a blank after each, so no word crosses a text.  A word's hash chains its eight-byte pieces
through a scramble.  Hashes of slices are polynomials modulo 2**64 over random values, taken from prefix
sums, so any slice's hash costs two look-ups; over bytes they only choose places and are never a verdict.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
BLOCK_BYTES = 1 << 20
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U64(0x9E3779B97F4A7C15)
_POS_BITS = U64(30)
_LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.cumprod(out, out=out)
    return out


_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))


class Rolling:
    """Hashes of any slices of one sequence of 64-bit values."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * powers(n), out=self.prefix[1:])
        self.inverse = powers(n + 1, _INVERSE)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def fixed(self, k: int) -> np.ndarray:
        """Hashes of all slices of length k."""
        m = max(0, len(self.prefix) - k)
        return mix((self.prefix[k : k + m] - self.prefix[:m]) * self.inverse[:m])


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]; other seeds give independent ones."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", buffer=padded.data, strides=(1,))
    length = end - start
    key = mix(np.array([seed], U64) + U64(0x2545F4914F6CDD1D))
    h = mix(key ^ length.astype(U64))
    mask = np.append((U64(1) << np.arange(0, 64, 8, dtype=U64)) - U64(1), U64(0xFFFFFFFFFFFFFFFF))
    todo = np.flatnonzero(length <= _LONG_WORD)
    at, rest = start[todo], length[todo]
    while len(todo):
        h[todo] = mix((h[todo] ^ (eight[at] & mask[np.minimum(rest, 8)])) * U64(0x9E3779B97F4A7C15) + key)
        more = rest > 8
        todo, at, rest = todo[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(length > _LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]], int(key[0]))
    return h


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice's bytes."""
    raw, f = data.tobytes(), xxhash.xxh3_64_intdigest
    return np.fromiter((f(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)), U64, len(start))


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES):
    """(first, last) index ranges of about ``limit`` bytes; a longer text stands alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if len(texts) > first:
        yield first, len(texts)


class Block:
    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
        self.length = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(self.length + 1) - 1
        self.start = self.end - self.length

    def words(self, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Byte starts and ends of all words, and the index of each text's first word (n texts + 1)."""
        inside = np.zeros(len(self.data) + 2, np.int8)
        inside[1:-1] = ~separator[self.data]
        inside[self.end + 1] = 0
        change = np.diff(inside)
        start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        first = np.searchsorted(start, np.append(self.start, len(self.data)))
        return start, end, first


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w hashes the position of its leftmost smallest one (ties by place, so by content)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key = ((h >> _POS_BITS) << _POS_BITS) | np.arange(len(h), dtype=U64)
    width = 1
    while width * 2 <= w:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < w:
        key = np.minimum(key[: len(key) - (w - width)], key[w - width :])
    return (key & ((U64(1) << _POS_BITS) - U64(1))).astype(np.int64)[:n]


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of the ranges first[i] .. first[i]+count[i]-1."""
    count = count.astype(np.int64)
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(first.astype(np.int64) - (ends - count), count)


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
