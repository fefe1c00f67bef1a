"""Words, word hashes and word windows of whole record batches in numpy.

A batch of texts is one byte buffer with offsets. Everything here works on that buffer at once: word
bounds are found by comparing neighbouring bytes, word hashes are differences of one running sum, and
windows are sums of shifted word hashes. No Python object is made per word.

A word is a run of bytes other than space and ``\\x09-\\x0D``; in UTF-8 these bytes stand for
themselves alone, so words are never cut inside a character. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
"""Texts are scanned in slices of about this many bytes (more where one text is longer), so that
memory follows the slice and not the record batch."""
KEPT_BYTES = 1 << 20
"""Powers of the hash bases are kept for slices of up to this many bytes."""

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _fixed(seed: int, count: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**63, count, dtype=U64) | U64(1)


_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95))
_BYTE = [_fixed(11, 256), _fixed(12, 256)]
_PLACE = [_fixed(13, 256), _fixed(14, 256)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(which: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse modulo 2**64."""
    have = _powers.get(which)
    if have is None or len(have[0]) < count:
        size = max(count, SLICE_BYTES + 1)
        base = int(_BASES[which])
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, dtype=U64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        have = (pair[0], pair[1])
        if size <= KEPT_BYTES + 1:
            _powers[which] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


class Texts:
    """Word bounds of consecutive texts in one buffer.

    ``start`` and ``end`` are byte bounds of each word, ``doc`` the number of its text, and
    ``first[d]:first[d + 1]`` the words of text ``d``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        n = len(data)
        if n == 0:
            self.start = self.end = self.doc = np.zeros(0, dtype=np.int64)
            self.first = np.zeros(len(offsets), dtype=np.int64)
            return
        space = _SPACE[data]
        cuts = offsets[(offsets > 0) & (offsets < n)]
        begins = np.empty(n, dtype=bool)
        begins[0] = True
        begins[1:] = space[:-1]
        begins[cuts] = True
        stops = np.empty(n, dtype=bool)
        stops[-1] = True
        stops[:-1] = space[1:]
        stops[cuts - 1] = True
        solid = ~space
        self.start = np.flatnonzero(begins & solid)
        self.end = np.flatnonzero(stops & solid) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word; ``which`` picks one of two independent functions."""
        return self.spans(self.start, self.end, which, lower)

    def spans(self, start: np.ndarray, end: np.ndarray, which: int = 0, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        n = len(self.data)
        power, inverse = _powers_of(which, n + 1)
        data = _LOWER[self.data] if lower else self.data
        run = np.zeros(n + 1, dtype=U64)
        np.cumsum(_BYTE[which][data] * power[:n], out=run[1:])
        return mix((run[end] - run[start]) * inverse[start])

    def inside(self, width: int) -> np.ndarray:
        """For each word but the last ``width - 1``: whether ``width`` words from it on are of one text."""
        m = len(self.doc) - width + 1
        return self.doc[:m] == self.doc[width - 1:] if m > 0 else np.zeros(0, dtype=bool)


def windows(words: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``width`` consecutive words, also across texts (see ``Texts.inside``)."""
    m = len(words) - width + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    total = np.zeros(m, dtype=U64)
    for j in range(width):
        total += words[j:j + m] * _PLACE[which][j % 256] + U64(j)
    return mix(total)


def slices(column: pa.Array | pa.ChunkedArray, limit: int | None = None) -> Iterator[tuple[int, int, Texts]]:
    """Cut a column of strings or binaries into runs of texts: first row, row after the last, texts."""
    limit = limit or SLICE_BYTES
    at = 0
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if pa.types.is_large_string(chunk.type) or pa.types.is_large_binary(chunk.type):
            kind = np.int64
        else:
            kind = np.int32
        _, places, buffer = chunk.buffers()
        n = len(chunk)
        if n == 0:
            continue
        bounds = np.frombuffer(places, dtype=kind)[chunk.offset:chunk.offset + n + 1].astype(np.int64)
        data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
        row = 0
        while row < n:
            to = int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1
            to = min(max(to, row + 1), n)
            yield at + row, at + to, Texts(data[bounds[row]:bounds[to]], bounds[row:to + 1] - bounds[row])
            row = to
        at += n


def count_points(data: np.ndarray) -> np.ndarray:
    """Running number of characters that begin before each byte (one more entry than bytes)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def byte_runs(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of consecutive texts of about ``limit`` bytes: first row, row after the last, bytes, bounds."""
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, places, buffer = column.buffers()
    count = len(column)
    if not count:
        return
    bounds = np.frombuffer(places, dtype=kind)[column.offset:column.offset + count + 1].astype(np.int64)
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < count:
        to = min(max(int(np.searchsorted(bounds, bounds[row] + limit, side="right")) - 1, row + 1), count)
        yield row, to, data[bounds[row]:bounds[to]], bounds[row:to + 1] - bounds[row]
        row = to
