"""Vectorised numpy kernels over the bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
#: Bytes that are worked on at a time (one text may be longer).
CHUNK = 1 << 21
#: Bytes whose range hashes are formed at once: bounds the tables of powers, whatever the longest text.
STEP = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64, len(column) + 1 + column.offset)[column.offset :] if offs else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INV)):
            full = np.full(size, base, U64)
            full[0] = 1
            _POWERS[k] = np.cumprod(full, dtype=U64)
    return _POWERS[0], _POWERS[1]


class RangeHash:
    """Hash of any byte range of a buffer in constant time (polynomial modulo 2**64)."""

    def __init__(self, raw: np.ndarray):
        up, self.down = _powers(len(raw) + 1)
        self.sums = np.empty(len(raw) + 1, U64)
        self.sums[0] = 0
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that don't cross texts: starts, ends and, per text, the first run's index."""
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    finish = inside.copy()
    finish[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(raw))]
    begin[edges] = inside[edges]
    finish[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = STEP) -> np.ndarray:
    """Hashes of byte ranges given in ascending order, about ``step`` bytes of ``raw`` at a time, whatever their length."""
    out = np.empty(len(starts), U64)
    for k in np.flatnonzero(ends - starts > step):
        # a range too long for the tables: its polynomial is put together from pieces
        total, factor = 0, 1
        for at in range(int(starts[k]), int(ends[k]), step):
            piece = raw[at : min(at + step, int(ends[k]))]
            total += int((_BYTE[piece] * _powers(step + 1)[0][: len(piece)]).sum(dtype=U64)) * factor
            factor = factor * pow(int(_BASE), step, 1 << 64) & ((1 << 64) - 1)
        out[k] = mix(np.array([total & ((1 << 64) - 1)], U64))[0]
    short = np.flatnonzero(ends - starts <= step)
    a, b = (starts, ends) if len(short) == len(starts) else (starts[short], ends[short])
    got = out if len(short) == len(starts) else np.empty(len(short), U64)
    at = 0
    while at < len(a):
        stop = max(at + 1, int(np.searchsorted(a, a[at] + step)))
        low, high = int(a[at]), int(b[at:stop].max())
        got[at:stop] = RangeHash(raw[low:high]).of(a[at:stop] - low, b[at:stop] - low)
        at = stop
    if got is not out:
        out[short] = got
    return out


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and, per text, the index of its first word (one more entry at the end)."""
    starts, ends, first = runs(raw, offsets, _WORD[raw])
    return hash_ranges(raw, starts, ends), first


def shingles(word: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word ``size``-grams; a text of fewer words has one shingle of all of them."""
    n = len(word)
    counts = np.diff(first)
    owner_end = np.repeat(first[1:], counts)
    at = np.arange(n)
    out = word.copy()
    factor = U64(1)
    for t in range(1, size):
        factor = U64((int(factor) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1))
        reach = at + t
        ok = reach < owner_end
        out += np.where(ok, word[np.minimum(reach, max(n - 1, 0))] * factor if n else word, U64(0))
    keep = (at + size <= owner_end) | ((np.repeat(first[:-1], counts) == at) & (np.repeat(counts, counts) < size))
    bounds = np.concatenate([[0], np.cumsum(np.where(counts >= size, counts - size + 1, np.minimum(counts, 1)))])
    return mix(out[keep]), bounds.astype(np.int64)


def reduceat(ufunc, values: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """``ufunc`` over values[bounds[i]:bounds[i + 1]], ``empty`` for empty ranges."""
    n = len(bounds) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    some = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(some):
        out[some] = ufunc.reduceat(values, bounds[some], axis=0)
    return out
