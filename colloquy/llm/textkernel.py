"""Vectorised splitting and hashing of whole texts held in Arrow buffers.

Everything works on the UTF-8 bytes of a block of texts at once. Words are runs of bytes other than
ASCII white space (0x20, 0x09-0x0D), which in UTF-8 is the same as splitting the characters.
Memory follows the block: texts are taken in blocks of about ``BLOCK`` bytes, and hashing goes through
a block in segments, so that one very long text costs a small multiple of its own size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 21
_SEGMENT = 1 << 19
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = _U(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _SEGMENT)
        with np.errstate(over="ignore"):
            for k, p in enumerate((_P, _P_INV)):
                factors = np.full(size, p, dtype=_U)
                factors[0] = 1
                _powers[k:] = [np.cumprod(factors, dtype=_U)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def blocks(column: pa.Array, limit: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields ``(first_row, end_row, bytes, offsets)``: whole texts of about ``limit`` bytes a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offs = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + limit, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True in ``member`` that end at the borders of texts: ``(starts, ends, first run of each text)``."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before = np.zeros(n, bool)
    before[1:] = member[:-1]
    before[offs[:-1][offs[:-1] < n]] = False
    starts = np.flatnonzero(member & ~before)
    after = np.zeros(n, bool)
    after[:-1] = member[1:]
    after[offs[1:][offs[1:] > 0] - 1] = False
    ends = np.flatnonzero(member & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return runs(~SPACE[data], offs)


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, by a polynomial over prefix sums."""
    out = np.empty(len(starts), _U)
    i, n = 0, len(starts)
    with np.errstate(over="ignore"):
        while i < n:
            lo = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, lo + _SEGMENT, "right")))
            j = min(j, n)
            hi = int(ends[j - 1])
            power, inverse = _power_tables(hi - lo + 1)
            sums = np.zeros(hi - lo + 1, _U)
            np.cumsum(_BYTE[data[lo:hi]] * power[: hi - lo], out=sums[1:])
            s, e = starts[i:j] - lo, ends[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(_U) * _Q)
            i = j
    return out


def ngrams(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` and where each text's windows begin; a text with fewer has none."""
    count = np.maximum(np.diff(first) - n + 1, 0)
    where = np.zeros(len(first), np.int64)
    np.cumsum(count, out=where[1:])
    at = np.arange(where[-1]) + np.repeat(first[:-1] - where[:-1], count)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(at), _U)
        for j in range(n):
            acc = acc * _Q + hashes[at + j]
        return mix(acc + _U(n)), where


def whole(hashes: np.ndarray) -> int:
    """One hash of a whole sequence of hashes."""
    with np.errstate(over="ignore"):
        n = len(hashes)
        if not n:
            return 0
        weights = np.cumprod(np.full(n, _Q, _U), dtype=_U)
        return int(mix(np.array([np.sum(hashes * weights, dtype=_U) + _U(n)], _U))[0])


def expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indices ``start[i] .. start[i] + length[i] - 1`` for each i, one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.arange(total) + np.repeat(start - before, length)
