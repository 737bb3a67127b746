"""Vectorised work on batches of texts as one run of UTF-8 bytes.

A batch of texts is held as ``data`` (uint8, all texts end to end) and ``offs`` (int64, one more than texts).
Words are maximal runs of bytes other than space and \\t \\n \\v \\f \\r; no multi-byte character holds such a byte, so bytes are enough.
Equal runs of bytes get equal 64-bit hashes wherever they stand: short ones by mixing their eight-byte lanes one after the other, which is a bijection
of each lane (so up to eight bytes equal lengths never collide), long ones by BLAKE2b. ``distinct`` compares the bytes as well.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Runs of up to so many bytes are hashed by lanes.
SHORT_BYTES = 128
#: Runs that are hashed at once.
_AT_ONCE = 1 << 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def release() -> None:
    """Gives memory that a Python worker has freed back to the system; workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        return


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """data and offs of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not any(f(column.type) for f in (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)):
        column = column.cast(pa.string())
    if column.null_count:
        column = pc.fill_null(column, "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs of whole texts of about ``limit`` bytes: (first, last, data, offs). A longer text stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lowered(data: np.ndarray) -> np.ndarray:
    """data with A-Z lower-cased."""
    return _LOWER[data]


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as one number."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of bytes."""
    out = np.empty(len(starts), np.uint64)
    view, raw = _lanes(data), memoryview(np.ascontiguousarray(data))
    for lo in range(0, len(starts), _AT_ONCE):
        at, left = starts[lo : lo + _AT_ONCE], (ends - starts if len(starts) <= _AT_ONCE else ends[lo : lo + _AT_ONCE] - starts[lo : lo + _AT_ONCE])
        part = out[lo : lo + _AT_ONCE]
        part[:] = left.astype(np.uint64) * _GOLDEN
        for i in np.flatnonzero(left > SHORT_BYTES).tolist():
            part[i] = int.from_bytes(hashlib.blake2b(raw[at[i] : at[i] + left[i]], digest_size=8).digest(), "little")
        own = np.flatnonzero((left > 0) & (left <= SHORT_BYTES))
        at, left, h = at[own], left[own], part[own]
        while len(own):
            h = mix((h ^ (view[at] & _LANE[np.minimum(left, 8)])) + _GOLDEN)
            part[own] = h
            more = left > 8
            own, at, left, h = own[more], at[more] + 8, left[more] - 8, h[more]
    return out


def equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each run has the bytes of the run with the number in ``other``."""
    size = ends - starts
    same = size == size[other]
    view, raw = _lanes(data), memoryview(np.ascontiguousarray(data))
    own = np.flatnonzero(same & (other != np.arange(len(starts))))
    for i in own[size[own] > SHORT_BYTES].tolist():
        a, b, n = int(starts[i]), int(starts[other[i]]), int(size[i])
        same[i] = raw[a : a + n] == raw[b : b + n]
    own = own[size[own] <= SHORT_BYTES]
    a, b, left = starts[own], starts[other[own]], size[own]
    while len(own):
        good = ((view[a] ^ view[b]) & _LANE[np.minimum(left, 8)]) == 0
        same[own[~good]] = False
        more = good & (left > 8)
        own, a, b, left = own[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct run of bytes a run that has them, and every run's number among these. Equal means the same bytes, not the same hash."""
    _, first, which = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
    if not equal(data, starts, ends, first[which]).all():
        number: dict[bytes, int] = {}
        raw = data.tobytes()
        which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(which, return_index=True)[1]
    return first, which


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the offsets of each text's words."""
    n = len(data)
    solid = np.zeros(n + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    fresh = np.zeros(n + 1, bool)  # a text begins here
    fresh[offs] = True
    inside = solid[1:-1]
    starts = np.flatnonzero(inside & (~solid[:-2] | fresh[:-1]))
    ends = np.flatnonzero(inside & (~solid[2:] | fresh[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def owners(offs: np.ndarray) -> np.ndarray:
    """For each element its text's number within the chunk."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of flags over each text's elements."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]
