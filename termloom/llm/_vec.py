"""Vectorised text primitives over Arrow buffers, shared by the operators of this subpackage.

Words are found and hashed on the raw UTF-8 bytes with numpy, so that no Python object is made per word.
A word's hash is a 64-bit polynomial over a random byte table, finalised with its length; sequences of words
are hashed in the same way over word hashes. Two seeds give two independent hashes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time; it bounds memory, not results.
SLICE_BYTES = 4 << 20
#: The same where many arrays are made of each word.
SMALL_SLICE = 2 << 20
#: Bytes or words that are hashed at a time, which bounds the tables of powers.
STRETCH = 1 << 18
_U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


_RANDOM = [np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1) for seed in (11, 23)]
_LOWER = np.arange(256)
_LOWER[65:91] += 32

#: Bytes that separate words: space and 09-0D.
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[32, *range(9, 14)]] = True
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    size = 1 << max(12, int(n + 1).bit_length())
    have = _powers.get((base, 0))
    if have is None or len(have) <= n:
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = _powers[(base, 0)] = np.multiply.accumulate(p)
    return have


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each slice holds about ``budget`` bytes of text, or one row. Behind the last one memory that isn't used goes back to the system, as workers live on."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        cum = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < n:
            base = cum[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(cum, base + budget, "right")))
            yield b.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return what Arrow's and C's allocators hold without use (where the C library can)."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def word_spans(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and the number of words before each row (one more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inner = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = edge[:n].copy()
    before[1:] |= ~inner[:-1]
    after = edge[1:].copy()
    after[:-1] |= ~inner[1:]
    starts, ends = np.flatnonzero(inner & before), np.flatnonzero(inner & after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the byte spans (in order and disjoint), a stretch of bytes at a time."""
    out = np.empty(len(starts), np.uint64)
    table = _RANDOM[seed][_LOWER] if lower else _RANDOM[seed]
    base, a = _BASES[seed], 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + STRETCH, "right")))
        lo, hi = int(starts[a]), int(ends[b - 1])
        p = _power(base, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(table[data[lo:hi]] * p[: hi - lo], out=sums[1:])
        s, e = starts[a:b] - lo, ends[a:b] - lo
        q = _power(_inverse(base), hi - lo)
        out[a:b] = (sums[e] - sums[s]) * q[s] + (e - s).astype(np.uint64) * _U(0x165667B19E3779F9)
        a = b
    return _mix(out)


def window_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of words[i:i+k] for every i with room for it (rows not yet told apart)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASES[seed]
    out, step = np.empty(n, np.uint64), STRETCH
    for a in range(0, n, step):
        m = min(step, n - a)
        sums = np.zeros(m + k, np.uint64)
        np.cumsum(words[a : a + m + k - 1] * _power(base, m + k)[: m + k - 1], out=sums[1:])
        out[a : a + m] = (sums[k : k + m] - sums[:m]) * _power(_inverse(base), m)[:m]
    return _mix(out)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of words[start:end] for each pair; spans may overlap."""
    base, n = _BASES[seed], len(words)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _power(base, n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_inverse(base), n)[starts]
    return _mix(h + (ends - starts).astype(np.uint64) * _U(0x27D4EB2F165667C5))


def binary_array(data: np.ndarray, offs: np.ndarray, kind: pa.DataType = pa.binary()) -> pa.Array:
    """Arrow binary (or string) array over contiguous bytes."""
    return pa.Array.from_buffers(kind, len(offs) - 1, [None, pa.py_buffer(offs.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each row, concatenated."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.repeat(starts - first, lengths) + np.arange(total)
