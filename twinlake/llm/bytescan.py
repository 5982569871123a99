"""Words of whole texts found in Arrow's own buffers: byte classes, prefix sums and word hashes as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are scanned at once: arrays of eight bytes a byte of text stand beside it.
STRIP = 1 << 20
#: Two odd bases of the word hash, and a mixer's factors (fixed values of a published 64-bit finaliser).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all places."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(_MIX[0])
    h ^= h >> np.uint64(33)
    h *= np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(33))


def table(of: str) -> np.ndarray:
    """Of every byte, whether it is one of ``of``."""
    out = np.zeros(256, bool)
    out[np.frombuffer(of.encode("latin-1"), np.uint8)] = True
    return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array without copies; a null text is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, off, data = texts.buffers()
    at = np.frombuffer(off, "<i8" if wide else "<i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8") if len(texts) else np.zeros(1, "i8")
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


def rows_by_bytes(offsets: np.ndarray, most: int = STRIP) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, or of one row that is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def words(gap: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of each run of bytes that are no ``gap``; no run crosses one of ``starts`` (first bytes of texts)."""
    word = ~gap
    head = word.copy()
    head[1:] &= gap[:-1]
    tail = word.copy()
    tail[:-1] &= gap[1:]
    starts = starts[(starts > 0) & (starts < len(gap))]
    head[starts] = word[starts]
    tail[starts - 1] = word[starts - 1]
    return np.flatnonzero(head), np.flatnonzero(tail) + 1


_POWERS: dict = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of a base and of its inverse, modulo 2^64."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        if size > 2 * STRIP:
            return both[0], both[1]
        held = _POWERS[base] = tuple(both)
    return held[0], held[1]


def hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of bytes, from one prefix sum over all of them; equal runs, equal hashes."""
    up, down = _powers(base, len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first])


def same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``a`` are those from ``b``, row by row; every size is over 0."""
    if not len(a):
        return np.zeros(0, bool)
    ends = np.cumsum(size)
    at = np.arange(ends[-1]) - np.repeat(ends - size, size)
    equal = data[np.repeat(a, size) + at] == data[np.repeat(b, size) + at]
    return np.logical_and.reduceat(equal, ends - size)
