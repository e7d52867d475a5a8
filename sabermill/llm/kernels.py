"""Vectorised byte kernels over Arrow string columns: words, hashes, runs.

All of them work on the UTF-8 buffer of a batch of texts, in slices of bounded size, so memory does
not depend on how many rows a batch has; only one text that is longer than a slice exceeds it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes between words: space and \x09-\x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Gives freed memory back to the system at a task's end: Python workers live on and would hold it beside the next stage's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every libc has it
        ctypes.CDLL(None).malloc_trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64, count=n + 1, offset=8 * column.offset)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0]
    return raw[first : offsets[-1]], offsets - first


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; a run never crosses an offset."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(inside))]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def squeeze(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of each text joined by one space, and one space after each text's last word.

    Returns (squeezed bytes, word starts there, word ends there, words before each text, word starts in ``buf``).
    """
    starts, ends = runs(~separators[buf], offsets)
    first = np.searchsorted(starts, offsets)
    lens = ends - starts
    new_ends = np.cumsum(lens + 1) - 1
    new_starts = new_ends - lens
    out = np.full(int(new_ends[-1]) + 1 if len(lens) else 0, 0x20, np.uint8)
    if len(lens):
        keep = np.zeros(len(buf) + 1, np.int8)
        keep[starts] += 1
        keep[ends] -= 1
        filled = np.ones(len(out), bool)
        filled[new_ends] = False
        out[filled] = buf[np.cumsum(keep[:-1], dtype=np.int8).view(bool)]
    return out, new_starts, new_ends, first, starts


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``buf[start:start + len]``; equal lengths are hashed together, lane by lane."""
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    raw = np.concatenate([np.ascontiguousarray(buf), np.zeros(8, np.uint8)])
    u64 = np.ndarray(len(raw) - 7, "<u8", raw.data, strides=(1,))
    u32 = np.ndarray(len(raw) - 3, "<u4", raw.data, strides=(1,))
    short = np.minimum(lens, 65535).astype(np.uint16)
    order = np.argsort(short, kind="stable")
    ordered = short[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    with np.errstate(over="ignore"):
        for group in np.split(order, cuts):
            size = int(lens[group[0]])
            if size > 512 or (size > 64 and len(group) < 16):
                view = memoryview(raw)
                for i in group:
                    out[i] = xxhash.xxh64_intdigest(view[starts[i] : starts[i] + lens[i]], seed)
                continue
            for at in range(0, len(group), 1 << 15):
                part = group[at : at + (1 << 15)]
                out[part] = _xxh64_equal(u64, u32, raw, starts[part], size, np.uint64(seed))
    return out


def _xxh64_equal(u64: np.ndarray, u32: np.ndarray, raw: np.ndarray, at: np.ndarray, size: int, seed: np.uint64) -> np.ndarray:
    p, left = at.copy(), size
    if size >= 32:
        acc = [np.full(len(at), x, np.uint64) for x in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
        while left >= 32:
            for k in range(4):
                acc[k] = _round(acc[k], u64[p + 8 * k])
            p += 32
            left -= 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for k in range(4):
            h = (h ^ _round(np.zeros(len(at), np.uint64), acc[k])) * _P1 + _P4
    else:
        h = np.full(len(at), seed + _P5, np.uint64)
    h = h + np.uint64(size)
    while left >= 8:
        h = _rotl(h ^ _round(np.zeros(len(at), np.uint64), u64[p]), 27) * _P1 + _P4
        p += 8
        left -= 8
    if left >= 4:
        h = _rotl(h ^ (u32[p].astype(np.uint64) * _P1), 23) * _P2 + _P3
        p += 4
        left -= 4
    while left:
        h = _rotl(h ^ (raw[p].astype(np.uint64) * _P5), 11) * _P1
        p += 1
        left -= 1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the ``size``-word shingles of each lower-cased text, repeats included.

    A text of fewer words has one shingle of all of them, one of no words has none.
    Returns (hashes in text order, shingles before each text, words of each text).
    """
    text, starts, ends, first, _ = squeeze(LOWER[buf], offsets, SPACES)
    words = np.diff(first)
    count = np.where(words == 0, 0, np.maximum(words - size + 1, 1))
    before = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(words)), count)
    at = np.arange(before[-1]) - before[doc] + first[doc]
    to = np.minimum(at + size, first[doc + 1]) - 1
    return xxh64(text, starts[at], ends[to] - starts[at], seed), before, words


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
