"""Words and shingles of whole Arrow string columns as 64-bit hashes, by numpy.

A column's bytes are read where they lie. Words are runs of bytes other than
ASCII white space and never cross the border of two texts. A word's hash is a
polynomial over its bytes modulo 2**64 with random byte codes, then mixed; two
different words meet with odds of about 2**-63."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_rng = np.random.default_rng(20240607)
_CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORDS = (~_SPACE).astype(np.uint8)
#: Runs of letters and digits (and all beyond ASCII) are tokens of their own, and so are runs of signs.
RUNS = WORDS * np.uint8(2)
RUNS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_BASE = 0x9E3779B97F4A7C15 | 3
_powers: dict[str, np.ndarray] = {}
_STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every bit counts."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, BLOCK + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about ``size`` bytes of text each, one row at least."""
    n = batch.num_rows
    _, offsets = texts(batch.column(column))
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1)
        yield batch.slice(start, min(stop, n) - start)
        start = stop


def word_hashes(column: pa.Array, lower: bool = True, classes: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and each text's number of words. ``classes`` gives each byte's
    class; a word is a longest run of one class, and class 0 separates."""
    data, offsets = texts(column)
    codes = _LOWER if lower else _CODES
    found, places = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        stop = min(at + BLOCK, end)
        if stop < end:  # on to the next place where no word is cut
            border = int(offsets[np.searchsorted(offsets, stop)])
            while stop < border:
                space = np.flatnonzero(_SPACE[data[stop : min(stop + 4096, border)]])
                if len(space):
                    stop += int(space[0])
                    break
                stop = min(stop + 4096, border)
        part = data[at:stop]
        n = len(part)
        up, down = _power(n)
        own = classes[part]
        before = np.zeros(n, np.uint8)
        before[1:] = own[:-1]
        border = own != before
        border[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at] = True
        starts = np.flatnonzero(border & (own > 0))
        ends = np.flatnonzero(border & (before > 0))
        if own[-1]:
            ends = np.append(ends, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes[part] * up[:n], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * down[starts]))
        places.append(starts + at)
        at = stop
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    counts = np.diff(np.searchsorted(np.concatenate(places), offsets))
    return np.concatenate(found), counts


def chain(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """At each word the hash of the up to k words from it to its text's end, and how many words are left there."""
    ends = np.repeat(np.cumsum(counts), counts)
    left = ends - np.arange(len(h))
    acc = h.copy()
    for j in range(1, k):
        inside = left > j
        step = acc[:-j] * _STEP + h[j:] if j < len(h) else acc[:0]
        acc[: len(step)] = np.where(inside[: len(step)], step ^ (step >> np.uint64(29)), acc[: len(step)])
    return mix(acc), left


def shingles(h: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and each text's number of them. A text with fewer words has its whole sequence as one; one without words has none."""
    acc, left = chain(h, counts, k)
    first = np.zeros(len(h), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    return acc[(left >= k) | first], np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and their numbers."""
    s, n = shingles(*word_hashes(column), k)
    stops = np.cumsum(n)
    sets = [np.unique(s[b - c : b]) for b, c in zip(stops.tolist(), n.tolist(), strict=True) if c]
    sizes = np.zeros(len(n), np.int64)
    sizes[n > 0] = [len(x) for x in sets]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), sizes
