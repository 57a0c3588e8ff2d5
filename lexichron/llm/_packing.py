"""Whole numbers as short byte strings, for rows that carry many of them through a shuffle."""

from __future__ import annotations

import zlib

import numpy as np


def _deflate(raw: bytes) -> bytes:
    c = zlib.compressobj(1, strategy=zlib.Z_RLE)  # runs and letter codes alone: smaller here than with matches
    return c.compress(raw) + c.flush()


def pack(x: np.ndarray) -> bytes:
    """Whole numbers, deflated by planes of bytes; small ones of either sign take few."""
    x = x.astype(np.int64).ravel()
    return _deflate(((x << 1) ^ (x >> 63)).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    x = np.ascontiguousarray(np.frombuffer(zlib.decompress(blob), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
    return (x >> 1) ^ -(x & 1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted distinct 64-bit keys as steps from one to the next: the steps' lower bytes, which are noise, as they
    are, the upper ones deflated. Nothing of a key is lost."""
    if not len(keys):
        return b""
    steps = np.diff(keys, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    noise = max(0, (int(np.median(steps)).bit_length() - 1) // 8)
    return bytes([noise]) + planes[:noise].tobytes() + _deflate(planes[noise:].tobytes())


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    noise = blob[0]
    planes = np.empty((8, n), np.uint8)
    planes[:noise] = np.frombuffer(blob, np.uint8, noise * n, 1).reshape(noise, n)
    planes[noise:] = np.frombuffer(zlib.decompress(blob[1 + noise * n :]), np.uint8).reshape(8 - noise, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_ranks(x: np.ndarray) -> bytes:
    """Numbers from 0 of which small ones are frequent: their bit lengths deflated, and of each length the bits below the first, packed."""
    x = x.astype(np.uint32) + np.uint32(1)
    length = np.zeros(len(x), np.uint8)  # bits below the first
    for b in range(1, 32):
        length += (x >> np.uint32(b)) > 0
    head = _deflate(length.tobytes())
    parts = [len(x).to_bytes(8, "little"), len(head).to_bytes(8, "little"), head]
    for b in range(1, 32):
        own = x[length == b]
        if len(own):
            parts.append(np.packbits(((own[:, None] >> np.arange(b, dtype=np.uint32)) & np.uint32(1)).astype(bool)).tobytes())
    return b"".join(parts)


def unpack_ranks(blob: bytes) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), int.from_bytes(blob[8:16], "little")
    length = np.frombuffer(zlib.decompress(blob[16 : 16 + size]), np.uint8)
    x, at = np.ones(n, np.int64), 16 + size
    for b in range(1, 32):
        own = np.flatnonzero(length == b)
        if len(own):
            stop = at + -(-len(own) * b // 8)
            bits = np.unpackbits(np.frombuffer(blob, np.uint8, stop - at, at), count=len(own) * b).reshape(-1, b)
            x[own] = (bits.astype(np.int64) << np.arange(b)).sum(axis=1) + (1 << b)
            at = stop
    return x - 1
