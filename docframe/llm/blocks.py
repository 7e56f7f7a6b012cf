"""Sorted sets of 64-bit keys, and their counts, as compact binary blocks.

A key is cut into low bytes, which are stored as they are, and a high part, of
which only the number of keys by value is stored; so a key of a set of n costs
about (width - log2 n) bits, and two more.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<IBBI")


def unique(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (below 2^63), ascending, and how many of each have ``learn``."""
    both = np.sort(keys << np.uint64(1) | learn.astype(np.uint64))
    keys = both >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(both & np.uint64(1), first).astype(np.int64) if len(first) else first


def places(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct ones in ascending order."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), np.int64)
    new[1:] = keys[1:] != keys[:-1]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def pack(keys: np.ndarray, width: int) -> bytes:
    """Ascending distinct keys below 2^width."""
    n = len(keys)
    low = max(0, (width - max(n, 1).bit_length() + 4) // 8)
    high = (keys >> np.uint64(8 * low)).astype(np.int64) if low < 8 else np.zeros(n, np.int64)
    size = np.bincount(high, minlength=1 << (width - 8 * low)) if width > 8 * low else np.array([n])
    wide = 1 if size.max(initial=0) < 256 else 4
    head = zstandard.ZstdCompressor(1).compress(size.astype(f"<u{wide}").tobytes())
    return _HEAD.pack(n, low, wide, len(head)) + head + keys.astype("<u8").view(np.uint8).reshape(n, 8)[:, :low].tobytes()


def unpack(block: bytes) -> np.ndarray:
    n, low, wide, head = _HEAD.unpack_from(block)
    at = _HEAD.size
    size = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[at : at + head]), f"<u{wide}")
    out = np.zeros((n, 8), np.uint8)
    out[:, :low] = np.frombuffer(block, np.uint8, n * low, at + head).reshape(n, low)
    keys = out.view("<u8").reshape(n).astype(np.uint64)
    return keys | np.repeat(np.arange(len(size), dtype=np.uint64), size) << np.uint64(8 * low) if low < 8 else keys


def pack_counts(c: np.ndarray) -> bytes:
    """Any counts; small ones take a byte before compression."""
    big = c[c >= 255].astype("<u8").tobytes()
    return struct.pack("<I", len(c)) + zstandard.ZstdCompressor(1).compress(np.minimum(c, 255).astype(np.uint8).tobytes() + big)


def unpack_counts(block: bytes) -> np.ndarray:
    n = struct.unpack_from("<I", block)[0]
    data = zstandard.ZstdDecompressor().decompress(block[4:])
    out = np.frombuffer(data, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", -1, n).astype(np.int64) if len(data) > n else 0
    return out
