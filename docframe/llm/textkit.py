"""Vectorised text scanning over Arrow batches: words, lines and their hashes.

All functions work on the concatenated UTF-8 bytes of a slice of a batch; no
Python object is made per word. Slices hold whole texts and at most
``SLICE_BYTES`` bytes, or one text if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
#: Words longer than this are hashed by xxhash one by one; shorter ones in lock step.
LONG_WORD = 48
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that are parted by white space only: [^\x20\x09-\x0D]+
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words of letters and digits; every non-ASCII character counts as a letter.
ALNUM = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    ALNUM[_a:_b] = True


class Texts:
    """The bytes of some texts in a row: ``buf``, and ``offs`` with len(texts)+1 offsets."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs, self.n = buf, offs, len(offs) - 1

    @staticmethod
    def of(texts: list) -> "Texts":
        return next(slices(pa.array([t or "" for t in texts], pa.large_string()), 1 << 62))[1] if texts else Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))

    def text(self, i: int) -> bytes:
        return self.buf[self.offs[i] : self.offs[i + 1]].tobytes()

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of bytes for which ``inside`` holds."""
        mask = inside[self.buf] if inside.shape == (256,) else inside
        if not len(mask):
            z = np.zeros(0, np.int64)
            return z, z, z
        before = np.empty_like(mask)
        before[0], before[1:] = False, mask[:-1]
        cuts = self.offs[:-1]
        cuts = cuts[cuts < len(mask)]
        before[cuts] = False
        starts = np.flatnonzero(mask & ~before)
        after = np.empty_like(mask)
        after[-1], after[:-1] = False, mask[1:]
        after[cuts[cuts > 0] - 1] = False
        ends = np.flatnonzero(mask & ~after) + 1
        return starts, ends, np.searchsorted(self.offs, starts, side="right") - 1

    def char_index(self) -> np.ndarray:
        """Code points before each byte of the slice (one more entry than bytes)."""
        out = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum((self.buf & 0xC0) != 0x80, out=out[1:])
        return out


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[slice, Texts]]:
    """Cut a string column (nulls count as empty) into slices of whole texts."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + most, side="right")) - 1)
        b = min(b, n)
        yield slice(a, b), Texts(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        a = b


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of spans of ``buf``; with prefixes, also of the first so many bytes (or all)."""
    n = len(starts)
    lens = ends - starts
    order = np.argsort(-np.minimum(lens, LONG_WORD + 1).astype(np.int16), kind="stable")
    s, ls = starts[order], lens[order]
    h = np.full(n, 0x51_7C_C1_B7_27_22_0A_95, np.uint64)
    kept: list[np.ndarray] = []
    top = int(min(ls[0], LONG_WORD)) if n else 0
    vals = _TABLE[buf]
    counts = np.searchsorted(-np.minimum(ls, LONG_WORD), -np.arange(1, top + 1), side="right") if n else []
    for k in range(top):
        m = int(counts[k])
        x = h[:m]
        x *= _MULT
        x ^= x >> np.uint64(29)
        x += vals[s[:m] + k]
        if k + 1 in prefixes:
            kept.append(h.copy())
    while len(kept) < len(prefixes):
        kept.append(h.copy())
    for i in range(int(np.count_nonzero(ls > LONG_WORD))):
        h[i] = np.uint64(xxhash.xxh64_intdigest(buf[s[i] : s[i] + ls[i]].tobytes(), 7))
    outs = []
    for x in (h, *kept):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        y = np.empty_like(x)
        y[order] = x
        outs.append(y)
    return tuple(outs)


def chain(h: np.ndarray, k: int) -> np.ndarray:
    """Rolling hashes of k successive items of ``h`` (len(h)-k+1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _MULT
        out ^= out >> np.uint64(31)
        out += h[j : j + n]
    return out


def sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(group, values, n)
