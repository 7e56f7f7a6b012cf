"""Text set in lines of a given width, greedily, also texts too long for a task.

A text is cut to atoms a line may break between: a word, one wide character, or a
run of white space. A line takes atoms as long as they fit; one that is too wide
stands alone. White space at a break is dropped, at a text's end it is kept if it
fits. Where a line ends follows from the place where it begins: the break is
searched in the atoms' prefix widths, and points to the next line's beginning.
Texts of up to ``WHOLE`` characters are set where they are read, many at a time.
Longer ones are cut to blocks of atoms: pointers are followed within blocks (each
block sees a line's width beyond its end), and from block to block by doubling
(``chain``), where a block's states are the atoms at which it may be entered.

Defined results: null and empty texts have no lines; white space at the beginning
is dropped; other columns are not read; equal ids must not occur.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.functions.documents import BLANK, WIDE
from docframe.operators.chain import entries
from docframe.ship import ship

BLOCK = 4096
#: Characters of a text that is set in one go, and of the texts that are held at a time.
WHOLE = 1 << 20


def _inside(pattern: str) -> np.ndarray:
    """By code point: is it in a class such as ``BLANK``?"""
    out = np.zeros(0x110000, bool)
    code = lambda c: int(c[2:].strip("{}"), 16) if c[:2] == r"\x" else ord({r"\t": "\t", r"\n": "\n", r"\f": "\f", r"\r": "\r"}.get(c, c))
    for a, b in re.findall(r"(\\x\{\w+\}|\\x\w\w|\\?.)(?:-(\\x\{\w+\}))?", pattern[1:-1]):
        out[code(a) : code(b or a) + 1] = True
    return out


_BLANK, _WIDE = _inside(BLANK), _inside(WIDE)
#: 1 white space, 2 wide (some white space is wide, too: it is white space), 0 all others.
_KIND = np.where(_BLANK, 1, np.where(_WIDE, 2, 0)).astype(np.uint8)


def half_widths(chars: np.ndarray) -> np.ndarray:
    """Width of code points in half characters: wide ones have two."""
    return 1 + _WIDE[chars].astype(np.int64)


class Atoms:
    """The atoms of some texts in a row; line ends count as blanks. ``begin`` has a character's place, ``first`` an atom's, and both an end."""

    def __init__(self, texts: list[str], width: Callable[[np.ndarray], np.ndarray]):
        self.text = "".join(texts).replace("\n", " ")
        chars = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        kind, fresh = _KIND[chars], np.ones(len(chars), bool)
        fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        fresh[at[:-1][at[:-1] < len(chars)]] = True
        begin = np.flatnonzero(fresh)
        self.begin, self.first = np.append(begin, len(chars)), np.searchsorted(begin, at)
        self.space = kind[begin] == 1
        self.width = np.maximum(1, np.add.reduceat(width(chars), begin)) if len(begin) else np.zeros(0, np.int64)

    def words(self, a: int, b: int) -> list[str]:
        at = self.begin[a : b + 1].tolist()
        return [self.text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]

    def lines(self, room: int) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
        """Of every line: its text's number, its number there, its text and its width."""
        n, size = len(self.width), np.diff(self.first)
        total, here = np.concatenate([[0], np.cumsum(self.width)]), np.arange(n)
        stop = np.repeat(self.first[1:], size)
        ends = np.minimum(np.maximum(np.searchsorted(total, total[:-1] + room, side="right") - 1, here + 1), stop)
        space = np.append(self.space, False)
        follow = (ends + (space[ends] & (ends < stop))).tolist()
        starts: list[int] = []
        for p, q in zip((self.first[:-1] + space[self.first[:-1]]).tolist(), self.first[1:].tolist(), strict=True):
            while p < q:
                starts.append(p)
                p = follow[p]
        p = np.array(starts, np.int64)
        end = ends[p]
        end = end - ((end < stop[p]) & (end - 1 > p) & space[end - 1])
        of = np.repeat(np.arange(len(size)), size)[p]
        line = [self.text[a:b] for a, b in zip(self.begin[p].tolist(), self.begin[end].tolist(), strict=True)]
        return of, np.arange(len(p)) - np.searchsorted(of, of) + 1, line, total[end] - total[p]


class Lines:
    """A block's atoms and those a line's width beyond: where each line that begins here ends, and the next begins."""

    def __init__(self, width: np.ndarray, space: np.ndarray, room: int, block: int):
        self.n, self.block = len(width), block
        self.total = np.concatenate([[0], np.cumsum(width)])
        here = np.arange(min(block, self.n))
        self.ends = np.maximum(np.searchsorted(self.total, self.total[here] + room, side="right") - 1, here + 1)
        self.next = self.ends + np.concatenate([space, [False]])[self.ends]

    def map(self, states: int) -> tuple[list, list]:
        """For each of the first ``states`` atoms: the atom of the next block at which it is entered (None: the text ends), and the lines begun here."""
        n = len(self.next)
        leaves, lines = [None] * n, [0] * n
        for p in range(n - 1, -1, -1):
            q = int(self.next[p])
            if q < n:
                leaves[p], lines[p] = leaves[q], lines[q] + 1
            else:
                leaves[p], lines[p] = (q - self.block if q < self.n else None), 1
        pad = max(0, states - n)
        return leaves[:states] + [None] * pad, lines[:states] + [0] * pad

    def starts(self, p: int) -> Iterator[int]:
        while p < len(self.next):
            yield p
            p = int(self.next[p])


def _column(batch: pa.RecordBatch, k: int, dtype) -> list[np.ndarray]:
    c = batch.column(k)
    at, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False).astype(dtype)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of a batch (key, text), so many that they have ``WHOLE`` characters, or one more."""
    held, size, first = [], 0, 0
    for i, t in enumerate(batch.column(1).cast(pa.binary())):
        held.append(t.as_py().decode("utf-8", "replace"))
        size += len(held[-1])
        if size >= WHOLE:
            yield first, held
            held, size, first = [], 0, i + 1
    if held:
        yield first, held


def wrap_lines(df: DataFrame, room: int, key: str = "doc_id", text: str = "text", width: Callable[[np.ndarray], np.ndarray] = half_widths, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(key, line_no, line, width) of (key, text); ``width`` tells the widths of code points, in the unit of ``room``; an atom has 1 at least."""
    if room < 1:
        raise ValueError("a line needs room")
    states = room + 2  # a line holds no more atoms than its room, and white space after it
    block = max(block, states + 1)
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    texts = df.where(F.length(text) > 0).select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"key {kind}, line_no bigint, line string, width bigint"

    def at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in _parts(b):
                of, no, line, wide = Atoms(held, width).lines(room)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of + first)), pa.array(no), pa.array(line, pa.string()), pa.array(wide)], ["key", "line_no", "line", "width"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, held in _parts(b):
                for i, t in enumerate(held, first):
                    a = Atoms([t], width)
                    for k, p in enumerate(range(0, len(a.width), block)):
                        q = min(p + block + states, len(a.width))
                        yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([k], pa.int32()), pa.array([a.width[p:q]], pa.list_(pa.int32())), pa.array([a.space[p:q]], pa.list_(pa.bool_())), pa.array([a.words(p, q)], pa.list_(pa.string()))], ["key", "block", "width", "space", "text"])

    long = texts.where(F.length("text") > whole).mapInArrow(blocks, f"key {kind}, block int, width array<int>, space array<boolean>, text array<string>")
    start = F.when(F.col("space")[0], 1).otherwise(0)

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Lines(w, s, room, block).map(states) for w, s in zip(_column(b, 2, np.int64), _column(b, 3, bool), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([e for e, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["key", "block", "exits", "counts"])

    seen = entries(long.select("key", "block", "width", "space").repartition("key", "block").mapInArrow(maps, f"key {kind}, block int, exits array<int>, counts array<bigint>"), long.where("block = 0").select("key", start.alias("state")), "key")
    entered = long.join(seen, ["key", "block"]).select("key", "count", "state", "width", "space", "text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, (w, s) in enumerate(zip(_column(b, 3, np.int64), _column(b, 4, bool), strict=True)):
                words, block_of, n = b.column(5)[i].as_py(), Lines(w, s, room, block), b.column(1)[i].as_py()
                for p in block_of.starts(b.column(2)[i].as_py()):
                    n, end = n + 1, int(block_of.ends[p])
                    end -= bool(end < block_of.n and end - 1 > p and s[end - 1])
                    rows.append((i, n, "".join(words[p:end]), int(block_of.total[end] - block_of.total[p])))
            if rows:
                at, no, line, wide = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(no, pa.int64()), pa.array(line), pa.array(wide, pa.int64())], ["key", "line_no", "line", "width"])

    return texts.where(F.length("text") <= whole).mapInArrow(at_once, schema).union(entered.mapInArrow(lines, schema)).withColumnRenamed("key", key)
