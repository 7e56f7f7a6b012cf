"""Vectors as short codes of codebook entries, found through a vector-approximation file.

Components become integers, vectors are cut into parts, and every part has a
codebook learned by rounds of assignment and floored means, all in integers, so
a run gives the same codebooks on any cluster. The nearest entry of a part is
found as in a VA-file: the coordinates of the entries are quantised to a few
bits, that is to cells; for a query, a look-up table a coordinate gives the least
and the greatest squared distance to each cell, and their sums bound the distance
to each entry from both sides. Entries whose lower bound is above the least
upper bound are out; the others are refined by integer distances. An entry
nearest or equally near is never ruled out, so the result is exact.

A round is one pass that holds the codebooks (bounded: parts x entries) and
hands on sums and counts an entry from each task; no row leaves its place, and
the integers are written once to the shared folder for all passes.

Defined results: rows whose vector is null or empty or holds a null or
non-finite component are left out; so are rows whose vector is not as long as
that of the least id. A length that the parts don't divide is filled up with
zeros, which change no distance. Null ids come after all others where codebooks
start; of equal ids the lesser vector does. Fewer rows than entries give smaller
codebooks. Repeated rows count and are coded each; nulls are a label. Integers
are held within 2^40 either way (components within 2^28), sums of squares beyond
the range of a long are returned as its greatest value. An empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.ship import ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A coordinate of an entry is quantised to so many bits.
BITS = 3
#: Greatest size of an integer; of those that 64-bit sums of squares hold for up to 512 coordinates a part.
WIDEST, NARROW = 1 << 40, 1 << 26
ROWS = 4096


class Cells:
    """The entries of one codebook, and the cells that their coordinates lie in."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries, cells = entries, 1 << bits
        low = entries.min(0)
        span = entries.max(0) - low + 1
        k = np.arange(cells + 1).astype(entries.dtype)[:, None]
        begin = low - (-k * span) // cells  # cell k holds the integers from begin[k] up to before begin[k + 1]
        self.low, self.high = begin[:-1], begin[1:] - 1
        self.cell = ((entries - low) * cells // span).astype(np.int64)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of each query to each entry, as their cells tell."""
        under = over = 0
        for c in range(x.shape[1]):
            q = x[:, c, None]
            below, above = self.low[None, :, c] - q, q - self.high[None, :, c]
            least, most = np.maximum(np.maximum(below, above), 0), np.maximum(abs(below), abs(above))
            under = under + (least * least)[:, self.cell[:, c]]
            over = over + (most * most)[:, self.cell[:, c]]
        return under, over

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest entry (of equals the first), its squared distance, and how many distances were worked out."""
        under, over = self.bounds(x)
        row, entry = np.nonzero(under <= over.min(1, keepdims=True))
        apart = x[row] - self.entries[entry]
        distance = (apart * apart).sum(1)
        all_of = np.full(under.shape, over.max(initial=0) + 1, under.dtype)
        all_of[row, entry] = distance
        best = all_of.argmin(1) if len(x) else np.zeros(0, np.int64)
        return best, all_of[np.arange(len(x)), best], len(row)


def _blocks(batch: pa.RecordBatch, column: int, parts: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Rows as integers (row, part, place); as Python's where 64 bits would not hold the sums."""
    for a in range(0, batch.num_rows, ROWS):
        s = batch.slice(a, ROWS)
        x = s.column(column).flatten().to_numpy().reshape(s.num_rows, -1)
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % parts))).reshape(s.num_rows, parts, -1)
        wide = max(int(x.max(initial=0)), -int(x.min(initial=0))) >= NARROW
        yield slice(a, a + s.num_rows), x.astype(object) if wide else x


def _books(books: list, x: np.ndarray) -> list[Cells]:
    wide = x.dtype == object or max(abs(v) for book in books for entry in book for v in entry) >= NARROW
    return [Cells(np.array(book, object if wide else np.int64)) for book in books]


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """(vec_id, label, x): the rows that are kept, with components as integers."""
    v = F.col(embedding).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = lambda c: F.floor(F.greatest(F.lit(-float(WIDEST)), F.least(F.lit(float(WIDEST)), c * scale)))
    return vectors.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.transform(v, whole).alias("x"))


def starts(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> tuple[int, list]:
    """The length of vectors, and codebooks [part][entry][place] from the rows of the least ids."""
    order = [F.asc_nulls_last("vec_id"), F.col("x")]
    length = next((len(r.x) for r in kept.orderBy(*order).limit(1).collect()), 0)
    first = [r.x for r in kept.where(F.size("x") == length).orderBy(*order).limit(entries).collect()]
    wide = -(-length // parts)
    filled = [x + [0] * (wide * parts - length) for x in first]
    return length, [[x[p * wide : p * wide + wide] for x in filled] for p in range(parts)]


def moved(kept: DataFrame, books: list) -> list:
    """Codebooks after a round: every entry the floored mean of the parts it is nearest to; unused ones stay."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, len(books[0]), len(books[0][0])), object), np.zeros((parts, len(books[0])), np.int64)
        for b in batches:
            for _, x in _blocks(b, 0, parts):
                for p, cells in enumerate(_books(books, x)):
                    best, _, _ = cells.nearest(x[:, p])
                    for e in np.unique(best):
                        total[p, e] += x[best == e, p].sum(0).astype(object)
                    count[p] += np.bincount(best, minlength=len(books[0]))
        at = [(p, e, c) for p, e in zip(*np.nonzero(count), strict=True) for c in range(total.shape[2])]
        cols = [[p for p, _, _ in at], [e for _, e, _ in at], [c for _, _, c in at]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([Decimal(int(total[i])) for i in at], pa.decimal128(38, 0)), pa.array([int(count[p, e]) for p, e, _ in at], pa.int64())], ["part", "entry", "place", "total", "n"])

    sums = kept.select("x").mapInArrow(run, "part long, entry long, place long, total decimal(38,0), n long")
    out = [[list(entry) for entry in book] for book in books]
    for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        out[r.part][r.entry][r.place] = int(r.total) // r.n
    return out


def learn(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, list]:
    length, books = starts(kept, parts, entries)
    same = kept.where(F.size("x") == length)
    for _ in range(rounds if length else 0):
        books = moved(same, books)
    return length, books


def digest(books: list) -> str:
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def encoded(kept: DataFrame, books: list) -> DataFrame:
    """(vec_id, label, code, error): two hex digits a part, and the squared distances to the entries."""
    ship(kept.sparkSession)
    kind, parts, greatest = kept.schema["label"].dataType.simpleString(), len(books), (1 << 63) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, x in _blocks(b, 2, parts):
                found = [cells.nearest(x[:, p])[:2] for p, cells in enumerate(_books(books, x))]
                code = np.stack([best for best, _ in found], 1).astype(np.uint8)
                error = sum(d.astype(object) for _, d in found)
                s = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array([row.tobytes().hex() for row in code], pa.string()), pa.array([min(int(e), greatest) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "x").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): one row per kept row."""
    if entries > 256:
        raise ValueError("an entry has two hex digits")
    ship(vectors.sparkSession)
    kept = cut(integers(vectors, vec_id, embedding, label, scale))
    length, books = learn(kept, parts, entries, rounds)
    if not length:
        return encoded(kept.limit(0), [[[0]]] * parts).select("vec_id", "code", "error", F.col("error").alias("label_error"), F.lit(digest([])).alias("codebooks_sha256"))
    rows = cut(encoded(kept.where(F.size("x") == length), books))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")
    of = rows.groupBy(F.col("label").alias("of_label")).agg(total.alias("label_error"))
    return rows.join(of, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same by plain distances to all entries, in SQL."""
    steps = [
        f"k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda c : floor({scale} * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c : c IS NULL OR NOT isfinite(c))) = 0)",
        f"v AS MATERIALIZED (SELECT rid, vec_id, label, i * {parts} // len(x) AS part, i % (len(x) // {parts}) AS place, x[i + 1] AS c FROM k, unnest(range(len(x))) u(i))",
        f"b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, place, c FROM v WHERE rid <= {entries})",
    ]
    for r in range(rounds + 1):
        steps += [
            f"d{r} AS MATERIALIZED (SELECT rid, part, entry, sum((v.c - b.c) * (v.c - b.c)) AS d FROM v JOIN b{r} b USING (part, place) GROUP BY rid, part, entry)",
            f"a{r} AS MATERIALIZED (SELECT rid, part, (min((d, entry)))[2] AS entry, min(d) AS d FROM d{r} GROUP BY rid, part)",
        ]
        if r < rounds:
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, place, CASE WHEN n IS NULL THEN b.c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{r} b LEFT JOIN (SELECT part, entry, place, sum(c) AS s, count(*) AS n FROM v JOIN a{r} USING (rid, part) GROUP BY part, entry, place) USING (part, entry, place))")
    return "WITH " + ",\n".join(steps) + f",\ne AS (SELECT rid, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256 FROM e JOIN k USING (rid)"
