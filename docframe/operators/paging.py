"""Pieces set on pages, in order: whole pieces where they fit, tables cut between rows, sub-headings kept with what follows.

A page takes pieces as long as they fit. A table that does not fit is cut, and its
head repeated on the next page. Where another piece does not fit, the page ends
before the last sub-heading on it (unless the page begins with that), so that
what stands below moves along with it. A piece taller than a page stands alone.

The state of a page is how much is used, and how much of that stands from the
last sub-heading on. Keys of many pieces are cut to blocks, each of which tells
for every state what it leaves and how many pages it ends; the blocks' states
follow by composing these maps (``chain``). A block sees a page's pieces beyond
its end, as these may still move its last ones. Time is linear in the pieces.

Defined results: costs below 1 count as 1; pieces of equal position come in any
order; no pieces give no pages; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.operators.chain import entries
from docframe.ship import ship

BLOCK = 4096
#: Rows are handed on in batches of about so many.
OUT_ROWS = 16_384
#: A table's row takes as much as so many lines.
ROW_LINES = 1.5


class Pages:
    """The rules, for pages of so many lines."""

    def __init__(self, room: int):
        self.room = room
        self.states = [(used, tail) for used in range(room + 1) for tail in range(used + 1)]
        self.number = {s: i for i, s in enumerate(self.states)}

    def table(self, rows: int) -> int:
        return int(np.ceil((rows + 1) * ROW_LINES))

    def step(self, state: tuple[int, int], cost: int, opens: bool, rows: int) -> tuple[tuple[int, int], list[tuple[str, int]]]:
        """The state after a piece (rows: -1 if it is no table), and what was done: ``end`` a page, ``move`` the tail to a new one, ``put`` so many rows (or the piece: -1)."""
        (used, tail), done = state, []
        while True:
            need = self.table(rows) if rows >= 0 else cost
            left = self.room - used
            if need <= left:
                done.append(("put", rows))
                if opens and used:
                    return (used + need, need), done
                return (used + need, tail + need if tail else 0), done
            if left > 0 and rows > (fits := max(1, int(left / ROW_LINES) - 1)):
                done += [("put", fits), ("end", 0)]
                used, tail, rows = 0, 0, rows - fits
            elif not used:
                return (0, 0), [*done, ("put", rows), ("end", 0)]
            elif tail and tail < used:
                done.append(("move", 0))
                used, tail = tail, 0
            else:
                done.append(("end", 0))
                used, tail = 0, 0

    def map(self, cost: np.ndarray, opens: np.ndarray, rows: np.ndarray) -> tuple[list[int], list[int]]:
        """For each state: the state after all pieces, and the pages ended; states that have become equal are run once."""
        live, of, pages = list(self.states), np.arange(len(self.states)), np.zeros(len(self.states), np.int64)
        for k, (c, o, r) in enumerate(zip(cost.tolist(), opens.tolist(), rows.tolist(), strict=True)):
            got = [self.step(s, c, o, r) for s in live]
            ended = np.array([sum(what != "put" for what, _ in done) for _, done in got])
            if ended.any():
                pages += ended[of]
            live = [s for s, _ in got]
            if len(live) > 1 and (k < 8 or k % 16 == 0):
                kinds = {s: i for i, s in enumerate(dict.fromkeys(live))}
                of = np.array([kinds[s] for s in live])[of]
                live = list(kinds)
        return [self.number[live[i]] for i in of], pages.tolist()

    def place(self, state: tuple[int, int], page: int, cost: np.ndarray, opens: np.ndarray, rows: np.ndarray, own: int) -> list[tuple[int, int, int, int, int]]:
        """(piece, part, page, first row, rows) of the first ``own`` pieces; those after them are looked at until theirs are settled."""
        out: list[list[int]] = []
        here: list[int] = []  # entries of out that stand on the page
        mark = 0 if state[1] else -1  # the first of them that would move along; what stood before the block is not ours
        for k, (c, o, r) in enumerate(zip(cost.tolist(), opens.tolist(), rows.tolist(), strict=True)):
            if k >= own and not here:
                break
            before, (state, done) = state, self.step(state, c, o, r)
            part, row = 0, 0
            started = before[0] > 0
            for what, n in done:
                if what == "put":
                    if k < own:
                        if o and started:
                            mark = len(here)
                        here.append(len(out))
                        out.append([k, part, page, row if n >= 0 else 0, n])
                    elif o and started:
                        mark = len(here)
                    part, row = part + 1, row + max(n, 0)
                    started = True
                elif what == "end":
                    page, here, mark, started = page + 1, [], -1, False
                else:
                    page, here, mark = page + 1, here[mark:], -1
                    for i in here:
                        out[i][2] = page
                    started = True
        return [tuple(x) for x in out]


def _arrays(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    c = batch.column(k)
    at, values = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _placed_rows(batch: pa.RecordBatch, found: list[tuple]) -> pa.RecordBatch:
    i, pos, part, at, first, n = zip(*found, strict=True)
    of_table = [x if x >= 0 else None for x in n]
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(pos, pa.int64()), pa.array(part, pa.int32()), pa.array(at, pa.int32()), pa.array([f if x is not None else None for f, x in zip(first, of_table, strict=True)], pa.int32()), pa.array(of_table, pa.int32())], ["key", "pos", "part", "page", "first_row", "n_rows"])


def placed(rule: Pages, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pos, part, page, first_row, n_rows) of blocks (key, pos, cost, opens, rows, state, count, own), some ``OUT_ROWS`` at a time: a batch may hold millions of pieces."""
    for b in batches:
        found: list[tuple] = []
        state, page, own = (b.column(k).to_pylist() for k in (5, 6, 7))
        for i, (pos, c, o, r) in enumerate(zip(*(_arrays(b, k) for k in (1, 2, 3, 4)), strict=True)):
            found += [(i, int(pos[k]), part, at, first, n) for k, part, at, first, n in rule.place(rule.states[state[i]], page[i], c, o, r, own[i])]
            if len(found) >= OUT_ROWS:
                yield _placed_rows(b, found)
                found = []
        if found:
            yield _placed_rows(b, found)


def paginate(pieces: DataFrame, room: int, key: str = "doc_id", cost: str = "cost", opens: str | None = None, rows: str | None = None, block: int = BLOCK) -> DataFrame:
    """(key, pos, part, page, first_row, n_rows) of (key, pos, cost, opens, rows): where each piece, or part of a table, stands.

    ``opens`` says of a piece that it is a sub-heading; ``rows`` how many rows a table has (null for others; a table's cost follows
    from its rows). ``n_rows`` is null for others. Parts but the first repeat the table's head.
    """
    rule, block = Pages(room), max(block, room + 2)
    ship(pieces.sparkSession)
    kind = pieces.schema[key].dataType.simpleString()
    # the blocks of a key are numbered by ranges of its sorted positions, a count of rows each
    flat = pieces.select(F.col(key).alias("key"), F.col("pos").cast("long").alias("pos"), F.greatest(F.lit(1), F.col(cost)).cast("int").alias("cost"), (F.coalesce(F.col(opens), F.lit(False)) if opens else F.lit(False)).alias("opens"), (F.coalesce(F.col(rows), F.lit(-1)) if rows else F.lit(-1)).cast("int").alias("rows"))
    flat = flat.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("pos")) - 1).withColumn("block", (F.col("_n") / block).cast("int"))
    halo = room + 2
    again = flat.where((F.col("block") > 0) & (F.col("_n") % block < halo)).withColumns({"block": F.col("block") - 1, "own": F.lit(False)})
    both = flat.withColumn("own", F.lit(True)).unionByName(again)
    p = both.groupBy("key", "block").agg(F.array_sort(F.collect_list(F.struct("_n", "pos", "cost", "opens", "rows", "own"))).alias("p"), F.max("_n").alias("_last"))
    p = p.select("key", "block", F.col("p.pos").alias("pos"), F.col("p.cost").alias("cost"), F.col("p.opens").alias("opens"), F.col("p.rows").alias("rows"), F.size(F.filter("p", lambda x: x["own"])).alias("own"))
    many = flat.where(F.col("_n") == block).select("key").distinct()  # keys of over a block
    long = p.join(many, "key", "left_semi")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(5).to_pylist()
            found = [rule.map(c[:n], o[:n], r[:n]) for c, o, r, n in zip(_arrays(b, 2), _arrays(b, 3), _arrays(b, 4), own, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([e for e, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int64()))], ["key", "block", "exits", "counts"])

    mapped = long.select("key", "block", "cost", "opens", "rows", "own").mapInArrow(maps, f"key {kind}, block int, exits array<int>, counts array<bigint>")
    seen = entries(mapped, many.select("key", F.lit(0).alias("state")), "key")
    entered = long.join(seen, ["key", "block"]).unionByName(p.join(many, "key", "left_anti").withColumns({"state": F.lit(0), "count": F.lit(0).cast("long")}))

    got = entered.select("key", "pos", "cost", "opens", "rows", "state", "count", "own").mapInArrow(partial(placed, rule), f"key {kind}, pos bigint, part int, page int, first_row int, n_rows int")
    return got.withColumnRenamed("key", key)
