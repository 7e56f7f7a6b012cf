"""Which region of a Markdown text each line lies in: fenced code, directives, or neither; by composed maps of lines.

A line changes the state of the text in one of few ways: it opens a fence, closes
one (it begins with the marker that opened it), opens a directive, closes all
directives, or does nothing. The state is the depth of directives and the marker
of the open fence. What a block of lines does to every state is a map that needs
no other block; maps are composed by doubling (``chain``), so one long text is
split over tasks, and runs again from the right states.

As lines are read for blocks: the first closing mark ends the outermost
directive, whatever has been opened within; a fence or directive that is never
closed takes the rest of what it stands in; directives are nested up to
``MOST_DEPTH`` deep, below that their marks are plain lines.

A mark within a table's row counts as one here.

Defined results: null texts have no lines, empty ones one; markers of over
``LONGEST`` characters count as that long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.functions.documents import BLANK
from docframe.kernels.markdown import DIRECTIVE, FENCE, MOST_DEPTH
from docframe.operators.chain import entries
from docframe.ship import ship

BLOCK, LONGEST = 4096, 63
#: A state is depth * FENCES + fence; fence 0 is none, then lengths 3 to LONGEST of either marker.
_LENGTHS = LONGEST - 2
FENCES = 1 + 2 * _LENGTHS
STATES = (MOST_DEPTH + 1) * FENCES
PLAIN, OPENS, CLOSES = 0, -1, -2


def marks(line: Column) -> Column:
    """What a line may do, as a number: 0 nothing, -1 opens a directive, -2 closes them, else a run of fence characters (+1000 tildes), negative beyond -2 if it can only close."""
    run = F.regexp_extract(line, rf"^{BLANK}*(`{{3,}}|~{{3,}})", 1)
    code = F.least(F.length(run), F.lit(LONGEST)) + F.when(run.startswith("~"), 1000).otherwise(0)
    fence = F.when(line.rlike(_JAVA_FENCE), code).otherwise(-code)
    named = F.regexp_extract(line, _JAVA_DIRECTIVE, 1)
    return F.when(run != "", fence).when(line.rlike(_JAVA_DIRECTIVE), F.when(named != "", OPENS).otherwise(CLOSES)).otherwise(PLAIN)


_JAVA_FENCE, _JAVA_DIRECTIVE = ("^" + p.pattern.replace(r"\Z", r"\z") for p in (FENCE, DIRECTIVE))


def fence_of(code: int) -> int:
    n = abs(code)
    return n % 1000 - 2 + _LENGTHS * (n >= 1000)


def step(state: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """States after a line, and 1 where the line is a mark itself."""
    depth, fence = state // FENCES, state % FENCES
    if code == CLOSES:
        ends = depth > 0
        return np.where(ends, 0, state), ends
    if code == OPENS:
        opens = (fence == 0) & (depth < MOST_DEPTH)
        return np.where(opens, state + FENCES, state), opens
    mine = fence_of(code)
    same = (fence > 0) & ((fence > _LENGTHS) == (mine > _LENGTHS)) & (fence <= mine)
    opens = (fence == 0) & (code > 0)
    return np.where(same, depth * FENCES, np.where(opens, depth * FENCES + mine, state)), same | opens


def block_map(codes: np.ndarray) -> list[int]:
    state = np.arange(STATES)
    for code in codes[codes != PLAIN].tolist():
        state, _ = step(state, code)
    return state.tolist()


def regions_of(state: int, codes: np.ndarray) -> tuple[list[int], list[bool], list[bool]]:
    """(depth, in a fence, is a mark) of each line; a mark belongs to what it opens or closes."""
    depth, fenced, mark = [], [], []
    for code in codes.tolist():
        before = state
        is_mark = False
        if code != PLAIN:
            after, m = step(np.array([state]), code)
            state, is_mark = int(after[0]), bool(m[0])
        of = max(before, state) if is_mark else state
        depth.append(of // FENCES)
        fenced.append(of % FENCES > 0)
        mark.append(is_mark)
    return depth, fenced, mark


def line_regions(df: DataFrame, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(key, pos, line, depth, fenced, mark) of each line of (key, text)."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n", -1)
    whole = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), lines.alias("lines"))
    count = F.ceil(F.size("lines") / block).cast("int")
    part = lambda i: F.slice("lines", i * block + 1, block)
    blocks = whole.select("key", "lines", count.alias("blocks"), F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    blocks = blocks.select("key", "blocks", "block", part(F.col("block")).alias("lines")).withColumn("codes", F.transform("lines", marks))
    long = blocks.where("blocks > 1").repartition("key", "block")

    def arrays(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
        c = batch.column(k)
        at, values = c.offsets.to_numpy(), c.values.to_numpy()
        return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([block_map(c) for c in arrays(b, 2)], pa.list_(pa.int32())), pa.array([[0] * STATES] * n, pa.list_(pa.int64()))], ["key", "block", "exits", "counts"])

    mapped = long.select("key", "block", "codes").mapInArrow(maps, f"key {kind}, block int, exits array<int>, counts array<bigint>")
    seen = entries(mapped, long.where("block = 0").select("key", F.lit(0).alias("state")), "key").drop("count")
    entered = long.join(seen, ["key", "block"]).unionByName(blocks.where("blocks <= 1").withColumn("state", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines, states, number = b.column(2), b.column(4).to_pylist(), b.column(1).to_pylist()
            for i, codes in enumerate(arrays(b, 3)):
                depth, fenced, mark = regions_of(states[i], codes)
                n = len(codes)
                at = np.arange(n) + number[i] * block
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * n)), pa.array(at, pa.int64()), lines[i].values, pa.array(depth, pa.int32()), pa.array(fenced, pa.bool_()), pa.array(mark, pa.bool_())], ["key", "pos", "line", "depth", "fenced", "mark"])

    got = entered.select("key", "block", "lines", "codes", "state").mapInArrow(run, f"key {kind}, pos bigint, line string, depth int, fenced boolean, mark boolean")
    return got.withColumnRenamed("key", key)
