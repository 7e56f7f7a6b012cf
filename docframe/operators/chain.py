"""A left-to-right machine over rows too many for a task: maps of blocks, composed by doubling.

A long sequence is cut to blocks. Each block tells, for every state in which it
may be entered, the state in which it is left and what is counted on the way;
that needs no other block, so all blocks are done at once. Composing the maps of
neighbours gives maps over 2, 4, 8... blocks, and with them the state at each
block's beginning is known in as many rounds as the logarithm of the number of
blocks (a prefix scan). Then all blocks run again, each from its own state.

Sequences of one block take no round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut


def entries(maps: DataFrame, first: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, state, count): how each block is entered.

    ``maps``: (key, block, exits array<int>, counts array<long>), where a state's
    exit is null if the machine stops there. ``first``: (key, state) of block 0.
    """
    jump = cut(maps.select(key, "block", "exits", "counts"))
    known = cut(first.select(key, F.lit(0).alias("block"), "state", F.lit(0).cast("long").alias("count")))
    blocks, step = (jump.agg(F.max("block")).first()[0] or 0) + 1, 1
    at = lambda values, i: F.try_element_at(values, i + 1)
    while step < blocks:
        ahead = known.join(jump, [key, "block"]).select(key, (F.col("block") + step).alias("block"), at(F.col("exits"), F.col("state")).alias("state"), (F.col("count") + at(F.col("counts"), F.col("state"))).alias("count"))
        known = cut(known.union(ahead.where("state is not null")))
        if step * 2 < blocks:
            then = jump.select(key, (F.col("block") - step).alias("block"), F.col("exits").alias("then_exits"), F.col("counts").alias("then_counts"))
            both = jump.join(then, [key, "block"])
            exits = F.transform("exits", lambda e: F.when(e.isNotNull(), at(F.col("then_exits"), e)))
            counts = F.transform(F.arrays_zip("exits", "counts"), lambda z: z["counts"] + F.when(z["exits"].isNotNull(), at(F.col("then_counts"), z["exits"])).otherwise(0))
            jump = cut(both.select(key, "block", exits.alias("exits"), counts.alias("counts")))
        step *= 2
    return known
