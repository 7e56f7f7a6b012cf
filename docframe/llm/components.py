"""Connected components of a link table, distributed.

Defined results: repeated links and links of a node to itself change nothing;
nodes without a link are not returned; rows with a null end are dropped; no
links give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.ship import ship

#: A hub's neighbours are dealt to so many tasks.
SALTS = 16
#: So many edges (16 bytes each) are solved in one task.
FEW = 1_000_000


class Forest:
    """Local components of numbered points; ``root`` is the least number of each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                r = self.root[self.root]
                if (r == self.root).all():
                    break
                self.root = r

    def near(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        self.link(a, b)


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all (u, v)."""
    t = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["u", "v"]), *batches])
    node, at = np.unique(np.concatenate([t.column(0).to_numpy(), t.column(1).to_numpy()]), return_inverse=True)
    forest = Forest(len(node))
    forest.link(at[: t.num_rows], at[t.num_rows :])
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[forest.root])], ["node", "root"])


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, few: int = FEW) -> DataFrame:
    """(node, root): each linked node with the least node it can reach; ``edges`` holds longs.

    At most ``few`` distinct edges are solved in one task, which saves the rounds.
    More are solved by rounds that alternate the large-star and small-star steps
    on the edge table, which keeps every hub's neighbours apart from its own row:
    all grouping is by partial aggregates and joins, and nothing is collected but
    two numbers a round. They end when a round changes nothing.
    """
    one = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") != F.col("v")).distinct()
    one = cut(one)
    if one.count() <= few:
        ship(edges.sparkSession)
        return one.coalesce(1).mapInArrow(solved, "node long, root long")
    last = None
    for _ in range(rounds):
        # large star: neighbours above a node are linked to its least neighbour
        both = one.union(one.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        above = both.where(F.col("v") > F.col("u")).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
        large = above.join(least, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and itself, are linked to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        one = cut(small)
        now = one.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return one.select(F.col("u").alias("node"), F.col("v").alias("root")).union(one.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
