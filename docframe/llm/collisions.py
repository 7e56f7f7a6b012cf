"""Near copies among embeddings by counting collisions in sorted projections.

Vectors of one label are projected on ``PROJECTIONS`` random directions, each of
which is sorted. Around every vector (the query) each sorted projection has a
window; a vector that lies in it collides with the query. Pairs that collide in
at least ``need`` projections are verified by their cosine in double precision.
The window is ``REACH`` standard deviations of what a pair at the threshold
differs by in a random direction, and ``need`` is the greatest count that such a
pair falls short of with a chance of at most ``MISS`` (``calibrated``); nearer
pairs miss it more rarely still.

So that no two tasks need all rows, counting is done in shards. In each of
``tables`` a vector lies in the shard of its label that the sides of ``bits``
more random planes name. ``bits`` grows with the logarithm of the rows of the
largest label, ``tables`` so that a pair at the threshold shares no shard with a
chance of at most ``MISS``. Of the shards that two vectors share only the first
counts them, so numbers of links are exact and no pair is ever handed on: a
shard gives each of its rows the number of its links there and the least row
it reaches there. A label of few rows is one shard, and nothing is missed but by
the count.

Equal vectors of a label meet once, with their number as weight. Before the
shards, rows that lie close together take each other's links wholesale: in every
shard of the first table that holds over ``CROWD`` rows a pivot is chosen (the
row of the least hash, then the mean of the rows near it); all rows within half
the threshold's angle of the pivot are a clique, as any two of them are linked by
the triangle inequality. A clique is counted by its size, its members never meet
each other, and the next pivot is sought among the rest. What stays of a hot
shard is dealt into groups, every two of which meet in a task of their own, but
for groups of one clique. So no task holds more than two groups, and a group of
close copies costs time in proportion to its size.

Defined results: rows whose label is null or whose vector is null, empty or
zero or holds a null or non-finite component have no links; vectors of unequal
length are never linked; repeated rows and equal vectors are rows of their own
and linked to each other; a null id takes part in links but can't name a
component (it is null if no other id is reachable), and such a row is kept if
its component has no name; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.llm.components import Forest, components
from docframe.ship import ship

COSINE = 0.93
PROJECTIONS, REACH, MISS = 16, 2.2, 1e-5
#: Mean number of rows of a shard; a shard of more than CROWD is searched for cliques, one of more than GROUP is dealt into groups.
SHARD_MEAN, CROWD, GROUP = 512, 1024, 4096
#: Pivots sought in a hot shard, one after the other; what they leave meets group by group.
PIVOTS = 4
SEED = 20250211
#: Cosines of a clique's rows to its pivot are above the half angle's by so much, for rounding.
MARGIN = 1e-9
QUERIES = 256


def calibrated(projections: int = PROJECTIONS, reach: float = REACH, miss: float = MISS) -> int:
    """The greatest number of collisions that a pair at the threshold falls short of with a chance of at most ``miss``."""
    p, short, need = erf(reach / sqrt(2)), 0.0, 0
    for k in range(projections + 1):
        short += comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if short > miss:
            return need
        need = k + 1
    return need


def plan(rows: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """Bits and tables for labels of at most so many rows."""
    bits = min(24, max(0, ceil(log2(max(rows, 1) / SHARD_MEAN))))
    share = (1 - acos(cosine) / pi) ** bits
    return bits, 1 if share == 1 else ceil(log(miss) / log(1 - share))


@lru_cache(maxsize=8)
def directions(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    """n unit vectors (dim, n), orthogonal to each other in groups of dim."""
    rng = np.random.default_rng([seed, dim])
    if not n:
        return np.zeros((dim, 0))
    return np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-n // dim))], 1)[:, :n]


def units(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = values / np.abs(values).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class Window:
    """Collisions of queries with all rows in the sorted projections."""

    def __init__(self, x: np.ndarray, cosine: float, projections: int = PROJECTIONS, reach: float = REACH):
        dim = x.shape[1]
        self.h = x @ directions(dim, projections)
        self.order = np.argsort(self.h, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.h, self.order, 0)
        self.half = reach * sqrt(2 - 2 * cosine) / sqrt(dim)

    def counts(self, a: int, b: int) -> np.ndarray:
        """How often each of the rows a to b collides with every row."""
        n = len(self.h)
        out, row = np.zeros((b - a, n), np.int8), np.arange(b - a)
        for k in range(self.h.shape[1]):
            s, q = self.sorted[:, k], self.h[a:b, k]
            inside = np.zeros((b - a, n + 1), np.int8)
            inside[row, np.searchsorted(s, q - self.half)] = 1
            inside[row, np.searchsorted(s, q + self.half, side="right")] -= 1
            out[:, self.order[:, k]] += np.cumsum(inside[:, :n], axis=1, dtype=np.int8)
        return out


def linked(x: np.ndarray, weight: np.ndarray, keys: np.ndarray, clique: np.ndarray, side: np.ndarray, table: int, cosine: float, need: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a shard: links (by weight) that no earlier table has counted, and the first row it reaches."""
    n = len(x)
    forest, links, window = Forest(n), np.zeros(n, np.int64), Window(x, cosine)
    two = bool((side != side[0]).any())  # two groups that meet each other only
    for a in range(0, n, QUERIES):
        b = min(n, a + QUERIES)
        p, q = np.nonzero(window.counts(a, b) >= need)
        p += a
        ok = (p < q) & ((clique[p] != clique[q]) | (clique[p] < 0))
        if two:
            ok &= side[p] != side[q]
        p, q = p[ok], q[ok]
        for t in range(table):
            met = keys[p, t] == keys[q, t]
            p, q = p[~met], q[~met]
        for c in range(0, len(p), 1 << 14):
            i, j = p[c : c + (1 << 14)], q[c : c + (1 << 14)]
            near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
            i, j = i[near], j[near]
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
            forest.link(i, j)
    return links, forest.root


def _fine(v: Column) -> Column:
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))


def _matrix(column: pa.Array, dim: int, dtype: type) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    return units(np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim).astype(np.float64))


def _cosines(one: pa.Array, two: pa.Array, dtype: type) -> np.ndarray:
    """Row by row, of vectors of any length; ``two`` holds doubles of length 1."""
    as_unit = lambda x: units(np.frombuffer(x, dtype).astype(np.float64)[None])[0]
    return np.array([float(as_unit(x) @ np.frombuffer(y)) for x, y in zip(one.to_pylist(), two.to_pylist(), strict=True)])


def signed(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(node, label, weight, dim, raw, keys): vectors as bytes of their own type, and the shard that names each in every table."""
    kind = nodes.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 1 << np.arange(bits, dtype=np.int64)
        for b in batches:
            size = np.diff(b.column(3).offsets.to_numpy())
            for dim in np.unique(size).tolist():
                s = b.filter(pa.array(size == dim))
                raw = s.column(3).flatten().to_numpy().reshape(-1, dim)
                x = units(raw.astype(np.float64))
                side = x @ directions(dim, bits * tables, SEED + 1) > 0
                keys = side.reshape(len(x), tables, bits) @ power
                raw = pa.array([row.tobytes() for row in raw], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(keys.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([*(s.column(k) for k in range(3)), pa.array(np.full(len(x), dim, np.int32)), raw, lists], ["node", "label", "weight", "dim", "raw", "keys"])

    return nodes.select("node", "label", "weight", F.col("v").alias("v")).mapInArrow(run, f"node long, label {kind}, weight long, dim int, raw binary, keys array<int>")


_PLACE = ["label", "dim", "keys"]


def _first_key() -> Column:
    return F.col("keys")[0]


def cliques(rows: DataFrame, cosine: float, crowd: int, dtype: type, pivots: int = PIVOTS) -> DataFrame:
    """(node, clique): rows within half the threshold's angle of a pivot of their shard of the first table; a clique's name is its least node.

    A round takes one pivot a hot shard; the hot shards are at most rows / crowd,
    each with one vector, and meet the rows by a join on the shard.
    """
    spark, half = rows.sparkSession, float(np.cos(acos(cosine) / 2)) + MARGIN
    where = ["label", "dim", "first"]
    rest = rows.select("node", "label", "dim", "raw", _first_key().alias("first"))
    found = None

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = pa.array(_cosines(b.column(1), pa.array([units(np.frombuffer(y, dtype).astype(np.float64)[None])[0].tobytes() for y in b.column(2).to_pylist()], pa.binary()), dtype) >= half)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok)], ["node"])

    def at(rows: DataFrame, pivot: DataFrame) -> DataFrame:
        """Nodes near the pivot of their shard."""
        return rows.join(pivot, where).select("node", "raw", "pivot").mapInArrow(near, "node long")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of vectors by shard number, as far as a task has read."""
        total: dict = {}
        for b in batches:
            for place, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[place] = total.get(place, 0) + units(np.frombuffer(x, dtype).astype(np.float64)[None])[0]
            if len(total) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["place", "total"])
                total = {}
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tolist() for x in total.values()], pa.list_(pa.float64()))], ["place", "total"])

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units_of = [(x / max(float(np.sqrt(x @ x)), 1e-300)).tobytes() for x in map(np.array, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(units_of, pa.binary())], ["place", "pivot"])

    for _ in range(pivots):
        hot = rest.groupBy(*where).agg(F.count("*").alias("n"), F.min_by("raw", F.struct(F.xxhash64("node"), "node")).alias("pivot")).where(F.col("n") > crowd)
        hot = cut(hot.select(*where, "pivot").withColumn("place", F.monotonically_increasing_id()))
        if hot.isEmpty():
            break
        close = rest.join(at(rest, hot), "node", "left_semi").join(hot.drop("pivot"), where).select("place", "raw")
        parts = close.mapInArrow(means, "place long, total array<double>").select("place", F.posexplode("total").alias("i", "x")).groupBy("place", "i").agg(F.sum("x").alias("x"))
        total = parts.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("total"))
        better = hot.drop("pivot").join(total.mapInArrow(scaled, "place long, pivot binary"), "place")
        mine = rest.join(better, where).select("node", "raw", "pivot", "place")

        def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ok = pa.array(_cosines(b.column(1), b.column(2), dtype) >= half)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(3).filter(ok)], ["node", "place"])

        named = cut(mine.mapInArrow(members, "node long, place long"))
        name = named.groupBy("place").agg(F.min("node").alias("clique"))
        got = cut(named.join(name, "place").select("node", "clique"))
        if got.isEmpty():
            break
        found = got if found is None else found.union(got)
        rest = rest.join(got, "node", "left_anti")
    return found if found is not None else spark.createDataFrame([], "node long, clique long")


def dealt_to_groups(spread: DataFrame) -> DataFrame:
    """Rows of hot shards once for each two groups that meet (``pair``), with their own group (``mine``)."""
    loose = F.col("clique") < 0
    none = F.array().cast("array<long>")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)).otherwise(none)
    salt = F.xxhash64("node", "t", F.lit(3))
    mine = F.when(loose, F.pmod(salt, F.greatest("g_loose", F.lit(1)))).otherwise(F.col("g_loose") + F.pmod(salt, F.greatest("g_close", F.lit(1))))
    spread = spread.withColumn("mine", F.coalesce(mine, F.lit(0).cast("long")))
    code = lambda g: F.struct(F.least(g, F.col("mine")).alias("g"), F.greatest(g, F.col("mine")).alias("h"))
    # a group in one clique meets the loose groups only; all others meet every group
    others = upto(F.when(~loose & F.col("one"), F.col("g_loose")).otherwise(F.col("g_loose") + F.col("g_close")))
    pairs = F.when(F.col("g_loose").isNull(), F.array(F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("h")))).otherwise(F.transform(others, code))
    return spread.withColumn("pair", F.explode(pairs))


def met(rows: DataFrame, dtype: type, cosine: float = COSINE, group: int = GROUP, projections: int = PROJECTIONS) -> DataFrame:
    """(node, n, root): what each shard found for its rows."""
    need = calibrated(projections)
    spread = rows.select("node", "label", "weight", "dim", "raw", "keys", "clique", F.posexplode("keys").alias("t", "key"))
    place = ["label", "dim", "t", "key"]
    # groups of a hot shard: rows in cliques and the others apart, as groups of one clique need not meet
    loose = F.col("clique") < 0
    hot = spread.groupBy(*place).agg(F.sum(loose.cast("long")).alias("n_loose"), F.sum((~loose).cast("long")).alias("n_close"), F.min(F.when(~loose, F.col("clique"))).alias("c0"), F.max(F.when(~loose, F.col("clique"))).alias("c1")).where(F.col("n_loose") + F.col("n_close") > group)
    hot = hot.select(*place, F.ceil(F.col("n_loose") / group).cast("long").alias("g_loose"), F.ceil(F.col("n_close") / group).cast("long").alias("g_close"), (F.col("c0") == F.col("c1")).alias("one"))
    hot = cut(hot)
    if hot.isEmpty():
        spread = spread.withColumns({"mine": F.lit(0).cast("long"), "pair": F.struct(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("h"))})
    else:
        spread = dealt_to_groups(spread.join(hot, place, "left"))
    shard = [F.xxhash64(*place, "pair.g", "pair.h").alias("a"), F.xxhash64(F.lit(1), *place, "pair.g", "pair.h").alias("b")]
    dealt = spread.select(*shard, "t", "dim", "node", "weight", "raw", F.slice("keys", 1, F.col("t")).alias("keys"), "clique", F.col("mine").alias("side"), (F.col("pair.g") != F.col("pair.h")).alias("two")).repartition("a", "b").sortWithinPartitions("a", "b", "node")

    def solve(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]), [True]]))
        for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
            if j - i < 2:
                continue
            s = t.slice(i, j - i)
            side = s.column("side").to_numpy()
            if s.column("two")[0].as_py() and (side == side[0]).all():
                continue  # one of two groups has no row
            x = _matrix(s.column("raw"), s.column("dim")[0].as_py(), dtype)
            keys = s.column("keys").combine_chunks().flatten().to_numpy().reshape(j - i, -1)
            links, root = linked(x, s.column("weight").to_numpy(), keys, s.column("clique").to_numpy(), side, s.column("t")[0].as_py(), cosine, need)
            at = np.flatnonzero(links)
            node = s.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at]), pa.array(node[root[at]])], ["node", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            a = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != a[0]:
                yield from solve(held)
                held = []
            # the last shard of a batch may go on in the next one
            cut_at = int(np.flatnonzero(a != a[-1])[-1]) + 1 if a[0] != a[-1] else 0
            if cut_at:
                yield from solve([*held, batch.slice(0, cut_at)])
                held = []
            held.append(batch.slice(cut_at))
        if held:
            yield from solve(held)

    return dealt.mapInArrow(run, "node long, n long, root long")


def near_copies(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", crowd: int = CROWD, group: int = GROUP, pivots: int = PIVOTS, bits_tables: tuple[int, int] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per input row."""
    ship(vectors.sparkSession)
    single = vectors.schema[embedding].dataType.simpleString() == "array<float>"
    dtype = np.float32 if single else np.float64
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.withColumn("fine", F.col("label").isNotNull() & _fine(F.col("v")))
    may = rows.where("fine").withColumn("h", F.xxhash64("label", "v"))
    nodes = may.groupBy("h", "label", "v").agg(F.count("*").alias("weight"), F.min("vec_id").alias("least"))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, tables = bits_tables or plan(largest, cosine)
    known = cut(signed(nodes, bits, tables))
    close = cliques(known, cosine, crowd, dtype, pivots) if largest > crowd else vectors.sparkSession.createDataFrame([], "node long, clique long")
    known = known.join(close, "node", "left").withColumn("clique", F.coalesce("clique", F.lit(-1).cast("long")))
    found = cut(met(known, dtype, cosine, group))
    size = close.join(nodes.select("node", "weight"), "node").groupBy("clique").agg(F.sum("weight").alias("all"))
    within = close.join(size, "clique").join(nodes.select("node", "weight"), "node").select("node", (F.col("all") - F.col("weight")).alias("n"), F.col("clique").alias("root"))
    found = found.union(within.select("node", "n", "root"))
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    root = cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = nodes.select("node", "h", "label", "v", "weight", "least").join(links, "node", "left").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(least, "root").select("h", "label", "v", "component_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    done = may.join(of, ["h", "label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE k AS (SELECT row_number() OVER () AS rid, vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c : c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c : c <> 0)) > 0 THEN embedding::DOUBLE[] END AS v FROM embeddings),
p AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b, b.vec_id AS b_id FROM k a JOIN k b ON a.label = b.label AND a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT rid AS a, rid AS b FROM k UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT r.a AS rid, min(vec_id) AS component_id FROM r JOIN k ON r.b = k.rid GROUP BY r.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM k JOIN c USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n FROM p GROUP BY a) USING (rid)
"""
