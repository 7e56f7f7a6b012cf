"""SimHash fingerprints and exact near-duplicate links by vantage-point trees.

Copies meet first: links are sought between distinct fingerprints only. Two
fingerprints of 64 bits that differ in at most 3 differ in at most 1 in one of
their halves. So each half (32 bits, distance 1) is searched by vantage points:
a fingerprint lies in the shard named by its half's distances to ``m`` fixed
vantage words. By the triangle inequality two halves at distance 0 lie in one
shard, and at distance 1 in shards whose distances all differ by exactly 1 (one
bit flipped changes every distance by 1). Of two such halves one has an odd
number of bits; every odd one is sent as a guest to the shards across its borders
in which one of its 32 neighbours lies. So a fingerprint is sent at most 33 times
a half, whatever ``m`` is; ``m`` grows with the logarithm of the number of
fingerprints so that a shard holds some hundreds on average.

Within a shard a vantage-point tree is built on the halves of the fingerprints
at home there, halved at the median distance from one of them; a fingerprint,
at home or guest, goes down a branch only if its distance from the vantage point
is within 1 of the branch's range. At the leaves whole fingerprints are
compared. (Trees on whole fingerprints would not prune: distances between
unrelated ones pile up around 32 of 64 bits, so some 60% of rows lie within 3 of
any radius, and a distributed split would copy every row 1.6 times a level.)

A shard with more than ``SHARD_ROWS`` rows is dealt into groups, and every two
of its groups meet in a task of their own, so no task holds more than two
groups. Shards give spanning links (each fingerprint to the least one of its
local component), never all pairs.

``keep_one`` takes such links between texts, and keeps those that an exact check
of the five-word shingle sets finds similar. That distance is close to equality:
texts of similarity 0.8 differ in some 9 of 64 bits. So sets that the fingerprints
have not joined meet once more by their shingles (``shingles``), and no link is lost.

Defined results: texts without a word have fingerprint zero and are linked
like any other; null texts count as empty; very long texts are read whole;
repeated rows are kept; a null id takes part in links but can't name a
component; of several ids the least names it; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.llm import shingles
from docframe.llm.components import Forest, components
from docframe.llm.shingles import Pairs, apart_of, meet_in_shards
from docframe.ship import ship

__all__ = ["fingerprint_documents", "keep_one", "near_duplicates", "near_links"]

BITS_APART = 3
LEAF = 48
#: Mean number of fingerprints that a shard should hold.
SHARD_MEAN = 512
#: A shard of more rows is dealt into groups; rows take 24 bytes, and trees hold comparisons down.
SHARD_ROWS = 1 << 16
#: Vantage words for 32-bit halves; the first ``m`` are used.
VANTAGE = [int(x) for x in np.random.default_rng(20250107).integers(0, 2**32, 10)]
_BIT_ROWS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str, n: int, seed: int = 42) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return [digest(joined, seed)]
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends]]
    return [digest(joined[a:b], seed) for a, b in zip(starts, ends[n - 1 :], strict=False)]


def fingerprints(texts: list, n: int = 3, seed: int = 42) -> np.ndarray:
    """Signed 64-bit fingerprints: a bit is 1 if set in over half of the shingle hashes."""
    out = np.zeros(len(texts), np.uint64)
    for a in range(0, len(texts), 512):
        part = [shingle_hashes(t or "", n, seed) for t in texts[a : a + 512]]
        sizes = np.array([len(p) for p in part])
        doc = np.repeat(np.arange(len(part)), sizes)
        lanes = np.array([h for p in part for h in p], np.uint64).view(np.uint8).reshape(-1, 8)
        fp = np.zeros(len(part), np.uint64)
        for k in range(8):
            set_in = np.bincount(doc * 256 + lanes[:, k], minlength=len(part) * 256).reshape(-1, 256) @ _BIT_ROWS
            for j in range(8):
                fp |= (set_in[:, j] * 2 > sizes).astype(np.uint64) << np.uint64(8 * k + j)
        out[a : a + 512] = fp
    return out.view(np.int64)


def fingerprint_documents(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                s = b.slice(a, 512)
                yield pa.RecordBatch.from_arrays([s.column(0), pa.array(fingerprints(s.column(1).to_pylist(), words))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def compare(x: np.ndarray, i: np.ndarray, j: np.ndarray, most: int, forest: Forest | Pairs) -> int:
    """Links points i and j of x that are at most ``most`` bits apart; the number of comparisons."""
    for a in range(0, len(i), 128):
        rows = i[a : a + 128]
        d = apart_of(x, rows[:, None], j[None, :])
        p, q = np.nonzero(d <= most)
        forest.near(rows[p], j[q], d[p, q])
    return len(i) * len(j)


def tree_links(x: np.ndarray, half: np.ndarray, home: np.ndarray, asking: np.ndarray, most: int, forest: Forest | Pairs) -> int:
    """Links between points at home and points asking whose halves are at most 1 apart, by a vantage-point tree walked as it is built; the number of comparisons."""
    todo, count = [(home, asking)], 0
    while todo:
        h, q = todo.pop()
        if not len(h) or not len(q):
            continue
        split = None
        for at in (len(h) // 2, 0, len(h) - 1, len(h) // 3) if len(h) > LEAF else ():
            v = half[h[at]]
            d = np.bitwise_count(half[h] ^ v).astype(np.int64)
            r = int(np.median(d))
            r -= int((d <= r).all())
            if (d <= r).any():
                split = v, d, r
                break
        if split is None:  # few, or no vantage point parts them
            count += compare(x, q, h, most, forest)
            continue
        v, d, r = split
        e = np.bitwise_count(half[q] ^ v).astype(np.int64)
        todo += [(h[d <= r], q[e <= r + 1]), (h[d > r], q[e >= r])]
    return count


def shard_links(key: np.ndarray, x: np.ndarray, most: int = BITS_APART) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (row, first row of its local component) of rows sorted by key; x: fingerprint, and 2 * half + guest."""
    forest = Forest(len(x))
    fp, what = x[:, 0], x[:, 1]
    half = fp >> (what >> np.uint64(1)) * np.uint64(32) & np.uint64(0xFFFFFFFF)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        if b - a > 1:
            every = np.arange(a, b)
            tree_links(fp, half, every[what[a:b] & np.uint64(1) == 0], every, most, forest)
    linked = np.flatnonzero(forest.root != np.arange(len(x)))
    return linked, forest.root[linked]


def vantage_points(n: int) -> int:
    """How many for n fingerprints: each parts shards by some 2.5 bits (the first by 3.5), as distances of one half are all even or all odd."""
    return int(np.clip(np.ceil((np.log2(max(1, n) / SHARD_MEAN) - 1) / 2.5), 1, len(VANTAGE)))


def in_vantage_shards(distinct: DataFrame, m: int) -> DataFrame:
    """(node, shard, fp, what): every fingerprint at home in one shard a half, and as a guest in those across its borders."""
    def of_half(j: int) -> Column:
        half = F.shiftrightunsigned(F.col("fp"), 32 * j).bitwiseAND(F.lit(0xFFFFFFFF))
        place = lambda x: sum((F.shiftleft((F.bit_count(x.bitwiseXOR(F.lit(v))) + 1).cast("long"), 6 * i) for i, v in enumerate(VANTAGE[:m])), F.lit(j << 62))
        row = lambda shard, what: F.struct(shard.alias("shard"), F.lit(what).cast("long").alias("what"))
        own = F.array(row(place(half), 2 * j))
        across = F.array_distinct(F.transform(F.array(*[F.lit(1 << b).cast("long") for b in range(32)]), lambda bit: place(half.bitwiseXOR(bit))))
        guests = F.transform(across, lambda s: row(s, 2 * j + 1))
        return F.when(F.bit_count(half) % 2 == 1, F.concat(own, guests)).otherwise(own)

    shards = [of_half(0), of_half(1)]
    return distinct.select(F.col("fp").alias("node"), "fp", F.explode(F.concat(*shards)).alias("s")).select("node", "s.shard", "fp", "s.what")


def near_links(distinct: DataFrame, most: int = BITS_APART, shard_rows: int | None = None, m: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints that span all pairs at most 3 bits apart."""
    if most > 3:
        raise ValueError("halves at distance 1 are exact up to 3 bits")
    ship(distinct.sparkSession)
    m = m or vantage_points(distinct.count())
    return meet_in_shards(in_vantage_shards(distinct, m), ["fp", "what"], most, shard_rows or SHARD_ROWS, shard_links)


def near_duplicates(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per input row."""
    fps = cut(fingerprint_documents(docs, words, doc_id, text))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = cut(components(near_links(nodes)))
    root = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    name = root.groupBy("root").agg(F.min("least").alias("component_id"))
    of = root.join(name, "root").select("fp", "component_id")
    return fps.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_pairs(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): of the ``nodes`` (node), which are keys of ``texts`` (key, text), pairs that span all whose fingerprints are at most 3 bits apart."""
    fps = cut(fingerprint_documents(texts, doc_id="key").join(nodes.select(F.col("node").alias("doc_id")), "doc_id"))
    heads = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("head")))
    of = lambda x: heads.select(F.col("fp").alias(x), F.col("head").alias(f"of_{x}"))
    same = fps.join(heads, "fp").where("doc_id <> head").select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    across = cut(near_links(heads.select("fp"))).join(of("a"), "a").join(of("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    return same.union(across)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of similar texts, near fingerprints first; see ``shingles`` for which. Columns as they are."""
    return shingles.keep_one(docs, near_pairs)
