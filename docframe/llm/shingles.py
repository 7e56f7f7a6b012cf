"""Near copies by five-word shingle sets: one row of each group of similarity 0.8 or more, exactly.

Texts with equal shingle sets meet by a hash of the set. Distinct sets meet in
shards keyed by the shingles of their prefix: of s shingles the first
s - ceil(0.8 s) + 1 in one order of all, of which two sets of similarity 0.8
share at least one. Such a pair is looked for where it meets first: in the shard
of its first common shingle, before which both hold only shingles of their own, so
the places of that shingle in their orders bound what they share, and the shingles
just before it differ. Shards where neither can be are passed over. Shards that
hold the same sets are searched once, at the first of their shingles. A set's
fingerprint has, for each of 256 classes of its shingles, their number mod 16 in
a code (Johnson's) whose differing bits are the difference of the numbers; so
two sets differ in at least as many shingles as their fingerprints in bits.
Vantage-point trees find the fingerprints of a shard that are near enough. Those
pairs that sizes, fingerprints and finer counts of the same kind (as many classes
as half the set's shingles) leave a chance are compared by whole shingle sets, first those that span each shard, and where one of them is not similar,
those it stood for (``confirmed``).

Only texts that take part in a comparison are exchanged, and only rows that may
go are met with the list of rows that go: a bit set of bounded size, made from
the keys, tells the others (``sieve``). If there are too many keys for it, it
tells fewer, and more rows are exchanged; results don't depend on it.

Defined results: null texts count as empty, and all texts without a word are
equal; rows with a null id stay; of a group the row with the least id stays (of
several, with the least hash of the text; of rows equal in id and text, one);
rows of one id whose texts are not similar are groups of their own; very long
texts are read whole; an empty table gives no rows; all columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.llm.components import Forest, components
from docframe.llm.textkit import LOWER, NOT_BLANK, Texts, chain, hash_spans, slices
from docframe.ship import ship

SHARD_ROWS = 1024
LEAF = 48
SIMILAR = 0.8
#: Longs of a set's counts: 16 classes each, 4 bits a class.
COUNT_LONGS = 16
#: Pairs a row that are compared at first where a forest's were not similar.
NEAREST = 16
#: The order of shingles looks at so many texts, and knows so many shingles as common.
ORDER_TEXTS, ORDER_SHINGLES = 5000, 200_000
#: Bits of a sieve.
SIEVE_BITS = 1 << 24
#: Johnson's code of 0..15: neighbours, in the round, differ in one bit.
_JOHNSON = np.array([(1 << v) - 1 if v <= 8 else 0xFF & ~((1 << (v - 8)) - 1) for v in range(16)], np.uint8)


class Pairs:
    """Near pairs of numbered points, thinned to a least spanning forest whenever there are many."""

    MOST = 1_000_000

    def __init__(self, n: int):
        self.n, self.held, self.size = n, [], 0

    def near(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        self.held.append((np.minimum(a, b), np.maximum(a, b), apart.astype(np.int16)))
        self.size += len(a)
        if self.size > self.MOST:
            self.held = [self.forest()]
            self.size = len(self.held[0][0])

    def forest(self, whole: Forest | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, apart) of a least spanning forest (of what ``whole`` has not joined yet): every part takes its nearest pair to another part, until none is left."""
        a, b, apart = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*self.held, strict=True) if self.held else ((), (), ())))
        order = np.lexsort((b, a, apart))
        a, b, apart = a[order], b[order], apart[order]
        whole, kept, at = whole or Forest(self.n), [], np.arange(len(a))
        while len(at := at[whole.root[a[at]] != whole.root[b[at]]]):
            best = np.full(self.n, len(a))
            np.minimum.at(best, whole.root[a[at]], at)
            np.minimum.at(best, whole.root[b[at]], at)
            best = np.unique(best[best < len(a)])
            kept.append(best)
            whole.link(a[best], b[best])
        kept = np.concatenate([np.zeros(0, np.int64), *kept])
        return a[kept], b[kept], apart[kept]


class Spanning(Pairs):
    """Pairs that span all near ones; those whose ends are joined already are dropped as they come."""

    def __init__(self, n: int):
        super().__init__(n)
        self.whole, self.kept = Forest(n), []

    def near(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        new = self.whole.root[a] != self.whole.root[b]
        if new.any():
            self.held = [(a[new], b[new], apart[new].astype(np.int16))]
            self.kept.append(self.forest(self.whole))


class Nearest(Pairs):
    """Near pairs between points of different components ``of``: those among the ``k`` nearest of one of their ends."""

    def __init__(self, of: np.ndarray, k: int):
        super().__init__(len(of))
        self.of, self.k, self.more = of, k, np.zeros(len(of), bool)

    def near(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        ok = self.of[a] != self.of[b]
        super().near(a[ok], b[ok], apart[ok])

    def forest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, apart); ``more`` marks points of which pairs were left out."""
        a, b, apart = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*self.held, strict=True) if self.held else ((), (), ())))
        order = np.lexsort((b, a, apart))
        a, b, apart = a[order], b[order], apart[order]
        end, at = np.concatenate([a, b]), np.tile(np.arange(len(a)), 2)
        order = np.lexsort((at, end))
        place = np.arange(len(end)) - np.searchsorted(end[order], end[order])
        kept = np.zeros(len(a), bool)
        kept[at[order[place < self.k]]] = True
        self.more[a[~kept]] = True
        return a[kept], b[kept], apart[kept]


def apart_of(x: np.ndarray, a, b) -> np.ndarray:
    """Differing bits of points a and b of x, which has one or several words a point."""
    if x.ndim == 1:
        return np.bitwise_count(x[a] ^ x[b])
    return sum(np.bitwise_count(x[a, k] ^ x[b, k]).astype(np.int16) for k in range(x.shape[1]))


def _compare(x: np.ndarray, i: np.ndarray, j: np.ndarray | None, most: int, forest: Forest | Pairs) -> None:
    """Near pairs of points i and points j (None: among themselves)."""
    other = i if j is None else j
    if not len(i) or not len(other):
        return
    for a in range(0, len(i), 128):
        rows = i[a : a + 128]
        d = apart_of(x, rows[:, None], other[None, :])
        p, q = np.nonzero(d <= most if j is not None else (d <= most) & (rows[:, None] < other[None, :]))
        forest.near(rows[p], other[q], d[p, q])


def tree_links(x: np.ndarray, points: np.ndarray, most: int, forest: Forest | Pairs) -> None:
    """All links within ``points`` of x, by a vantage-point tree walked as it is built."""
    todo = [points]
    while todo:
        p = todo.pop()
        if len(p) <= LEAF:
            _compare(x, p, None, most, forest)
            continue
        d = apart_of(x, p, p[len(p) // 2]).astype(np.int64)
        r = int(np.median(d))
        near, far = p[d <= r], p[d > r]
        if not len(far):
            near, far = p[d < r], p[d >= r]
            if not len(near):  # all at one distance: this vantage point can't part them
                _compare(x, p, None, most, forest)
                continue
            r -= 1
        dn, df = d[d <= r], d[d > r]
        _compare(x, near[dn > r - most], far[df <= r + most], most, forest)
        todo += [near, far]


def _shards(key: np.ndarray, x: np.ndarray, most: int, sink: Forest | Pairs) -> None:
    """All near pairs of rows of one key; rows are sorted by key, x holds their fingerprints."""
    n = len(x)
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(cuts)
    small = np.repeat(size <= LEAF, size)
    for s in range(1, min(LEAF, int(size.max(initial=0)) + 1)):
        ok = (key[s:] == key[:-s]) & small[s:]
        if not ok.any():
            break
        i = np.flatnonzero(ok)
        d = apart_of(x, i, i + s)
        i, d = i[d <= most], d[d <= most]
        sink.near(i, i + s, d)
    for c in np.flatnonzero(size > LEAF):
        tree_links(x, np.arange(cuts[c], cuts[c + 1]), most, sink)


class Sized:
    """Hands on the pairs that sizes, counts and places of their sets leave a chance of similarity 0.8 and of meeting here first.

    Exact for counts, see ``class_counts``. ``pos`` is the place of the shard's shingle in
    a set's order, ``prev`` the shingle before it: in the shard where a pair meets first,
    the sets share at most what is left from there on, and have different shingles before.
    """

    def __init__(self, sink: Pairs, n: np.ndarray, pos: np.ndarray, prev: np.ndarray):
        self.sink, self.n, self.pos, self.prev = sink, n, pos, prev

    def near(self, a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> None:
        na, nb = self.n[a], self.n[b]
        ok = (apart.astype(np.int64) * 9 <= na + nb) & (np.maximum(na, nb) * 4 <= np.minimum(na, nb) * 5)
        ok &= np.minimum(na - self.pos[a], nb - self.pos[b]) * 9 >= (na + nb) * 4
        ok &= (self.prev[a] != self.prev[b]) | (self.pos[a] == 0) | (self.pos[b] == 0)
        self.sink.near(a[ok], b[ok], apart[ok])


def set_pairs(key: np.ndarray, x: np.ndarray, most: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (counts, size, place, shingle before, component if k) that may be similar, the row with fewer of them first.

    k = 0: pairs that span them all. Otherwise pairs of different components, the
    ``k`` nearest of each row; a row paired with itself has more of them.
    """
    n, pos, prev = x[:, COUNT_LONGS].astype(np.int64), x[:, COUNT_LONGS + 1].astype(np.int64), x[:, COUNT_LONGS + 2]
    pairs = Nearest(x[:, COUNT_LONGS + 3], k) if k else Spanning(len(x))
    _shards(key, johnson(x[:, :COUNT_LONGS]), min(most, int(n.max(initial=0)) * 2 // 9), Sized(pairs, n, pos, prev))
    a, b, _ = pairs.forest() if k else tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*pairs.kept, strict=True) if pairs.kept else ((), (), ())))
    degree = np.bincount(a, minlength=len(x)) + np.bincount(b, minlength=len(x))
    swap = degree[a] > degree[b]
    more = np.flatnonzero(pairs.more) if k else np.zeros(0, np.int64)
    return np.concatenate([np.where(swap, b, a), more]), np.concatenate([np.where(swap, a, b), more])


def meet_in_shards(rows: DataFrame, words: list[str], most: int, shard_rows: int | None, links_of: Callable, within: bool = False, wide: DataFrame | None = None, where: bool = False) -> DataFrame:
    """(a, b; ``where``: and their shard): links between rows (node, shard, words of the fingerprint) of one shard, spanning all pairs at most ``most`` bits apart.

    A hot shard is dealt into groups of some ``shard_rows``. Every two of them
    meet in a task (``within``: each meets itself only). Where rows have a
    component (``root``), those of a hot shard's largest one need not meet each
    other: its groups meet those of all other rows only. Of shards of the same
    rows the one with the least places (``pos``) is searched.
    """
    shard_rows = shard_rows or SHARD_ROWS
    by_root = "root" in rows.columns
    groups = lambda n: F.ceil(n / shard_rows).cast("long")
    if by_root:
        each = rows.groupBy("shard", "root").agg(F.count("*").alias("count"), F.sum("pos").alias("pos"), F.bit_xor(F.xxhash64("node")).alias("nodes"))
        of = each.groupBy("shard").agg(F.sum("count").alias("size"), F.sum("pos").alias("pos"), F.max(F.struct("count", "root")).alias("top"), F.count("*").alias("roots"), F.bit_xor("nodes").alias("nodes"))
        # with one component there is nothing to find; shards of the same rows are searched once
        of = of.where("roots > 1").groupBy("size", "roots", "nodes", "top").agg(F.min_by("shard", F.struct("pos", "shard")).alias("shard")).select("shard", F.col("top.root").alias("major"), groups(F.col("top.count")).alias("majors"), groups(F.col("size") - F.col("top.count")).alias("groups"), (F.col("size") > shard_rows).alias("is_hot"))
        rows = rows.join(of, "shard").withColumn("is_major", F.col("is_hot") & (F.col("root") == F.col("major")))
    else:
        # a hot shard has over shard_rows of the rows, so this table is at most rows / shard_rows long
        of = rows.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard", groups(F.col("count")).alias("groups"), F.lit(0).cast("long").alias("majors"), F.lit(True).alias("is_hot"))
        rows = rows.join(of, "shard", "left").withColumn("is_major", F.lit(False))
    n = F.when(F.coalesce("is_hot", F.lit(False)), F.col("groups")).otherwise(F.lit(1).cast("long"))
    mine = F.pmod(F.xxhash64("node", "shard", F.lit(7)), F.when(F.col("is_major"), F.col("majors")).otherwise(n))
    rows = rows.withColumn("of_groups", n).withColumn("mine", mine)
    upto = lambda k: F.sequence(F.lit(0).cast("long"), k - 1)
    code = lambda x, y: x * 2097152 + y
    each = F.transform(upto(F.col("of_groups")), lambda g: code(F.least(g, F.col("mine")), F.greatest(g, F.col("mine"))))
    cross = 1 << 44  # apart from the codes of two groups of other rows
    to_major = F.when(F.col("is_hot") & (F.col("majors") > 0), F.transform(upto(F.greatest("majors", F.lit(1))), lambda g: code(g, F.col("mine")) + cross)).otherwise(F.array().cast("array<long>"))
    pairs = F.array(code(F.col("mine"), F.col("mine"))) if within else F.when(F.col("is_major"), F.transform(upto(F.col("of_groups")), lambda g: code(F.col("mine"), g) + cross)).otherwise(F.concat(each, to_major))
    rows = rows.select("node", "shard", F.explode(pairs).alias("pair"), *(x for x in words if x in rows.columns))
    rows = rows.join(wide, "node") if wide is not None else rows
    key = F.xxhash64("shard", "pair")
    rows = rows.select(key.alias("key"), "shard", "pair", "node", *words).repartition("key").sortWithinPartitions("key", "shard", "pair", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            col = [t.column(k).to_numpy() for k in range(3)]
            new = np.zeros(t.num_rows, np.int64)
            new[1:] = np.any([c[1:] != c[:-1] for c in col], 0)
            x = [t.column(k).to_numpy().view(np.uint64) for k in range(4, t.num_columns)]
            a, b = links_of(np.cumsum(new), x[0] if len(x) == 1 else np.stack(x, 1), most)
            node = t.column(3).to_numpy()
            columns = [node[a], node[b], *([t.column(1).to_numpy()[a]] if where else [])]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "shard"][: len(columns)])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(0).to_numpy()
            if held and held[0].column(0)[0].as_py() != k[0]:
                yield links(held)
                held = []
            # the last key of a batch may go on in the next one
            at = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
            if at:
                yield links([*held, batch.slice(0, at)])
                held = []
            held.append(batch.slice(at))
        if held:
            yield links(held)

    return rows.mapInArrow(run, "a long, b long" + ", shard long" * where)


def by_text(of: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
    """The order by text number, then key."""
    order = np.argsort(key)
    return order[np.argsort(of[order].astype(np.int16 if n < 1 << 15 else np.int64), kind="stable")]


def shingle_sets(t: Texts, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct shingles of each text, both ascending; of fewer than n words, one of them all."""
    s, e, doc = t.spans(NOT_BLANK)
    (h,) = hash_spans(LOWER[t.buf], s, e)
    size = np.bincount(doc, minlength=t.n)
    g = chain(h, n)
    ok = doc[n - 1 :] == doc[: len(g)]
    short = np.flatnonzero((size > 0) & (size < n))
    first = np.searchsorted(doc, short)
    own = np.array([chain(h[a : a + k], k)[0] for a, k in zip(first, size[short], strict=True)], np.uint64)
    g, of = np.concatenate([g[ok], own]), np.concatenate([doc[: len(g)][ok], short])
    order = by_text(of, g, t.n)
    g, of = g[order], of[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    return g[fresh], of[fresh]


def similarities(a: Texts, b: Texts) -> np.ndarray:
    """Jaccard similarity of the shingle sets of text k of a and text k of b; 1 for two texts without words."""
    (ga, oa), (gb, ob) = shingle_sets(a), shingle_sets(b)
    g, of = np.concatenate([ga, gb]), np.concatenate([oa, ob])
    order = by_text(of, g, a.n)
    g, of = g[order], of[order]
    both = np.bincount(of[1:][(g[1:] == g[:-1]) & (of[1:] == of[:-1])], minlength=a.n)
    union = np.bincount(of, minlength=a.n) - both
    return np.where(union > 0, both / np.maximum(1, union), 1.0)


def _mixed(g: np.ndarray) -> np.ndarray:
    x = (g ^ g >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ x >> np.uint64(29)


def class_counts(g: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per set (COUNT_LONGS columns): how many of its shingles are in each of 256 classes, mod 16.

    A shingle that only one of two sets holds changes one class by one. At
    similarity 0.8 or more those are at most a ninth of the sum of the sizes,
    so a pair whose counts differ by more (in the round) is not similar.
    """
    classes = 16 * COUNT_LONGS
    c = np.bincount(of * classes + (_mixed(g) >> np.uint64(56)).astype(np.int64), minlength=n * classes).reshape(n, classes).astype(np.uint8)
    return (c[:, ::2] & 15 | (c[:, 1::2] & 15) << 4).view("<u8")


def fine_counts(g: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """Per set: the same in as many classes (a power of two, 2 at least) as half its shingles, two classes a byte."""
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(2, np.bincount(of, minlength=n)) / 2)).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(1 << bits)])
    c = np.bincount(begin[of] + (_mixed(_mixed(g)) >> (64 - bits[of]).astype(np.uint64)).astype(np.int64), minlength=begin[-1]).astype(np.uint8) & 15
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((begin // 2).astype(np.int32)), pa.py_buffer(c[::2] | c[1::2] << 4)])


def fine_apart(a: bytes, b: bytes) -> int:
    """At least so many shingles are in only one of two sets."""
    x, y = (np.stack([z & 15, z >> 4], 1).reshape(-1) for z in (np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)))
    while len(x) != len(y):
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(-1, 2).sum(1, dtype=np.uint8) & 15
    d = (x - y) & 15
    return int(np.minimum(d, 16 - d).sum())


def johnson(x: np.ndarray) -> np.ndarray:
    """Fingerprints, two longs for each long of counts."""
    b = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)
    return np.stack([_JOHNSON[b & 15], _JOHNSON[b >> 4]], 2).reshape(len(x), -1).view("<u8")

def prefixes(g: np.ndarray, of: np.ndarray, n: int, common: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, offsets): of each set of s shingles the first s - ceil(0.8 s) + 1 in an order of all shingles.

    Two sets of similarity 0.8 or more share at least ceil(0.8 s) shingles, so
    also one of these, whatever the order. It takes shingles rare in a sample
    first (``common``, ascending, and how often they were ``seen``).
    """
    i = np.minimum(np.searchsorted(common, g), max(0, len(common) - 1))
    often = np.where(common[i] == g, seen[i], 0) if len(common) else np.zeros(len(g), np.int64)
    order = by_text(of, np.minimum(often, 4095).astype(np.uint64) << np.uint64(52) | _mixed(g) >> np.uint64(12), n)
    size = np.bincount(of, minlength=n)
    first = np.cumsum(size) - size
    take = np.where(size > 0, size - -(-size * 4 // 5) + 1, 0)
    inside = np.arange(len(g)) - np.repeat(first, size) < np.repeat(take, size)
    return g[order][inside], np.concatenate([[0], np.cumsum(take)])


def compared(texts: DataFrame, sets: DataFrame, proposed: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(a, b, ok): the pairs of keys of ``texts`` (key, text), and whether they have a similarity of ``least`` or more.

    Sizes and fine counts (``sets``: node, n, fine) rule out most of the others; the texts
    of the rest meet. They join the end with fewer pairs first, so rows grow only by
    texts of their own; at the other end a hub's rows are as wide as their texts,
    and are split by size.
    """
    u, v = F.least("a", "b"), F.greatest("a", "b")
    ends = proposed.groupBy(u.alias("u"), v.alias("v")).agg(F.sum(F.when(F.col("a") == u, 1).otherwise(-1)).alias("s"))
    ends = cut(ends.select(F.when(F.col("s") >= 0, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(F.col("s") >= 0, F.col("v")).otherwise(F.col("u")).alias("b")).where("a <> b"))
    fine = sieved(sets.select("node", "n", "fine"), "node", sieve(ends.select("a").union(ends.select("b")), "a"))
    one, two = (fine.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("fine").alias(f"fine_{x}")) for x in "ab")

    def rule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = b.column(2).to_numpy() + b.column(4).to_numpy()
            may = [9 * fine_apart(x.as_py(), y.as_py()) <= n for x, y, n in zip(b.column(3), b.column(5), both.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(may, pa.bool_())], ["a", "b", "may"])

    ruled = cut(ends.join(one, "a").join(two, "b").select("a", "b", "n_a", "fine_a", "n_b", "fine_b").mapInArrow(rule, "a long, b long, may boolean"))
    ends = ruled.where("may").select("a", "b")
    texts = sieved(texts, "key", sieve(ends.select("a").union(ends.select("b")), "a")).groupBy("key").agg(F.first("text").alias("text"))
    one = ends.join(texts, F.col("a") == F.col("key")).select("a", "b", F.col("text").alias("text_a"))
    two = one.join(texts, F.col("b") == F.col("key")).select("a", "b", "text_a", F.col("text").alias("text_b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, t in slices(batch.column(2), 1 << 20):
                other = next(slices(batch.column(3)[part], 1 << 62))[1]
                ok = pa.array(similarities(t, other) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], ok], ["a", "b", "ok"])

    return two.mapInArrow(check, "a long, b long, ok boolean").union(ruled.where("not may").select("a", "b", F.lit(False)))


def rooted(pairs: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) whose ends lie in different components, with these (ra, rb)."""
    for x in "ab":
        pairs = pairs.join(linked.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(f"r{x}", F.coalesce(f"r{x}", x))
    return pairs.where("ra <> rb")


def confirmed(texts: DataFrame, sets: DataFrame, dealt: DataFrame, meet: Callable[[DataFrame, int], DataFrame], near: int = NEAREST, first: DataFrame | None = None) -> DataFrame:
    """(node, root): components of the pairs of near rows (node, shard, ...) of one shard whose texts are similar.

    Pairs of ``first`` (a, b) are compared before all others; what they join is not
    compared again. ``meet(rows, 0)`` proposes a forest that spans the near pairs of each
    shard (of each group of a hot one). A pair of it that is not similar may stand for
    others of its shard that are, so a shard's rows go on if such a pair of that shard
    leaves their component, and all rows of a hot shard: ``meet(rows, k)``, rows having
    their component in ``root``, proposes for each row its k nearest of other components.
    k grows until no near pair was left out. So in the end each near pair was compared,
    or has both ends in one component.
    """
    none = dealt.limit(0).select(F.col("node").alias("a"), F.col("node").alias("b"))
    linked = cut(components(cut(compared(texts, sets, none if first is None else first)).where("ok")))
    forest = cut(meet(dealt, 0))
    done = cut(compared(texts, sets, rooted(forest, linked).select("a", "b")))
    linked = cut(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(done.where("ok").select("a", "b"))))
    failed = done.where("not ok").select("a", "b")
    hot = cut(dealt.groupBy("shard").count().where(F.col("count") > SHARD_ROWS).select("shard"))
    any_hot = hot.limit(1).count() > 0
    while True:
        pairs = rooted(forest, linked)
        going = cut(pairs.select("shard", F.col("ra").alias("root")).union(pairs.select("shard", F.col("rb").alias("root"))).distinct())
        if not any_hot and not going.limit(1).count():
            return linked
        # rows of the shards in doubt only, and of these the components that a failed pair leaves
        of = lambda shards: dealt.join(shards, "shard", "left_semi").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")).select(*dealt.columns, "root")
        rows = of(going.select("shard").distinct()).join(going, ["shard", "root"], "left_semi").select(*dealt.columns, "root")
        if any_hot:
            rows = rows.join(hot, "shard", "left_anti").union(of(hot)).select(*dealt.columns, "root")
        proposed = cut(meet(cut(rows), near))  # which reads its rows more than once
        seen = failed.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
        fresh = proposed.where("a <> b").join(seen, (F.least("a", "b") == F.col("u")) & (F.greatest("a", "b") == F.col("v")), "left_anti").select("a", "b")
        done = cut(compared(texts, sets, fresh))
        linked = cut(components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).union(done.where("ok").select("a", "b"))))
        if not proposed.where("a = b").limit(1).count():
            return linked
        failed, near = failed.union(done.where("not ok").select("a", "b")), near * 16


def common_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, count) of a sample of texts, ascending; only the order of ``prefixes`` depends on it, and no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in slices(b.column(0)):
                key, c = np.unique(shingle_sets(t)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], ["g", "c"])

    part = max(1, rows.count() // ORDER_TEXTS)
    sample = rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(part)) == 0).select("text")
    got = sample.mapInArrow(run, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).where("c > 3").orderBy(F.desc("c"), "g").limit(ORDER_SHINGLES).toArrow()
    g = got.column("g").to_numpy().view(np.uint64)
    order = np.argsort(g)
    return g[order], got.column("c").to_numpy()[order]


def sieve(keys: DataFrame, key: str, bits: int = SIEVE_BITS) -> np.ndarray:
    """A bit set of the keys (mod ``bits``, a power of two): at most bits / 64 numbers, however many keys there are."""
    at = F.pmod(F.col(key), F.lit(bits)).alias("at")
    got = keys.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("set")).toArrow()
    out = np.zeros(max(1, bits // 64), np.int64)
    out[got.column("word").to_numpy()] = got.column("set").to_numpy()
    return out.view(np.uint64)


def sieved(df: DataFrame, key: str, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """Rows whose key may be in the sieve, or (``inside`` False) the others; a null key never is. Columns as they are."""
    shared, at = ship(df.sparkSession).sparkContext.broadcast(bits), df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(at).fill_null(0).to_numpy().view(np.uint64) & np.uint64(64 * len(shared.value) - 1)
            hit = (shared.value[(k >> np.uint64(6)).astype(np.int64)] >> (k & np.uint64(63)) & np.uint64(1) == 1) & b.column(at).is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(hit == inside))

    return df.mapInArrow(run, df.schema)


def row_key() -> Column:
    """Null for rows without an id."""
    return F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def fates(docs: DataFrame, first: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, stays, n): for every row key whether its row is the one of its group that stays, and how many rows have it.

    ``first(texts, nodes)`` may propose pairs (a, b) of nodes, which are keys of ``texts`` (key, text).
    """
    spark = ship(docs.sparkSession)
    names = [f"c{k}" for k in range(COUNT_LONGS)]
    rows = docs.where(F.col("doc_id").isNotNull()).select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(common_shingles(rows))

    def prints(batches: Iterator[pa.RecordBatch], full: bool = False) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in slices(b.column(2), 1 << 20):
                g, of = shingle_sets(t)
                whole = np.zeros(t.n, np.uint64)
                np.add.at(whole, of, (g ^ g >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD))
                columns = [b.column(0)[part], b.column(1)[part], pa.array(whole.view(np.int64)), pa.array(np.bincount(of, minlength=t.n))]
                if full:
                    c = class_counts(g, of, t.n)
                    first, offsets = prefixes(g, of, t.n, *shared.value)
                    columns += [*(pa.array(c[:, k].copy().view(np.int64)) for k in range(COUNT_LONGS)), fine_counts(g, of, t.n)]
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(first.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["key", "doc_id", "whole", "n", *([*names, "fine", "prefix"] if full else [])])

    longs = "key long, doc_id long, whole long, n long"
    sets = rows.mapInArrow(partial(prints, full=True), longs + "".join(f", {x} long" for x in names) + ", fine binary, prefix array<long>")
    sets = cut(sets.groupBy("whole", "n").agg(F.min("key").alias("node"), *[F.first(x).alias(x) for x in (*names, "fine", "prefix")]))
    at = F.transform("prefix", lambda x, i: F.struct(x.alias("shard"), i.cast("long").alias("pos"), F.coalesce(F.get("prefix", i - 1), F.lit(0)).alias("prev")))
    firsts = sets.where("n > 0").select("node", F.explode(at).alias("at")).select("node", "at.*")
    # most shingles are one set's own: those go before anything else is exchanged with them
    firsts = cut(sieved(firsts, "shard", sieve(firsts.groupBy("shard").agg(F.count("*").alias("size")).where("size > 1"), "shard")))
    shards = firsts.groupBy("shard").agg(F.count("*").alias("size"), F.sum("pos").alias("pos"), F.bit_xor(F.xxhash64("node")).alias("nodes")).where("size > 1")
    shards = shards.groupBy("size", "nodes").agg(F.min_by("shard", F.struct("pos", "shard")).alias("shard"))  # places rise with the order of all, in every set
    dealt = cut(firsts.join(shards.select("shard"), "shard", "left_semi"))

    def meet(rows: DataFrame, k: int) -> DataFrame:
        return meet_in_shards(rows, [*names, "n", "pos", "prev", *(["root"] if k else [])], 64 * 2 * COUNT_LONGS, SHARD_ROWS, partial(set_pairs, k=k), not k, sets.where("n > 0").select("node", "n", *names), True)

    texts = rows.select("key", "text")
    linked = confirmed(texts, sets, dealt, meet, first=first(texts, sets.select("node")) if first else None)
    roots = sets.join(linked.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("whole", "n", F.coalesce("root", "node").alias("root"))
    members = cut(rows.mapInArrow(prints, longs).join(roots, ["whole", "n"]).select("key", "doc_id", "root"))
    best = members.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("best"))
    return members.join(best, "root").groupBy("key").agg(F.max(F.col("key") == F.col("best.key")).alias("stays"), F.count("*").alias("n"))


def keep_one(docs: DataFrame, first: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row of each group of similar texts; see the module for which, and ``fates`` for ``first``. Columns as they are."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    fate = cut(fates(docs, first))
    bits = sieve(fate.where("not stays or n > 1"), "key")
    rows = docs.withColumn(key, row_key())
    doubtful = sieved(rows, key, bits).join(fate.where("not stays").select(F.col("key").alias(key)), key, "left_anti").dropDuplicates([key])
    return sieved(rows, key, bits, inside=False).unionByName(doubtful).select(*[F.col(f"`{c}`") for c in docs.columns])
