"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Documents that share a run of ``seed`` words with a test item are the
candidates; for each candidate the longest common unmarked runs are marked
one after the other, in test and document, until none of ``seed`` words is
left. The share of the test's words so covered decides; order does not matter,
so shuffled passages are caught as well.

The benchmark is read in blocks of bounded size, each sent to all workers; a
larger benchmark means more blocks, not a larger one. Documents are never
shuffled.

A test of fewer than ``seed`` words has no tile of that length. It counts as
covered by a document that has it as a line of its own, whole.

Defined results: null and empty texts are clean; tests without a word cover
nothing; very long texts and tests are read whole; a test with a null id counts
but is not listed in ``item_ids``; a null doc_id keeps its row; repeated tests
and rows are judged each (equal ids are listed each); of equally long tiles the
first in the document is marked first; coverage of exactly the limit counts; an
empty table gives no rows, an empty benchmark leaves all clean. Extra columns of
documents are kept by ``drop_contaminated`` and not read by ``contamination``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.textkit import ALNUM, LOWER, Texts, chain, hash_spans, slices
from docframe.llm.toxicity import keep_rows
from docframe.ship import ship

SEED = 5
COVERAGE = 0.5
BLOCK_CHARS = 8_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False


def _windows(h: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of s items (all multiplied to a common power)."""
    n = len(h)
    power = np.ones(n + 1, np.uint64)
    np.multiply.accumulate(np.full(n, _BASE), out=power[1:])
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n])])
    return (total[s:] - total[:-s]) * power[: n - s + 1][::-1]


def _free(marked: np.ndarray, s: int) -> np.ndarray:
    """Starts of windows of s unmarked items."""
    c = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(c[s:] == c[:-s]) if len(marked) >= s else np.zeros(0, np.int64)


def tiles(test: np.ndarray, doc: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """(start in test, start in doc, length) of the greedy tiling, longest first."""
    in_test, in_doc = np.zeros(len(test), bool), np.zeros(len(doc), bool)

    def common(s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        i, j = _free(in_test, s), _free(in_doc, s)
        if not len(i) or not len(j):
            return i[:0], j[:0], i[:0], j[:0]
        # windows are compared at one power: both sides are padded to the same length
        n = max(len(test), len(doc))
        a, b = (_windows(np.concatenate([x, np.zeros(n - len(x), np.uint64)]), s) for x in (test, doc))
        a, b = a[i], b[j]
        return i[np.isin(a, b)], j[np.isin(b, a)], a[np.isin(a, b)], b[np.isin(b, a)]

    out, top = [], min(len(test), len(doc))
    while top >= least:
        lo, hi = least - 1, top
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if len(common(mid)[0]) else (lo, mid - 1)
        if lo < least:
            break
        i, j, a, b = common(lo)
        at: dict[int, list[int]] = {}
        for k, key in zip(i.tolist()[::-1], a.tolist()[::-1], strict=True):
            at.setdefault(key, []).append(k)
        found = False
        for q, key in zip(j.tolist(), b.tolist(), strict=True):
            if in_doc[q : q + lo].any():
                continue
            open_ = at[key]
            while open_ and in_test[open_[-1] : open_[-1] + lo].any():
                open_.pop()
            if open_ and (test[open_[-1] : open_[-1] + lo] == doc[q : q + lo]).all():
                p = open_.pop()
                in_test[p : p + lo] = in_doc[q : q + lo] = True
                out.append((p, q, lo))
                found = True
        top = lo if found else lo - 1
    return out


class Block:
    """Some tests, ready to be met by documents."""

    def __init__(self, items: list[tuple[int, str]], seed: int):
        self.seed = seed
        t = Texts.of([x or "" for _, x in items])
        s, e, of = t.spans(ALNUM)
        (h,) = hash_spans(LOWER[t.buf], s, e)
        cut = np.searchsorted(of, np.arange(len(items) + 1))
        self.ids = [i for i, _ in items]
        self.tests = [h[cut[k] : cut[k + 1]] for k in range(len(items))]
        grams = [chain(x, seed) for x in self.tests]
        keys = np.concatenate([np.zeros(0, np.uint64), *grams])
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        few = [k for k, x in enumerate(self.tests) if 0 < len(x) < seed]
        keys = np.array([chain(self.tests[k], len(self.tests[k]))[0] for k in few], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.short_keys, self.short_owner = keys[order], np.array(few, np.int64)[order]

    def meet(self, t: Texts) -> list[list[tuple[int, float]]]:
        """Per text: (item id, coverage) of every test that shares a seed with it."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(t.n)]
        s, e, of = t.spans(ALNUM)
        if len(s) and len(self.short_keys):
            self.meet_lines(t, s, hash_spans(LOWER[t.buf], s, e)[0], out)
        if len(s) < self.seed or not len(self.keys):
            return out
        (h,) = hash_spans(LOWER[t.buf], s, e)
        g = chain(h, self.seed)
        inside = of[self.seed - 1 :] == of[: len(g)]
        lo = np.searchsorted(self.keys, g)
        hit = np.flatnonzero(inside & (self.keys[np.minimum(lo, len(self.keys) - 1)] == g))
        if not len(hit):
            return out
        cut = np.flatnonzero(np.concatenate([[True], of[hit][1:] != of[hit][:-1]]))
        for a, b in zip(cut, [*cut[1:], len(hit)], strict=True):
            at = hit[a:b]
            # only words under a seed can be in a tile; the gaps between them become words of their own
            keep = np.unique((at[:, None] + np.arange(self.seed)[None, :]).reshape(-1))
            gap = np.flatnonzero(np.diff(keep) > 1) + 1
            doc = np.insert(h[keep], gap, np.arange(1, len(gap) + 1).astype(np.uint64))
            los, his = np.searchsorted(self.keys, np.unique(g[at])), np.searchsorted(self.keys, np.unique(g[at]), side="right")
            for k in np.unique(np.concatenate([self.owner[x:y] for x, y in zip(los, his, strict=True)])):
                test = self.tests[k]
                out[of[at[0]]].append((self.ids[k], sum(n for _, _, n in tiles(test, doc, self.seed)) / len(test)))
        return out


    def meet_lines(self, t: Texts, s: np.ndarray, h: np.ndarray, out: list[list[tuple[int, float]]]) -> None:
        """Adds the short tests that are a line of a text."""
        begin, _, text = t.spans(_LINE)
        line = np.searchsorted(begin, s, side="right") - 1
        size = np.bincount(line, minlength=len(begin))
        first = np.cumsum(size) - size
        hits: set[tuple[int, int]] = set()
        for n in range(1, self.seed):
            own = np.flatnonzero(size == n)
            key = chain(h, n)[first[own]]
            lo, hi = (np.searchsorted(self.short_keys, key, side=x) for x in ("left", "right"))
            for k in np.flatnonzero(hi > lo):
                hits |= {(int(text[own[k]]), int(x)) for x in self.short_owner[lo[k] : hi[k]] if len(self.tests[x]) == n}
        for i, k in sorted(hits):
            out[i].append((self.ids[k], 1.0))


def blocks(benchmark: DataFrame, seed: int = SEED, chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """The benchmark in blocks of at most ``chars`` characters (or one test)."""
    items, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        n = len(r[1] or "")
        if items and size + n > chars:
            yield Block(items, seed)
            items, size = [], 0
        items.append((r[0], r[1]))
        size += n
    if items:
        yield Block(items, seed)


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, chars: int = BLOCK_CHARS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, contaminated, coverage, item_ids): one row per input row; ids of the tests covered enough, ascending."""
    spark = ship(docs.sparkSession)
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.lit(0.0).alias("coverage"), F.array().cast("array<long>").alias("item_ids"))
    schema = df.schema
    for block in blocks(benchmark, seed, chars):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, t in slices(b.column(1)):
                    rows = b.slice(part.start, part.stop - part.start)
                    met = shared.value.meet(t)
                    if any(met):
                        best = [max([c, *(x for _, x in m)]) for c, m in zip(rows.column(2).to_pylist(), met, strict=True)]
                        ids = [sorted([*old, *(i for i, x in m if x >= coverage and i is not None)]) for old, m in zip(rows.column(3).to_pylist(), met, strict=True)]
                        rows = pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(best, pa.float64()), pa.array(ids, b.schema.field(3).type)], schema=b.schema)
                    yield rows

        df = df.mapInArrow(run, schema)
    return df.select("doc_id", (F.col("coverage") >= coverage).alias("contaminated"), "coverage", "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED) -> DataFrame:
    """The rows, all columns as they are, that cover less than ``coverage`` of every test."""
    for block in blocks(benchmark, seed):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        docs = keep_rows(docs, lambda t, shared=shared: np.array([all(c < coverage for _, c in m) for m in shared.value.meet(t)], bool))
    return docs
