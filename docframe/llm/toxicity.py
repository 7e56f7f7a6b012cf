"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Training tokens get their labels from document labels: in documents marked
toxic, a token is labelled toxic if its word, or its first four or five bytes,
is tied to such documents beyond chance; all other tokens are labelled clean.
The field then learns words, affixes and neighbours of those tokens.

Defined results: null and empty texts score as texts without a toxic token;
very long texts are scored and learned from whole; rows with a null id are
scored and never learned from; repeated rows are scored each (of an id's several
labels the greatest is learned, of its texts the least); an empty table gives no
rows; without labelled rows of both kinds every score is 0. Extra columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.crf import BinaryCRF, best_cut, logistic
from docframe.llm.textkit import ALNUM, LOWER, Texts, hash_spans, slices
from docframe.ship import ship

BITS = 18
#: Bound of the training sample: rows of each class. Their texts are used whole, however long.
SAMPLE_PER_CLASS = 900
SCHEMA = "doc_id long, score double, n_spans int, spans array<struct<start:int,end:int,p:double>>"


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, per_class: int = SAMPLE_PER_CLASS) -> tuple[list[int], list[str], np.ndarray]:
    """At most ``per_class`` labelled texts of each class, least hash of the id first, each whole.

    Of several labels of an id the greatest holds, of several texts the least. The ids come
    from the narrow label table; the texts by a pushed-down IN filter.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & keep)
    named = named.groupBy("doc_id").agg(F.max("y").alias("y"))
    want: dict[int, int] = {}
    for y in (0, 1):
        want |= {r[0]: y for r in named.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()}
    if not want:
        return [], [], np.zeros(0, np.int64)
    got = docs.where(F.col("doc_id").isin(sorted(want)) & (F.length("text") > 0)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    rows = sorted((r[0], r[1]) for r in got)
    return [i for i, _ in rows], [t for _, t in rows], np.array([want[i] for i, _ in rows], np.int64)


@dataclass
class ToxicModel:
    crf: BinaryCRF | None = None
    platt: np.ndarray | None = None

    def tokens(self, texts: Texts):
        starts, ends, doc = texts.spans(ALNUM)
        word, p4, p5 = hash_spans(LOWER[texts.buf], starts, ends, (4, 5))
        return starts, ends, doc, word, p4, p5

    @staticmethod
    def features(doc: np.ndarray, word: np.ndarray, p4: np.ndarray, p5: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, shift = len(word), np.uint64(64 - BITS)
        a = np.empty((n, 6), np.int32)
        a[:, 0] = word >> shift
        a[:, 1] = (p4 >> shift).astype(np.int32) + (1 << BITS)
        a[:, 2] = (p5 >> shift).astype(np.int32) + (2 << BITS)
        a[:, 3] = a[:, 4] = 5 << BITS
        a[1:, 3] = a[:-1, 0] + (3 << BITS)
        a[:-1, 4] = a[1:, 0] + (4 << BITS)
        a[:, 5] = (5 << BITS) + 1
        start = np.ones(n, bool)
        start[1:] = doc[1:] != doc[:-1]
        a[start, 3] = 5 << BITS
        last = np.ones(n, bool)
        last[:-1] = start[1:]
        a[last, 4] = 5 << BITS
        return a, start

    def fit(self, texts: list[str], y: np.ndarray) -> "ToxicModel":
        if not len(y) or y.min() == y.max():
            return self
        n_texts = len(texts)
        parts = [(part.start, self.tokens(t)) for part, t in slices(pa.array(texts, pa.large_string()), 1 << 20)]
        doc, word, p4, p5 = (np.concatenate([x[k] + at if k == 2 else x[k] for at, x in parts]) for k in (2, 3, 4, 5))
        del parts
        nt, nn = int(y.sum()), int((1 - y).sum())
        tied = np.zeros(len(word), bool)
        around = np.zeros(len(word), np.uint64)
        around[1:] += word[:-1]
        around[:-1] += word[1:] * np.uint64(3)
        around = np.unique(around, return_inverse=True)[1]
        n_around = len(word)
        for x in (word, p4, p5):
            codes = np.unique(x, return_inverse=True)[1]
            # copies of one text tell no more than the text itself: distinct neighbourhoods count, not documents
            pairs = np.unique((codes.astype(np.int64) * n_around + around) * 2 + y[doc])
            which, toxic = pairs // (2 * n_around), pairs % 2
            ct = np.bincount(which, toxic, codes.max() + 1) if len(codes) else np.zeros(0)
            cn = np.bincount(which, 1 - toxic, len(ct))
            # evidence in nats against the same rate in both classes, and at least eight times that rate
            rt, rn, r = ct / nt, cn / nn, (ct + cn) / (nt + nn)
            gain = ct * np.log(np.maximum(rt, 1e-12) / r) + cn * np.log(np.maximum(rn, 1e-12) / r)
            tied |= ((gain > 9) & (ct / nt > 8 * (cn + 0.25) / nn))[codes]
        label = (tied & (y[doc] == 1)).astype(np.int64)
        feats, start = self.features(doc, word, p4, p5)
        self.crf = BinaryCRF((5 << BITS) + 2).fit(feats, start, label, np.ones(len(label)), rounds=60, l2=1e-6)
        x = self.evidence(self.crf.marginals(feats, start), doc, n_texts)
        w = logistic(x, y.astype(float))
        w[:2] = np.maximum(w[:2], 0.05)
        w[2] = -best_cut(x @ w[:2], y)
        self.platt = w
        return self

    @staticmethod
    def evidence(odds: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Per text: the log odds of its most toxic token, and the log of its expected number of likely toxic tokens."""
        top = np.full(n, -25.0)
        np.maximum.at(top, doc, np.clip(odds, -25, 25))
        likely = np.where(odds > -2, 1 / (1 + np.exp(-np.clip(odds, -30, 30))), 0)
        return np.column_stack([top, np.log1p(np.bincount(doc, likely, n))])

    def score(self, texts: Texts, spans: bool = True) -> tuple[np.ndarray, list[list[dict]]]:
        if self.crf is None:
            return np.zeros(texts.n), [[] for _ in range(texts.n)]
        starts, ends, doc, word, p4, p5 = self.tokens(texts)
        feats, start = self.features(doc, word, p4, p5)
        odds = self.crf.marginals(feats, start)
        x = self.evidence(odds, doc, texts.n)
        score = 1 / (1 + np.exp(-np.clip(x @ self.platt[:2] + self.platt[2], -30, 30)))
        found: list[list[dict]] = [[] for _ in range(texts.n)]
        if spans and (hot := np.flatnonzero(odds > 0)).size:
            at = texts.char_index()
            for i in hot:
                own = found[doc[i]]
                base = at[texts.offs[doc[i]]]
                a, b, p = int(at[starts[i]] - base), int(at[ends[i]] - base), float(1 / (1 + np.exp(-odds[i])))
                if own and i and odds[i - 1] > 0 and doc[i - 1] == doc[i]:
                    own[-1]["end"], own[-1]["p"] = b, max(own[-1]["p"], p)
                else:
                    own.append({"start": a, "end": b, "p": p})
        return score, found


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> ToxicModel:
    _, texts, y = bounded_sample(docs, labels, "toxic", (F.crc32(F.col("doc_id").cast("string")) % folds) != held)
    return ToxicModel().fit(texts, y)


def score_documents(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_spans, spans): one row per input row; spans in code points, end exclusive."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in slices(b.column(1)):
                score, spans = shared.value.score(t)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(score), pa.array([len(s) for s in spans], pa.int32()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])))], ["doc_id", "score", "n_spans", "spans"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_rows(docs: DataFrame, score, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, for which ``score(Texts)`` gives True; no shuffle."""
    ship(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in slices(b.column(at), 1 << 20):
                rows = b.slice(part.start, part.stop - part.start)
                yield rows.filter(pa.array(score(t)))

    return docs.mapInArrow(run, docs.schema)


def drop_toxic(docs: DataFrame, model: ToxicModel, at_least: float = 0.5) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda t: shared.value.score(t, spans=False)[0] < at_least)
