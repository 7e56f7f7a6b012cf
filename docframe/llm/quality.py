"""Line quality by a linear-chain conditional random field, and document quality from its marginals.

Each line is described by its own shape and that of its neighbours. The field
labels lines good or bad; a document's evidence is the mean log odds and the
mean probability of its lines, weighted by length.

Defined results: null and empty texts get the score of an empty line sequence
(evidence 0, calibrated like the others); very long texts are scored and learned
from whole; a null id is scored and never learned from; repeated rows are scored
each; a score of exactly the cut passes; an empty table gives no rows; without
labelled rows of both classes every score is 1. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.crf import BinaryCRF, best_cut, logistic
from docframe.llm.textkit import LOWER, NOT_BLANK, Texts, hash_spans, slices
from docframe.llm.toxicity import bounded_sample, keep_rows
from docframe.ship import ship

BINS = 10
CUT = 0.7
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for a, b in ranges:
        out[a:b] = 1
    return out


_UPPER = _class((65, 91))
_LOWER = _class((97, 123))
_DIGIT = _class((48, 58))
_HIGH = _class((128, 256))
_MARK = _class((33, 34), (35, 39), (42, 44), (47, 48), (60, 63), (64, 65), (91, 97), (123, 127))
_BAR = _class((124, 125))
_STOP = _class((44, 45), (46, 47), (58, 60))
_COUNTED = (_UPPER, _LOWER, _DIGIT, _HIGH, _MARK, _BAR, _STOP)
#: A tab that ends nothing: what stands before the first and after the last line.
NAMES = ("bytes", "upper", "digit", "high", "mark", "bar", "stop", "words", "word_len", "repeat_next", "distinct", "line_again", "ends_stop")


def line_shapes(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, features), text number and bytes of each non-empty line."""
    starts, ends, doc = t.spans(_LINE)
    n = len(starts)
    size = (ends - starts).astype(float)
    x = np.zeros((n, len(NAMES)))
    if not n:
        return x, doc, size
    edge = np.stack([starts, ends], 1).reshape(-1)
    if edge[-1] == len(t.buf):
        edge = edge[:-1]
    total = lambda c: np.add.reduceat(c, edge, dtype=np.int64)[::2]
    counts = [total(c[t.buf]) for c in _COUNTED]
    letters = np.maximum(1, counts[0] + counts[1])
    x[:, 0] = np.log1p(size)
    x[:, 1] = counts[0] / letters
    for j, c in enumerate(counts[2:], 2):
        x[:, j] = c / size
    ws, we, _ = t.spans(NOT_BLANK & _LINE)
    line = np.searchsorted(starts, ws, side="right") - 1
    h = hash_spans(LOWER[t.buf], ws, we)[0]
    words = np.bincount(line, minlength=n)
    x[:, 7] = np.log1p(words)
    x[:, 8] = np.bincount(line, we - ws, n) / np.maximum(1, words)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    x[:, 9] = np.bincount(line, same, n) / np.maximum(1, words)
    mixed = h ^ (line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(mixed, return_index=True)[1]
    x[:, 10] = np.bincount(line[first], minlength=n) / np.maximum(1, words)
    lh = np.zeros(n, np.uint64)
    np.add.at(lh, line, h * (np.uint64(2) * np.arange(len(h), dtype=np.uint64) - np.uint64(2) * np.searchsorted(line, line).astype(np.uint64) + np.uint64(1)))
    lh ^= doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    _, inv, cnt = np.unique(lh, return_inverse=True, return_counts=True)
    x[:, 11] = np.log1p(cnt[inv] - 1)
    x[:, 12] = (_STOP | _class((33, 34), (63, 64)))[t.buf[ends - 1]]
    return x, doc, size


@dataclass
class QualityModel:
    edges: list[np.ndarray] = field(default_factory=list)
    crf: BinaryCRF | None = None
    platt: np.ndarray | None = None

    def features(self, x: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = x.shape
        own = np.empty((n, k), np.int32)
        for j in range(k):
            own[:, j] = np.searchsorted(self.edges[j], x[:, j]) + j * BINS
        start = np.ones(n, bool)
        start[1:] = doc[1:] != doc[:-1]
        none = 3 * k * BINS
        out = np.full((n, 3 * k + 1), none, np.int32)
        out[:, :k] = own
        out[1:, k : 2 * k] = own[:-1] + k * BINS
        out[:-1, 2 * k : 3 * k] = own[1:] + 2 * k * BINS
        out[start, k : 2 * k] = none
        last = np.ones(n, bool)
        last[:-1] = start[1:]
        out[last, 2 * k : 3 * k] = none
        out[:, -1] = none + 1
        return out, start

    @staticmethod
    def evidence(odds: np.ndarray, doc: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        total = np.maximum(1e-9, np.bincount(doc, size, n))
        odds = np.clip(odds, -12, 12)
        return np.column_stack([np.bincount(doc, size * odds, n) / total, np.bincount(doc, size / (1 + np.exp(-odds)), n) / total])

    def fit(self, texts: list[str], y: np.ndarray) -> "QualityModel":
        if not len(y) or y.min() == y.max():
            return self
        t = Texts.of(texts)
        x, doc, size = line_shapes(t)
        # evenly spaced by rank over both classes, so that rare shapes of either have bins of their own
        balance = np.where(y[doc] == 1, 0.5 / max(1, (y[doc] == 1).sum()), 0.5 / max(1, (y[doc] == 0).sum()))
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            c = np.cumsum(balance[order])
            self.edges.append(np.unique(x[order, j][np.minimum(len(c) - 1, np.searchsorted(c, np.arange(1, BINS) / BINS))]))
        feats, start = self.features(x, doc)
        per_doc = np.bincount(doc, minlength=t.n)
        weight = (1.0 / per_doc[doc]) * 5 * np.where(y[doc] == 1, 1.0, max(1.0, (y == 1).sum() / max(1, (y == 0).sum())))
        self.crf = BinaryCRF(3 * x.shape[1] * BINS + 2).fit(feats, start, y[doc], weight, rounds=150, rate=0.1, l2=1e-3)
        z = self.evidence(self.crf.marginals(feats, start), doc, size, t.n)
        w = logistic(z, y.astype(float))
        s = z @ w[:-1]
        w[-1] = np.log(CUT / (1 - CUT)) - best_cut(s, y)
        self.platt = w
        return self

    def score(self, t: Texts) -> np.ndarray:
        if self.crf is None:
            return np.ones(t.n)
        x, doc, size = line_shapes(t)
        feats, start = self.features(x, doc)
        z = self.evidence(self.crf.marginals(feats, start), doc, size, t.n)
        return 1 / (1 + np.exp(-np.clip(z @ self.platt[:-1] + self.platt[-1], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> QualityModel:
    _, texts, y = bounded_sample(docs, labels, "quality", (F.crc32(F.col("doc_id").cast("string")) % folds) != held)
    return QualityModel().fit(texts, y)


def score_documents(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score): one row per input row."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in slices(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array(shared.value.score(t))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_low(docs: DataFrame, model: QualityModel, at_least: float = CUT) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda t: shared.value.score(t) >= at_least)
