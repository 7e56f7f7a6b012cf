"""Soft membership in labelled domains: a multinomial classifier on hashed words.

Learned from a bounded sample of a labelled table (``SAMPLE_PER_CLASS`` texts of
each class, least hash of the id first, each whole). A text's evidence is the
mean weight of its words, so long and short texts are judged alike.

Defined results: null, empty and word-less texts get the sample's even prior;
classes without a labelled text are as likely as the prior says; rows with other
or null labels, null ids or empty texts are not learned from; of repeated ids
the least text is learned; ties in the sample's order go by id; very long texts
are read whole; without labelled rows of two classes all classes are as likely;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docframe.llm.textkit import LOWER, NOT_BLANK, Texts, hash_spans, slices

BITS = 15
SAMPLE_PER_CLASS = 400


@dataclass
class DomainModel:
    classes: tuple[str, ...]
    w: np.ndarray | None = None  # (classes, words), and the constants last

    @staticmethod
    def words(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word number, text number, share of the text's words), repeats in one."""
        s, e, doc = t.spans(NOT_BLANK)
        (h,) = hash_spans(LOWER[t.buf], s, e)
        both, n = np.unique(doc.astype(np.int64) << BITS | (h >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        doc = both >> BITS
        return both & ((1 << BITS) - 1), doc, n / np.maximum(1, np.bincount(doc, n, t.n))[doc]

    def fit(self, texts: list[str], y: np.ndarray, rounds: int = 60, rate: float = 0.5, l2: float = 1e-5) -> "DomainModel":
        if len(np.unique(y)) < 2:
            return self
        parts = [(at.start, self.words(t)) for at, t in slices(pa.array(texts, pa.large_string()))]
        word, share = (np.concatenate([x[k] for _, x in parts]) for k in (0, 2))
        doc = np.concatenate([x[1] + at for at, x in parts])
        k, n, size = len(self.classes), len(texts), 1 << BITS
        goal = (np.arange(k)[:, None] == y[None, :]).astype(float)
        w = np.zeros((k, size + 1))
        m1, m2 = np.zeros_like(w), np.zeros_like(w)
        for r in range(1, rounds + 1):
            d = goal - self.softmax(np.stack([np.bincount(doc, w[c, word] * share, n) + w[c, -1] for c in range(k)]))
            g = np.column_stack([np.stack([np.bincount(word, share * d[c, doc], size) for c in range(k)]), d.sum(1)]) / n - l2 * w
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            w = w + rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-9)
        self.w = w
        return self

    @staticmethod
    def softmax(x: np.ndarray) -> np.ndarray:
        x = np.exp(x - x.max(0))
        return x / x.sum(0)

    def posteriors(self, t: Texts) -> np.ndarray:
        """(classes, texts)"""
        k = len(self.classes)
        if self.w is None:
            return np.full((k, t.n), 1 / k)
        word, doc, share = self.words(t)
        p = self.softmax(np.stack([np.bincount(doc, self.w[c, word] * share, t.n) + self.w[c, -1] for c in range(k)]))
        p[:, np.bincount(doc, minlength=t.n) == 0] = 1 / k
        return p


def train(labelled: DataFrame, label: str, classes: tuple[str, ...], per_class: int = SAMPLE_PER_CLASS) -> DomainModel:
    """``labelled``: (doc_id, text, label)."""
    rows = labelled.where(F.col("doc_id").isNotNull() & (F.length("text") > 0) & F.col(label).isin(*classes)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(label).cast("string").alias("label"))
    # ids first, from two narrow columns; then the texts of those
    ids = rows.select("doc_id", "label").distinct()
    want = {k: [r[0] for r in ids.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()] for k in classes}
    every = sorted({i for x in want.values() for i in x})
    if not every:
        return DomainModel(classes)
    got = rows.where(F.col("doc_id").isin(every)).groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    keep = sorted((r.doc_id, r.label, r.text) for r in got if r.doc_id in set(want[r.label]))
    return DomainModel(classes).fit([t for *_, t in keep], np.array([classes.index(k) for _, k, _ in keep], np.int64))
