"""Mixing to target weights with soft domain membership.

A classifier learned from a labelled table gives every document its posterior
over some domains: ``high``, ``low`` and ``toxic`` of the label table
(``mix``), or any classes of a ``DomainModel`` (``mix_documents``). Nonnegative
rates (how often a document is taken, on average) are then fitted so that the
expected token total of each domain meets its target: projected gradient descent
on a least squares distance between totals and targets, plus a small pull
towards rate 1.

The rates are never stored between steps. A step changes a document's rate by
its posterior times one vector for all, so the rate follows from the document's
posterior and the vectors so far; each step is one pass over a narrow table, in
which a task hands on its sums, and the driver sees only some sums per domain.

The gradient is scaled by the inverse second moment of the posteriors of those
documents whose rate is above 0 (a projected Newton step), so a step moves totals
by what they are off as far as no rate meets 0, in rare and common domains alike;
a step that leaves totals further off than before is followed by shorter ones.
It ends when every total is as close as ``CLOSE`` of its target's share, or when
a step changes nothing any more.

Defined results: null and empty texts have 0 tokens and don't weigh in, but get
a posterior and a rate; very long texts are read whole; repeated rows, and rows
of equal posterior, get equal rates; a null id changes nothing; with no rows or
no tokens all rates are 1; a domain that too few documents belong to can't meet
its target, the others meet theirs as far as they can, and ``Fit.unmet`` and the
column ``unmet`` name it. ``mix_documents`` keeps all columns; an input column of
the name of a result (``rate``, ``unmet``, ``p_...``) gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from docframe.checkpoints import cut
from docframe.llm.domains import DomainModel
from docframe.llm.quality import QualityModel
from docframe.llm.textkit import NOT_BLANK, slices
from docframe.llm.toxicity import ToxicModel
from docframe.ship import ship

DOMAINS = ("high", "low", "toxic")
TARGETS = (0.90, 0.08, 0.02)
ROUNDS, PULL, RIDGE, CLOSE = 40, 1e-4, 2e-3, 1e-3
#: A domain's share may be off by so much before its target counts as unmet.
UNMET = 5e-4


def posteriors(docs: DataFrame, toxic: ToxicModel, quality: QualityModel) -> DataFrame:
    """(doc_id, tokens, p_high, p_low, p_toxic): one row per input row."""
    shared = ship(docs.sparkSession).sparkContext.broadcast((toxic, quality))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tox, qual = shared.value
        for b in batches:
            for part, t in slices(b.column(1)):
                bad, good = tox.score(t, spans=False)[0], qual.score(t)
                tokens = np.bincount(t.spans(NOT_BLANK)[2], minlength=t.n)
                yield pa.RecordBatch.from_arrays([b.column(0)[part], *map(pa.array, (tokens, (1 - bad) * good, (1 - bad) * (1 - good), bad))], ["doc_id", "tokens", "p_high", "p_low", "p_toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, tokens long, p_high double, p_low double, p_toxic double")


def rate_after(steps: list[np.ndarray], names: list[str], pull: float = PULL) -> Column:
    """A document's rate after the given steps, from its posterior columns."""
    r = F.lit(1.0)
    for u in steps:
        move = sum((F.col(n) * F.lit(float(x)) for n, x in zip(names, u, strict=True)), F.lit(0.0))
        r = F.greatest(F.lit(0.0), r * (1 - pull) + pull - move)
    return r


@dataclass
class Fit:
    """The vectors of all steps, and by domain the share of tokens that the rates reach and the one that was to be met."""

    names: list[str]
    steps: list[np.ndarray]
    reached: np.ndarray
    targets: np.ndarray

    @property
    def unmet(self) -> list[str]:
        return [n.removeprefix("p_") for n, x, y in zip(self.names, self.reached, self.targets, strict=True) if abs(x - y) > UNMET]

    def rate(self) -> Column:
        return rate_after(self.steps, self.names)

    def columns(self) -> dict[str, Column]:
        return {"rate": self.rate(), "unmet": F.array(*[F.lit(x) for x in self.unmet]).cast("array<string>")}


def rates(p: np.ndarray, steps: list[np.ndarray], pull: float = PULL) -> np.ndarray:
    """``rate_after`` of rows of posteriors."""
    r = np.ones(len(p))
    for u in steps:
        r = np.maximum(0.0, r * (1 - pull) + pull - p @ u)
    return r


def sums(members: DataFrame, names: list[str], steps: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Tokens of all; expected tokens of each domain under the rates after the steps; second moments of posteriors, by tokens, where the rate is above 0."""
    k = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 + k + k * k)
        for b in batches:
            p = np.stack([b.column(1 + i).to_numpy() for i in range(k)], 1)
            w, r = b.column(0).to_numpy().astype(float), rates(p, steps)
            out += np.concatenate([[w.sum()], (w * r) @ p, (p * (w * (r > 0))[:, None]).T.dot(p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], ["i", "x"])

    ship(members.sparkSession)
    got = np.zeros(1 + k + k * k)
    for r in members.select(F.coalesce("tokens", F.lit(0)).alias("tokens"), *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names]).mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
        got[r.i] = r.x
    return got[0], got[1 : 1 + k], got[1 + k :].reshape(k, k)


def fit(members: DataFrame, targets=TARGETS, names: list[str] | None = None, rounds: int = ROUNDS) -> Fit:
    """``members``: tokens, and one posterior column per domain; ``targets`` are shares of all tokens."""
    names = names or [f"p_{d}" for d in DOMAINS]
    want, steps = np.asarray(targets, float), []
    last, pace = None, 1.0
    while True:
        total, now, second = sums(members, names, steps)
        if not total:
            return Fit(names, [], want, want)
        gap = now / total - want
        if last is not None and np.abs(gap).max() > np.abs(last).max():
            pace = max(pace / 2, 1 / 64)
        if len(steps) == rounds or (np.abs(gap) <= np.minimum(CLOSE * want, UNMET / 2)).all() or last is not None and np.abs(gap - last).max() < CLOSE * want.max() / 1000:
            return Fit(names, steps, gap + want, want)
        norm = np.linalg.inv(second / total + RIDGE * np.eye(len(names)))
        steps.append(pace * norm @ gap)
        last = gap


def fit_rates(members: DataFrame, targets=TARGETS, names: list[str] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``members`` with the columns ``rate`` and ``unmet``."""
    return members.withColumns(fit(members, targets, names, rounds).columns())


def mix(docs: DataFrame, toxic: ToxicModel, quality: QualityModel, targets=TARGETS) -> DataFrame:
    """(doc_id, tokens, p_high, p_low, p_toxic, rate, unmet): domains of the label table."""
    return fit_rates(cut(posteriors(docs, toxic, quality)), targets)


def members_of(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """(tokens, p_<class>...): one row per input row."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    names = [f"p_{k}" for k in model.classes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, t in slices(b.column(0), 1 << 20):
                tokens = np.bincount(t.spans(NOT_BLANK)[2], minlength=t.n)
                yield pa.RecordBatch.from_arrays([pa.array(tokens), *map(pa.array, shared.value.posteriors(t))], ["tokens", *names])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "tokens long" + "".join(f", `{n}` double" for n in names))


def with_posteriors(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """All rows and columns, and p_<class>...; no shuffle."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    names = [f"p_{k}" for k in model.classes]
    docs = docs.drop(*[n for n in names if n != text])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in slices(b.column(at), 1 << 20):
                rows = b.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, shared.value.posteriors(t))], [*rows.schema.names, *names])

    schema = docs.schema
    for n in names:
        schema = StructType([*schema.fields, StructField(n, DoubleType())])
    return docs.mapInArrow(run, schema)


def mix_documents(docs: DataFrame, model: DomainModel, targets) -> DataFrame:
    """All rows and columns, p_<class>..., rate and unmet. Texts are read twice and never exchanged."""
    names = [f"p_{k}" for k in model.classes]
    done = fit(cut(members_of(docs, model)), targets, names)
    return with_posteriors(docs, model).withColumns(done.columns())
