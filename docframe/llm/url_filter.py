"""URL verdicts: host and path rules first, else a ratio of two character language models.

Accepted and rejected URLs each train an interpolated Markov model of variable
order (contexts of up to five characters; Witten-Bell smoothing shifts weight
to shorter contexts as far as a context is new). A URL's score is the
difference of the log-likelihoods per character, cut where the held-out part of
the training URLs has the fewest errors; but no higher than where ``LOSS`` of the
held-out accepted ones would be lost, and than a share (``EVIDENCE``) of what the
rejected ones usually score, as what the models know little of scores around 0.

Labels come from the rules alone: rejected are the URLs that a block rule fits,
accepted those that an allow rule fits; all others are not learned from, only
scored. All distinct URLs of both kinds are counted, over the cluster, but for the
fifth that is held out (by hash), and all of that decides on the cut, by numbers of
scores in steps of ``STEP``. The driver gets the models' distinct grams, which grow
ever less than the URLs, and at most a number a step. The models see a URL without its scheme,
without the host that a rule names, and without the path that one names
(``look``), of every URL alike; else they would learn the rules again. So what
they carry on is what blocked URLs look like beside their rule.

Defined results: null URLs and those without ``://`` have empty host and path
and fit no rule; null and empty ones are allowed, others scored as they are.
Very long URLs are scored whole. A score of exactly the cut is allowed. A null
id keeps its row; repeated rows are judged each; an empty table gives no rows.
If either kind has no URL, all without a rule are allowed, and so are URLs of
which nothing is left to look at. Extra columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.llm.crf import best_cut
from docframe.llm.textkit import LOWER, Texts, slices
from docframe.ship import ship

ORDER = 5
#: Bytes that stand before and after a text.
TEXT_START, TEXT_END = 32, 10
#: Held-out scores are told apart by so much.
STEP = 2.0**-16
#: Share of held-out accepted URLs that the cut may reject; share of the usual score of held-out rejected ones that a URL must reach to be rejected.
LOSS, EVIDENCE = 0.05, 0.25
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda k: F.coalesce(F.regexp_extract(url, pattern, k), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(part(1), upper, upper.lower()), part(2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def look(url: Column, rules=RULES) -> Column:
    """What the models see of a URL: its host without the longest one that rules name, and what follows without the longest path that they name."""
    host, _ = host_and_path(url)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)\z", 1)
    left, after = host, rest
    for h in sorted({h for _, h, _ in rules}, key=len):
        left = F.when(host == h, "").when(host.endswith("." + h), F.substring(host, F.lit(1), F.length(host) - len(h) - 1)).otherwise(left)
    for p in sorted({p for _, _, p in rules}, key=len):
        after = F.when(rest.startswith(p), F.substring(rest, F.lit(len(p) + 1), F.length(rest))).otherwise(after)
    return F.when(url.contains("://"), F.concat(left, F.when(after != "", F.concat(F.lit("/"), after)).otherwise(""))).otherwise(url)


@dataclass
class MarkovModel:
    """Counts of grams by order; keys pack a gram's bytes, so they are exact."""

    grams: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def keys(t: Texts) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Symbols (each text's bytes and an end), their text, and by order the packed contexts and grams."""
        n = t.n
        size = np.diff(t.offs)
        wide = np.insert(LOWER[t.buf], t.offs[1:], TEXT_END).astype(np.uint64)
        doc = np.repeat(np.arange(n), size + 1)
        begin = (t.offs[:-1] + np.arange(n))[doc]
        at = np.arange(len(wide))
        ctx = [np.zeros(len(wide), np.uint64)]
        for k in range(1, ORDER + 1):
            prev = np.where(at - k >= begin, wide[np.maximum(at - k, 0)], np.uint64(TEXT_START))
            ctx.append(ctx[-1] | prev << np.uint64(8 * (k - 1)))
        return wide, doc, ctx, [c << np.uint64(8) | wide for c in ctx]

    def fit(self, urls: list[str]) -> "MarkovModel":
        grams = self.keys(Texts.of(urls))[3]
        for g in grams:
            self.add_order(*np.unique(g, return_counts=True))
        return self

    def add_order(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """The grams of the next order, keys ascending; contexts are summed from them."""
        own, first, kinds = np.unique(keys >> np.uint64(8), return_index=True, return_counts=True)
        self.grams.append((keys, counts.astype(float)))
        self.contexts.append((own, np.add.reduceat(counts.astype(float), first) if len(own) else np.zeros(0), kinds.astype(float)))

    def log_likelihood(self, t: Texts) -> np.ndarray:
        """Natural log-likelihood of each text, its end included."""
        wide, doc, ctx, grams = self.keys(t)
        p = np.full(len(wide), 1 / 256)
        for k, (c, g) in enumerate(zip(ctx, grams, strict=True)):
            gk, gn = self.grams[k]
            ck, cn, kinds = self.contexts[k]
            if not len(gk):
                continue
            i = np.minimum(np.searchsorted(ck, c), len(ck) - 1)
            j = np.minimum(np.searchsorted(gk, g), len(gk) - 1)
            known = ck[i] == c
            seen = np.where(gk[j] == g, gn[j], 0)
            p = np.where(known, (seen + kinds[i] * p) / (cn[i] + kinds[i]), p)
        return np.bincount(doc, np.log(p), t.n)


@dataclass
class UrlModel:
    accepted: MarkovModel | None = None
    rejected: MarkovModel | None = None
    cut: float = 0.0

    def fit(self, accepted: list[str], rejected: list[str]) -> "UrlModel":
        if not accepted or not rejected:
            return self
        hold = lambda x, yes: [u for i, u in enumerate(x) if (i % 5 == 4) == yes]
        self.accepted, self.rejected = MarkovModel().fit(hold(accepted, False)), MarkovModel().fit(hold(rejected, False))
        held = [*hold(accepted, True), *hold(rejected, True)]
        if held:
            y = np.array([1] * len(hold(accepted, True)) + [0] * len(hold(rejected, True)))
            x = self.score(Texts.of(held))
            self.cut = min(0.0, best_cut(x, y))
            if not y.all():
                self.cut = min(self.cut, float(np.median(x[y == 0])) * EVIDENCE)
            if y.any():
                kept = np.sort(x[y == 1])
                self.cut = min(self.cut, float(kept[int(LOSS * len(kept))]))
        return self

    def score(self, t: Texts) -> np.ndarray:
        size = np.diff(t.offs)
        if self.accepted is None or not t.n:
            return np.zeros(t.n)
        x = (self.accepted.log_likelihood(t) - self.rejected.log_likelihood(t)) / (size + 1)
        return np.where(size > 0, x, max(0.0, self.cut))


def cut_of(x: np.ndarray, accepted: np.ndarray, rejected: np.ndarray) -> float:
    """The cut by held-out scores (ascending, each once) and how many URLs of either kind have them; as ``UrlModel.fit``."""
    if not len(x):
        return 0.0
    wrong = np.concatenate([[0], np.cumsum(accepted)]) + np.concatenate([np.cumsum(rejected[::-1])[::-1], [0]])
    at = np.flatnonzero(wrong == wrong.min())
    edge = np.concatenate([[x[0] - 1], x, [x[-1] + 1]])
    i = at[int(np.argmax(edge[at + 1] - edge[at]))]
    cut = min(0.0, float((edge[i] + edge[i + 1]) / 2))
    ranked = lambda counts, k: float(x[np.searchsorted(np.cumsum(counts), k, side="right")])
    if n := int(rejected.sum()):
        cut = min(cut, (ranked(rejected, (n - 1) // 2) + ranked(rejected, n // 2)) / 2 * EVIDENCE)
    if n := int(accepted.sum()):
        cut = min(cut, ranked(accepted, int(LOSS * n)))
    return cut


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(accepted, order, gram, n) of (url, accepted)."""
    for b in batches:
        kind = b.column(1).to_numpy(zero_copy_only=False)
        for part, t in slices(b.column(0), 1 << 20):
            _, doc, _, grams = MarkovModel.keys(t)
            for yes in (False, True):
                for k, g in enumerate(grams):
                    key, n = np.unique(g[kind[part][doc] == yes], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), yes)), pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["accepted", "k", "gram", "n"])


def train(pages: DataFrame, rules=RULES) -> UrlModel:
    said = rule_of(*host_and_path(F.col("url")), rules)[1]
    urls = pages.where(F.length("url") > 0).select(look(F.col("url"), rules).alias("url"), (said == "allow").alias("accepted")).where((F.length("url") > 0) & F.col("accepted").isNotNull())
    urls = cut(urls.distinct().withColumn("held", F.pmod(F.xxhash64("url", F.lit(4)), F.lit(5)) == 4))
    ship(pages.sparkSession)
    got = urls.where("not held").select("url", "accepted").mapInArrow(_grams, "accepted boolean, k int, gram long, n long").groupBy("accepted", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    accepted, k, gram, n = (got.column(c).to_numpy() for c in ("accepted", "k", "gram", "n"))
    model, made = UrlModel(), []
    for yes in (True, False):
        made.append(MarkovModel())
        for order in range(ORDER + 1):
            own = np.flatnonzero((accepted == yes) & (k == order))
            own = own[np.argsort(gram[own].view(np.uint64))]
            made[-1].add_order(gram[own].view(np.uint64), n[own])
    if not all(len(m.grams[0][0]) for m in made):
        return model
    model.accepted, model.rejected = made
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in slices(b.column(0), 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(1)[part], pa.array(np.floor(shared.value.score(t) / STEP).astype(np.int64))], ["accepted", "step"])

    held = urls.where("held").select("url", "accepted").mapInArrow(scores, "accepted boolean, step long").groupBy("step").agg(F.count_if("accepted").alias("yes"), F.count_if(~F.col("accepted")).alias("no")).toArrow().sort_by("step")
    model.cut = cut_of(*(held.column(c).to_numpy() * f for c, f in (("step", STEP), ("yes", 1), ("no", 1))))
    return model


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row per input row; only page_id and url are read."""
    shared = ship(pages.sparkSession).sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, t in slices(b.column(2), 1 << 20):
                yield pa.RecordBatch.from_arrays([*(b.column(k)[part] for k in range(2)), pa.array(shared.value.score(t))], ["page_id", "url", "score"])

    url = F.col("url").cast("string")
    scored = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), look(url, rules).alias("look")).mapInArrow(run, "page_id long, url string, score double")
    host, path = host_and_path(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= model.cut, "allow").otherwise("block")
    return scored.select("page_id", host.alias("host"), path.alias("path"), "score").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "score")
