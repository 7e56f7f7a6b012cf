"""Language-model scores by a weighted backoff automaton.

States are contexts of zero, one or two words; an arc carries a word's count
over its context's count plus a constant (``MASS``), and leads to the state of
the longest known context it leaves; a failure arc leads to the context without
its first word and carries the weight left over there. So a state gives each
word its arc, if there is one, and its failure arc's share of the next shorter
state's probability, and all probabilities of a state sum to 1. A text is
scored in one left-to-right run (``walk``). As a state is a function of the
last two words, all positions of a batch take their arcs and failure arcs in
lock step (``run``), which gives the same sums.

Tokens are the words seen in training, the end, and one class of all other
words, as for the base score. At the root counts are discounted; what is left
over goes in part to the class of other words, in part evenly to all classes.

Nothing is cut: all words, pairs and triples of all training texts count, also
those that occur once, at any corpus size. Counts are never sent whole.
Documents are dealt into shards of bounded size. A shard asks for the distinct
words, pairs and triples it holds, and says how often its training texts hold
them; all shards' blocks of one range of hashes meet in a task, which adds up
and answers each shard in the order of its keys. So one exchange both counts
and looks up, a word that every text holds is one key a shard, and the shard
then runs on an automaton of just its own arcs. Words are keyed by 63 bits.
Pairs and triples are keyed by as many bits as the whole input's size has, and
``SPARE`` more: at any size the chance that one takes another's count is below
2^-SPARE.

Defined results: null and empty texts are one end token; rows with a null id
are scored (learned from if ``learn`` says so); repeated rows count and are
scored each; a very long text is read whole, in one shard; no rows give no rows;
other columns are not read, whatever their names; with
no training text N and V are 0 and every token has probability 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.llm.blocks import pack, pack_counts, places, unique, unpack, unpack_counts
from docframe.llm.textkit import LOWER, NOT_BLANK, Texts, hash_spans, slices
from docframe.ship import ship

DISCOUNT = 0.75
#: Weight of the next shorter context beside the counts of a one-word and a two-word context.
MASS = (300.0, 8.0)
#: Share of the root's leftover weight that goes to the class of unseen words.
UNSEEN = 0.5
SHARD_BYTES, LARGEST_SHARD = 8 << 20, 32 << 20
SPARE = 16
#: Hashes that stand for the start and the end of a text.
START, END = -6148914691236517205, 3689348814741910323
_MULT = np.uint64(0x9E3779B97F4A7C15)
_TYPE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def words_of(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, doc = t.spans(NOT_BLANK)
    (h,) = hash_spans(LOWER[t.buf], starts, ends)
    return starts, ends, doc, h.view(np.int64)


def stream(sym: np.ndarray, doc: np.ndarray, n: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with an end put after each text; where texts begin; the text of each."""
    size = np.bincount(doc, minlength=n)
    out = np.insert(sym, np.cumsum(size), end)
    owner = np.repeat(np.arange(n), size + 1)
    first = np.ones(len(out), bool)
    first[1:] = owner[1:] != owner[:-1]
    return out, first, owner


def grams(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position of a stream of word hashes with ends: the hash of the pair, of the triple (where no text begins)."""
    mix = lambda x, y: ((x ^ x >> np.uint64(29)) * _MULT + y) * _MULT ^ y >> np.uint64(31)
    done = lambda x: (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    prev = np.where(first, START, np.concatenate([[START], h[:-1]])) if len(h) else h
    pair = mix(prev.view(np.uint64) + np.uint64(2), h.view(np.uint64))
    triple = np.zeros_like(pair)
    triple[1:] = mix(pair[:-1] + np.uint64(3), h[1:].view(np.uint64))
    return done(pair), done(triple)


@dataclass
class Root:
    """The state without context: N training tokens of V kinds, of which ``ends`` are ends."""

    n: float = 0
    v: float = 0
    ends: float = 0

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of tokens with count c; 0 stands for the class of unseen words."""
        if not self.n:
            return np.ones(len(c))
        left = DISCOUNT * self.v / self.n
        return np.maximum(c - DISCOUNT, 0) / self.n + left * (np.where(c > 0, 0.0, UNSEEN) + (1 - UNSEEN) / (self.v + 1))

    def run(self, one: np.ndarray, two: np.ndarray, three: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 probability at each position of a stream, from the counts of the word, the pair and the triple that end there."""
        before = np.where(first, self.ends, np.concatenate([[0], one[:-1]]))
        pair = np.where(first, 0, np.concatenate([[0], two[:-1]]))
        p = self.p(one)
        p = (two + MASS[0] * p) / (before + MASS[0])
        p = (np.where(first, 0, three) + MASS[1] * p) / (pair + MASS[1])
        return np.log10(np.maximum(p, 1e-300))


class Automaton:
    """States, arcs and failure arcs over the given counts of words, pairs and triples; '<' starts a text."""

    def __init__(self, root: Root, words: dict, pairs: dict, triples: dict):
        self.root, self.arcs, self.fail = root, {}, {}
        size = {("<",): root.ends} | {(w,): c for w, c in words.items()} | dict(pairs)
        for context, w, n in [*(((a,), b, n) for (a, b), n in pairs.items()), *(((a, b), w, n) for (a, b, w), n in triples.items())]:
            mass = MASS[len(context) - 1]
            self.arcs[context, w] = n / (size[context] + mass)
            self.fail[context] = (context[1:], mass / (size[context] + mass))
        self.words = words

    def walk(self, text: list) -> float:
        """log10 probability of a text and its end, in one left-to-right run."""
        state, total = ("<",), 0.0
        for w in text:
            at, weight, p = state, 1.0, 0.0
            while at:
                p += weight * self.arcs.get((at, w), 0.0)
                at, share = self.fail.get(at, (at[1:], 1.0))
                weight *= share
            total += float(np.log10(p + weight * self.root.p(np.array([self.words.get(w, 0)]))[0]))
            state = (*state[-1:], w)
            while state and state not in self.fail:  # the longest known context
                state = state[1:]
        return total


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, c) of (text); merged as long as they are few."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def told() -> pa.RecordBatch:
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(at, np.concatenate([c for _, c in held]), len(key)).astype(np.int64))], ["h", "c"])

    for b in batches:
        for _, t in slices(b.column(0), 6 << 20):
            held.append(np.unique(words_of(t)[3], return_counts=True))
            if sum(len(k) for k, _ in held) > 2_000_000:
                yield told()
                held.clear()
    if held:
        yield told()


@dataclass
class BackoffModel:
    """What was learned from ``docs`` where ``learn`` holds: N, V and the number of texts; arcs are counted as they are asked for."""

    docs: DataFrame
    learn: Column
    root: Root


def train(docs: DataFrame, learn: Column) -> BackoffModel:
    ship(docs.sparkSession)
    texts = docs.where(learn).select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = texts.mapInArrow(_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = texts.count()
    return BackoffModel(docs, learn, Root(total + ends, distinct + (ends > 0), ends))


def _keys(t: Texts, narrow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a stream of texts: words, then pairs and the triples where no text begins (less ``narrow`` bits), where texts begin, the text of each."""
    _, _, doc, h = words_of(t)
    h, first, owner = stream(h, doc, t.n, END)
    pair, triple = grams(h, first)
    return h.view(np.uint64) >> np.uint64(1), np.concatenate([pair, triple[~first]]) >> np.uint64(narrow), first, owner


def score_documents(docs: DataFrame, model: BackoffModel, held_out: Column, shard_bytes: int | None = None) -> DataFrame:
    """One row per input row: ``_TYPE``."""
    spark = ship(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, held_out.alias("held_out"), (model.learn if docs is model.docs else F.lit(False)).alias("learn"), F.lit(True).alias("ask"))
    if docs is not model.docs:
        rows = rows.union(model.docs.where(model.learn).select(F.col("doc_id").cast("long"), text, F.lit(False), F.lit(True), F.lit(False)))
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    # shards grow slowly with the input, so that blocks (shards x ranges of hashes) stay of use
    shard_bytes = shard_bytes or min(LARGEST_SHARD, max(SHARD_BYTES, int(SHARD_BYTES * (size / (64 << 30)) ** 0.5)))
    shards = max(1, -(-size // shard_bytes))
    tasks = int(min(shards, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    deal = (shards - 1).bit_length()  # ranges of hashes: a power of two
    width = min(63, max(deal, (int(size) + int(count)).bit_length() + SPARE))
    root, narrow = model.root, 64 - width
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))).repartition(tasks, "shard")

    def whole(texts: pa.ChunkedArray) -> Texts:
        return next((t for _, t in slices(texts, 1 << 62)), Texts.of([]))

    def ask(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], [], []]
        shard = table.column("shard")[0].as_py()
        word, more, first, owner = _keys(whole(table.column("text")), narrow)
        learn = np.asarray(table.column("learn").to_numpy(zero_copy_only=False), bool)[owner]
        both = [(*unique(word, learn), 63), (*unique(more, np.concatenate([learn, learn[~first]])), width)]
        both = [(k, c, w, np.searchsorted(k >> np.uint64(w - deal), np.arange((1 << deal) + 1))) for k, c, w in both]
        for r in range(1 << deal):
            row = [r, shard]
            for k, c, w, cut in both:
                mine = slice(cut[r], cut[r + 1])
                own = k[mine] & np.uint64((1 << (w - deal)) - 1)
                row += [pack(own, w - deal), pack_counts(c[mine])]
            for x, y in zip(out, row, strict=True):
                x.append(y)
        return pa.table({"part": pa.array(out[0], pa.int64()), "shard": pa.array(out[1], pa.int64()), **{n: pa.array(x, pa.binary()) for n, x in zip(("words", "word_counts", "grams", "gram_counts"), out[2:], strict=True)}})

    def answer(table: pa.Table) -> pa.Table:
        out = {"shard": table.column("shard"), "part": table.column("part")}
        for what in ("word", "gram"):
            keys = [unpack(x.as_py()) for x in table.column(f"{what}s")]
            counts = np.concatenate([unpack_counts(x.as_py()) for x in table.column(f"{what}_counts")])
            at = places(np.concatenate(keys))
            total = np.bincount(at, counts).astype(np.int64)[at] if len(at) else at
            cut = np.cumsum([len(k) for k in keys])[:-1]
            out[f"{what}_counts"] = pa.array([pack_counts(x) for x in np.split(total, cut)], pa.binary())
        return pa.table(out)

    asked = rows.groupBy("shard").applyInArrow(ask, "part long, shard long, words binary, word_counts binary, grams binary, gram_counts binary")
    answers = asked.groupBy("part").applyInArrow(answer, "shard long, part long, word_counts binary, gram_counts binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        t = whole(left.column("text"))
        word, more, first, owner = _keys(t, narrow)
        one, more = (np.concatenate([np.zeros(0, np.int64), *(unpack_counts(x.as_py()) for x in right.column(n))]).astype(float)[places(k)] for n, k in (("word_counts", word), ("gram_counts", more)))
        two, three = more[: len(first)], np.zeros(len(first))
        three[~first] = more[len(first) :]
        below = np.log10(root.n + 0.5 * (root.v + 1))
        got = {"n_tokens": np.bincount(owner, minlength=t.n), "n_known": np.bincount(owner, one > 0, t.n).astype(np.int64), "train_tokens": np.full(t.n, int(root.n)), "base_score": np.bincount(owner, np.log10(one + 0.5) - below, t.n), "score": np.bincount(owner, root.run(one, two, three, first), t.n)}
        return pa.table({"doc_id": left.column("doc_id"), "held_out": left.column("held_out"), **{k: pa.array(x) for k, x in got.items()}}).filter(left.column("ask"))

    return rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(score, _TYPE)
