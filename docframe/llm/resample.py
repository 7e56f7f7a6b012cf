"""Importance resampling towards a target corpus by hashed runs of words.

One scan a document (a streaming CRC ring): for the runs that begin at the last
``n`` words a running zlib state each is kept; every new word extends each by a
space and the word, and starts one of its own. Each state is the CRC-32 of a run
that ends here, so a word emits at most ``n`` buckets and no run is ever joined
or hashed twice. The buckets are written once; totals, weights and the draw are
worked out from them.

A bucket's gain is the logarithm of how much likelier the target corpus is to
use it than the raw corpus, both with one more count a bucket. A document's
weight is the mean gain of its runs. The draw keeps the highest sums of weight
and Gumbel noise, which is a weighted draw without replacement; the noise is a
digest of a seed and the id, so it is the same on every cluster. Ranks come from
one sort by ranges and the row counts of those, so no task holds all rows. To
the driver come bucket totals (bounded by ``buckets``) and a count a range.

Defined results: null and empty texts have no run, weight 0 and no rank; a null
id counts as an empty one in the noise and comes last among ties; repeated rows
count and are drawn each, those with equal scores and ids in an order that their
place in the table gives; very long texts are read whole (four bytes a run are
held); an empty table gives no rows; an empty target gives gains from its
smoothing alone; other columns are not read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docframe.checkpoints import cut
from docframe.llm.textkit import slices
from docframe.ship import ship

#: Longest run of words, number of buckets, least words of a document that may be drawn, percent drawn, seed of the noise.
RUN, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Letters and digits after lower-casing A-Z; all other ASCII parts words, everything beyond ASCII belongs to them.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def emitted(text: bytes, n: int = RUN) -> tuple[array, int]:
    """The CRC-32 of every run of 1 to n consecutive words, and the number of words."""
    out, ring, words = array("I"), [], 0
    for found in WORD.finditer(text.lower()):
        word = found[0]
        if n > 1:
            more = b" " + word
            ring = [crc32(more, state) for state in ring[1 - n :]]
            ring.append(crc32(word))
        else:
            ring = [crc32(word)]
        out.extend(ring)
        words += 1
    return out, words


def runs(docs: DataFrame, n: int = RUN, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, buckets): a bucket for every run of each whole text, repeats included."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in slices(b.column(1)):
                found = [emitted(texts.text(i), n) for i in range(texts.n)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]).astype(np.int32)
                values = np.concatenate([np.frombuffer(x, np.uint32) for x, _ in found]) % buckets
                yield pa.RecordBatch.from_arrays([b.column(0)[part], pa.array([w for _, w in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))], ["doc_id", "n_words", "buckets"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, buckets array<int>")


def _values(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and how many each row has."""
    return column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())


def totals(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Runs in each bucket over all rows; a task hands on one row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for b in batches:
            count += np.bincount(_values(b.column(0))[0], minlength=buckets)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a natural logarithm, floored."""
    s, t, k = float(raw.sum()), float(target.sum()), float(len(raw))
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(raw.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a document's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, size = _values(b.column(2))
            ends = np.concatenate([[0], np.cumsum(gain[values])])
            at = np.concatenate([[0], np.cumsum(size)])
            mean = (ends[at[1:]] - ends[at[:-1]]) // np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size.astype(np.int64)), pa.array(mean)], ["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "buckets").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a digest of seed and id, floored."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with 1, 2, 3... in an order that no two rows share: ranges of rows are sorted apart and begin where those before end."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    sizes = {r._part: r.n for r in placed.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("n")).collect()}
    begins, so_far = [], 0
    for part in sorted(sizes):
        begins.append((part, so_far))
        so_far += sizes[part]
    first = spark.createDataFrame(begins, "_part long, _begin long")  # a row a range
    got = placed.withColumn("_part", F.shiftright("_at", 33)).join(first, "_part")
    return got.withColumn(name, F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_begin")


def resample(docs: DataFrame, target: DataFrame, n: int = RUN, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): every document; rank is null where it isn't drawn."""
    found = cut(runs(docs, n, buckets, doc_id, text))
    gain = gains(totals(found, buckets), totals(runs(target, n, buckets, target_id, target_text), buckets))
    scored = cut(weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("_tie", F.monotonically_increasing_id()))
    may = F.col("n_words") >= least
    drawn = scored.where(may).count() * percent // 100
    top = ranked(scored.where(may), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_tie")).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return top.unionByName(scored.where(~may).withColumn("rank", F.lit(None).cast("long"))).drop("_tie")


_ORACLE = r"""
WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, x : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words}(text) AS w FROM documents),
b AS (SELECT {words}(text) AS w FROM benchmark),
df AS (SELECT rid, unnest({runs}) AS f FROM d),
bf AS (SELECT unnest({runs}) AS f FROM b),
kinds AS (SELECT f, xor(list_reduce(list_transform(range(length(h) // 2), lambda i : ('0x' || substr(h, 2 * i + 1, 2))::BIGINT), lambda c, x : xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)), tab),
s AS (SELECT bucket, count(*) AS n FROM df JOIN kinds USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM bf JOIN kinds USING (f) GROUP BY bucket),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM range(10000) r(i) LEFT JOIN s ON s.bucket = i LEFT JOIN t ON t.bucket = i),
m AS (SELECT rid, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM df JOIN kinds USING (f) JOIN g USING (bucket) GROUP BY rid),
sc AS (SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN m USING (rid)),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, rid) END AS place FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM r WHERE n_words >= 20) THEN place END AS rank FROM r
"""


def oracle() -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    two = "list_concat(w, list_transform(range(len(w) - 1), lambda i : w[i + 1] || ' ' || w[i + 2]))"
    return _ORACLE.replace("{words}(text)", words).replace("{runs}", two)
