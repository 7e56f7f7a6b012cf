"""Winnowing fingerprints; DataFrame functions only.

Words (lower case, parted by white space) are hashed, runs of ``GRAM`` words
get rolling (polynomial) hashes, and of every ``WINDOW`` successive ones the
least is chosen, the rightmost of equal ones. A choice keeps its position, so
any run of GRAM + WINDOW - 1 = 8 words shared by two texts is sure to leave a
common hash. Hash and position are packed into one long so that a plain
minimum does the choosing; windows and grams are built by doubling, so the
work per word does not depend on their lengths.

Defined results: null and empty texts have an empty fingerprint; two empty
ones are alike (1); texts of fewer than GRAM words are one gram; texts of at
most WINDOW grams have one window. Very long texts are fingerprinted whole, in
one row. Repeated rows have a result each, equal ids in the order of their texts;
rows with a null id come first, and meet in one task; an empty
table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM, WINDOW = 5, 4
_MOD, _BASE = 2147483647, 1103515245
_POS = 1 << 28


def _pairs(name: str, step: int, f) -> Column:
    """f over items ``step`` apart; fewer by ``step`` than there are."""
    n = F.greatest(F.size(name) - step, F.lit(0))
    return F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(step + 1), n), f)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<long>, each chosen gram as hash * 2^28 + (2^28 - 1 - position), in order of position.

    Every step is a projection of its own: the arrays are used twice and must not be computed twice.
    """
    t = f"__{out}"
    mask = F.lit(0x7FFFFFFF).cast("long")
    keep = df.columns
    roll = lambda power: lambda a, b: (a * F.lit(pow(_BASE, power, _MOD)) + b) % F.lit(_MOD)
    df = df.withColumn(t + "w", F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), ""))
    df = df.withColumn(t + "h", F.transform(t + "w", lambda x: F.xxhash64(x).bitwiseAND(mask)))
    df = df.withColumn(t + "h2", _pairs(t + "h", 1, roll(1)))
    df = df.withColumn(t + "h4", _pairs(t + "h2", 2, roll(2)))
    n = F.greatest(F.size(t + "h") - (GRAM - 1), F.lit(0))
    h5 = F.zip_with(F.slice(t + "h4", F.lit(1), n), F.slice(t + "h", F.lit(GRAM), n), roll(1))
    few = F.when(F.size(t + "w") > 0, F.array(F.xxhash64(F.concat_ws(" ", t + "w")).bitwiseAND(mask))).otherwise(F.array().cast("array<long>"))
    df = df.withColumn(t + "g", F.when(n > 0, h5).otherwise(few))
    df = df.withColumn(t + "p", F.transform(t + "g", lambda x, i: F.xxhash64(x).bitwiseAND(mask) * F.lit(_POS) + (F.lit(_POS - 1) - i)))
    df = df.withColumn(t + "m2", _pairs(t + "p", 1, lambda a, b: F.least(a, b)))
    df = df.withColumn(t + "m4", _pairs(t + "m2", 2, lambda a, b: F.least(a, b)))
    chosen = F.when(F.size(t + "g") > WINDOW, F.array_distinct(t + "m4")).when(F.size(t + "g") > 0, F.array(F.array_min(t + "p"))).otherwise(F.array().cast("array<long>"))
    return df.select(*keep, chosen.alias(out))


def digest(fp: str) -> Column:
    """The fingerprint as 32 hex digits, positions included."""
    part = lambda seed: F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), F.col(fp)))), 16, "0")
    return F.concat(part(1), part(2))


def hashes(fp: str) -> Column:
    return F.array_distinct(F.transform(fp, lambda x: F.shiftright(x, 28)))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash sets; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _below(bounds: list[int], x: Column) -> Column:
    """How many of the ascending bounds are below x: a tree over chunks of them, then a count within one chunk.

    The expression grows with the square root of their number, as does the work per row.
    """
    if not bounds:
        return F.lit(0)
    size = math.isqrt(len(bounds)) + 1
    chunks = [bounds[i : i + size] for i in range(0, len(bounds), size)]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2  # below len(chunks), which stands for all bounds being below x
        return F.when(x <= F.lit(chunks[mid][-1]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    table = F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in c]) for c in chunks], F.array().cast("array<long>"))
    chunk = tree(0, len(chunks))
    return F.least(F.lit(len(bounds)), chunk * size + F.size(F.filter(F.element_at(table, chunk + 1), lambda v: v < x))).cast("int")


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, text, next_text, is_guest, bucket), each row with the text of the next id (after the last: of the first).

    Rows are dealt once, by ranges of ids whose bounds are quantiles, and each
    range gets the first row of the range after it as a guest; guests are
    marked, and must be dropped. Order: nulls first, then id, then text.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    got = base.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 10 * buckets), F.min("doc_id"), F.count("*"), F.count("doc_id")).first()
    bounds = sorted(set(got[0] or []))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_below(bounds, F.col("doc_id")))
    base = base.withColumn("bucket", bucket)
    # the least (id, text) of each range: at most one row a range, so a bounded table
    first = base.groupBy("bucket").agg(F.min("doc_id").alias("doc_id")).orderBy("bucket").collect()
    if not first:
        return base.select("doc_id", F.length("text").alias("n_chars"), "text", F.lit("").alias("next_text"), F.lit(False).alias("is_guest"), "bucket")
    before = {first[i][0]: first[i - 1][0] for i in range(len(first))}  # the last range gets the first row of all
    ids = [r[1] for r in first if r[1] is not None]
    heads = base.where(F.col("doc_id").isin(ids) | F.col("doc_id").isNull()).groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("s"))
    to = F.array(*[F.lit(before.get(b)).cast("int") for b in range(-1, len(bounds) + 1)])
    guests = heads.select(F.col("s.doc_id").alias("doc_id"), F.col("s.text").alias("text"), F.element_at(to, F.col("bucket") + 2).alias("bucket"), F.lit(True).alias("is_guest"))
    rows = base.withColumn("is_guest", F.lit(False)).unionByName(guests).repartition("bucket")
    order = Window.partitionBy("bucket").orderBy(F.col("is_guest"), F.col("doc_id").asc_nulls_first(), "text")
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "text", F.lead("text").over(order).alias("next_text"), "is_guest", "bucket")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next): one row per input row."""
    rows = with_next(docs)
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", F.when(F.col("is_guest"), F.lit("")).otherwise(edited))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fp"), "edited", "edited_fp")
    rows = rows.select("doc_id", "n_chars", "is_guest", "bucket", F.xxhash64("text").alias("tie"), "text", F.sha2("edited", 256).alias("edited_sha256"), digest("fp").alias("fingerprint"), digest("edited_fp").alias("edited_fingerprint"), hashes("fp").alias("own"), hashes("edited_fp").alias("other"))
    order = Window.partitionBy("bucket").orderBy(F.col("is_guest"), F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("after", F.lead("own").over(order)).where(~F.col("is_guest"))
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"))
