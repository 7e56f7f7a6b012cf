"""Registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import backoff_lm, codes, collisions, decontam, license_scan, mixing, quality, resample, simhash, token_count, toxicity, url_filter, winnow

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def _held(n: int, r: int):
    return F.coalesce(_remainder(n) == r, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), 5, 0)
    got = toxicity.score_documents(docs, model)
    return got.select("doc_id", _held(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_spans")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.train(pages))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), 4, 2)
    got = quality.score_documents(docs, model)
    return got.select("doc_id", _held(4, 2).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return mixing.mix(docs, toxicity.train(docs, labels), quality.train(docs, labels))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op9_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = backoff_lm.train(docs, F.coalesce(_remainder(5) != 1, F.lit(False)))
    return backoff_lm.score_documents(docs, model, _held(5, 1))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_copies(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which imports this package

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_token_counts, op3_license_scan, op4_url_filter, op5_quality, op6_mixing, op7_simhash, op8_winnowing, op9_backoff_lm, op10_decontamination, op11_vector_codes, op12_resampling, op13_embedding_dedup, pipeline)}
ORACLES = {"op3_license_scan": license_scan.oracle(), "op11_vector_codes": codes.oracle(), "op12_resampling": resample.oracle(), "op13_embedding_dedup": collisions.ORACLE}
