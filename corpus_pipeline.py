"""A training corpus from raw documents: five stages, each written and read again.

All stages keep whole rows and all columns; the last adds the posteriors of the
domains, ``rate`` and ``unmet``. Defined results: null and empty texts are judged
like texts without a word and, if they stay, are equal to each other (one stays);
rows with a null id are judged like any other and never dropped as copies;
repeated rows count as copies; very long texts are read whole; empty tables give
no rows; of equals the least id stays. Columns named like a stage's own are
replaced by the last stage (``rate``, ``unmet``, ``p_...``) and kept by all others.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from docframe.checkpoints import shared_folder
from docframe.llm import decontam, domains, mixing, quality, simhash, toxicity

#: Rows of an Arrow batch in all stages: texts are wide, and a batch is held several times over, by the JVM and by the worker.
BATCH_ROWS = 1024
#: The domains to mix are languages, which the stages before leave in place; shares of all tokens.
TARGETS = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, with batches of ``BATCH_ROWS`` rows from then on in its session."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@_staged
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


@_staged
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model rejects go."""
    return quality.drop_low(docs, quality.train(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")))


@_staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least id."""
    return simhash.keep_one(docs)


@_staged
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test of the benchmark go."""
    return decontam.drop_contaminated(docs, _read(spark, sf_dir, "benchmark"))


@_staged
def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its posteriors over the languages and the rate at which it is to be taken."""
    model = domains.train(_read(spark, sf_dir, "documents"), "lang", tuple(TARGETS))
    return mixing.mix_documents(docs, model, list(TARGETS.values()))


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_low_quality), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_benchmark_leaks), ("mixing to target weights", mix_to_targets)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder as Parquet, and read by the next."""
    where = f"{shared_folder(spark)}/pipeline_{spark.sparkContext.applicationId}_{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    docs = _read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = f"{where}/{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
