"""Continuous reading: every operator works on one document at a time, so it runs unchanged in a stream."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from docframe.operators.kernels import read_documents
from docframe.sources.files import document_stream


def read_continuously(spark: SparkSession, source: str, target: str, checkpoint: str, pattern: str = "*", once: bool = False) -> StreamingQuery:
    """Read results of the files in ``source``, appended to Parquet in ``target``; exactly once per file."""
    out = read_documents(document_stream(spark, source, pattern)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
