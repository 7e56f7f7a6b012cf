"""Files as rows: (doc_id, filename, content), in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _shape(df: DataFrame) -> DataFrame:
    return df.select(F.xxhash64("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "length", "content")


def documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """All files below a path; sizes and names are known before contents are read."""
    return _shape(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path))


def document_stream(spark: SparkSession, path: str, pattern: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """New files below a path, as they arrive."""
    return _shape(spark.readStream.format("binaryFile").schema(_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path))
