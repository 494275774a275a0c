"""Repositories that grow: findings of new bucket files as they land, by Structured Streaming.

The repositories themselves hold no unbounded data; what streams is the arrival of files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verify
from ..sources import repository

#: The schema of Spark's binaryFile reader.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"


def new_buckets(spark: SparkSession, root: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of bucket files below the root, in the shape of ``repository.buckets``."""
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.buk").option("maxFilesPerTrigger", files_per_batch)
    found = reader.load(root).select(repository.relative(F.col("path"), root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    return repository.buckets(found)


def findings_of_new_buckets(spark: SparkSession, root: str) -> DataFrame:
    """A stream of findings of buckets as they land; stateless, so no watermark is needed."""
    return verify.check_chunks(verify.bucket_chunks(new_buckets(spark, root)))
