"""Bounds of the batches in which rows go to Python and back."""

from __future__ import annotations

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of an Arrow batch.  Spark's own bound is 64 MiB, of which a task holds several copies at a time.
BATCH_BYTES = 1 << 22


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small, as rows hold chunks or whole buckets; a smaller bound that is set stays."""
    held = spark.conf.get(_KEY, None)
    if not (held and held.isdigit() and 0 < int(held) <= most):
        spark.conf.set(_KEY, str(most))
