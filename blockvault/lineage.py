"""Cutting lineage by checkpoints in the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Used only by a local session that names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint below ``spark.checkpoint.dir``; on a cluster that setting has to be there."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return df.checkpoint()
