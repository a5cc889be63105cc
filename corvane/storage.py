"""Cutting lineage: checkpoints in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str:
    """The checkpoint folder; a temporary one where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='corvane-')}")
    return context.getCheckpointDir()


def folder(spark: SparkSession) -> str:
    """A path of its own in the checkpoint folder, for files that sinks write and readers read."""
    return f"{_shared(spark)}/files-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder and read from there."""
    _shared(df.sparkSession)
    return df.checkpoint()
