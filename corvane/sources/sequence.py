"""Logs whose appends have an order: each append is an epoch, claimed by creating a file that mustn't exist.

A log is a folder: ``epoch=<n>/lane=<lane>/part-*.json`` with a line number in each row, and ``_epochs/<n>.claim`` and
``<n>.done``.  A writer claims the number after the largest one claimed; who loses the race takes the next.  Readers see an
epoch once its ``.done`` is there, so rows of a writer that was lost stay unseen, and (epoch, line) is a total order
whatever names the part files have.
"""

from __future__ import annotations

import os
import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCHS = "_epochs"


def create_if_absent(spark: SparkSession, path: str) -> bool:
    """Creates an empty file; false where it is there already, also to all but one of several writers at once."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        os.makedirs(os.path.dirname(where.path), exist_ok=True)
        try:
            os.close(os.open(where.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
        except FileExistsError:
            return False
        return True
    from py4j.protocol import Py4JJavaError

    fs, at = _filesystem(spark, path)
    try:
        fs.create(at, False).close()
    except Py4JJavaError as e:
        if fs.exists(at):
            return False
        raise OSError(f"{path}: {e.java_exception}") from e
    return True


def _filesystem(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none where there is no such folder."""
    fs, at = _filesystem(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def _numbers(spark: SparkSession, path: str, kind: str) -> set[int]:
    return {int(m[1]) for x in names(spark, f"{path}/{_EPOCHS}") if (m := re.fullmatch(rf"(\d+)\.{kind}", x))}


def claim(spark: SparkSession, path: str) -> int:
    """The number of a new epoch, which no other writer gets."""
    epoch = max(_numbers(spark, path, "claim"), default=-1) + 1
    while not create_if_absent(spark, f"{path}/{_EPOCHS}/{epoch:012d}.claim"):
        epoch += 1
    return epoch


def commit(spark: SparkSession, path: str, epoch: int) -> None:
    create_if_absent(spark, f"{path}/{_EPOCHS}/{epoch:012d}.done")


def unfinished(spark: SparkSession, path: str) -> list[int]:
    """Epochs that are claimed and not done: their writers are at work, or lost."""
    return sorted(_numbers(spark, path, "claim") - _numbers(spark, path, "done"))


def append(rows: DataFrame, path: str) -> int:
    """rows in their order as a new epoch of the log, a folder a lane; returns its number."""
    spark = rows.sparkSession
    epoch = claim(spark, path)
    rows.withColumn("_line", F.monotonically_increasing_id()).write.mode("error").partitionBy("lane").json(f"{path}/epoch={epoch}")
    commit(spark, path, epoch)
    return epoch
