"""What the training-data operators share: tables, the shared folder, materialised steps.

Every operator takes and returns DataFrames.  Extra input columns are ignored
unless the operator says that it passes them on, so a clashing name in them
cannot matter: inputs are projected to the columns an operator needs first.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract, as a Java and Python character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_kept: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or (unset, as in tests) a temporary one."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='corvane-')}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _remove(path: str) -> None:
    """Deletes a folder; where Arrow doesn't know its file system, Spark replaces what it holds by an empty table."""
    try:
        fs, at = pafs.FileSystem.from_uri(path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)
    except (OSError, pa.ArrowException):
        if (spark := SparkSession.getActiveSession()) is not None:
            spark.createDataFrame([], "x int").write.mode("overwrite").parquet(path)


def _written(df: DataFrame, path: str) -> DataFrame:
    """df, written once as Parquet and read again; the job's shuffle files go as soon as it has ended."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


class Steps:
    """An operator's intermediate tables: ``with Steps(spark) as step: small = step(df, "small")``.

    Each is written once in the shared folder, so a later loss of executors recomputes nothing; all are deleted when the
    operator has its result, which it writes with ``materialize`` because nothing may read a step from then on.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.root, self.n = f"{shared_dir(spark)}/corvane-steps-{uuid.uuid4().hex}", 0

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.root}/{self.n}-{name}")

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_: object) -> None:
        if self.n:
            _remove(self.root)


def materialize(df: DataFrame, name: str = "result") -> DataFrame:
    """df, written once in the shared folder and read again; it stays until the process ends or ``discard`` is called."""
    if not _kept:
        atexit.register(discard)
    _kept.append(f"{shared_dir(df.sparkSession)}/corvane-{name}-{uuid.uuid4().hex}")
    return _written(df, _kept[-1])


def discard(but: tuple[str, ...] = ()) -> None:
    """Deletes what ``materialize`` has written, except the paths in but."""
    for path in [p for p in _kept if p not in but]:
        _remove(path)
        _kept.remove(path)


def kept() -> tuple[str, ...]:
    """The paths that ``materialize`` has written and that are still there."""
    return tuple(_kept)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row, though body names it many times (also in lambdas)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_space(text: Column) -> Column:
    """text without white space; six byte-wise replacements are several times faster than one regular expression."""
    for c in (" ", "\n", "\t", "\r", "\x0b", "\x0c"):
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def word_array(text: Column) -> Column:
    """The words of text; null and blank texts have none."""
    parts = F.split(F.coalesce(text, F.lit("")), SPACE + "+")
    return F.array_remove(parts, "")


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of the key's decimal text, modulo n; null keys count as an empty text."""
    return F.crc32(F.encode(F.coalesce(key.cast("string"), F.lit("")), "UTF-8")) % n


def uniform_order(key: Column, seed: str) -> Column:
    """A reproducible order that has nothing to do with the key's own; used to choose bounded training samples."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit(""))))
