"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Runs of digits, lower-case letters and everything beyond ASCII.
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter alone."""
    return F.translate(c, UPPER, UPPER.lower())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def row_key(*columns: Column) -> Column:
    """A text that equal rows share, nulls included."""
    return F.to_json(F.struct(*columns))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the one named by ``spark.checkpoint.dir``, or set as the context's checkpoint folder.  Only a
    session whose tasks all run on this machine may go without it; such a session gets a folder of
    its own.
    """
    context = spark.sparkContext
    known = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if known:
        return known
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


#: The tables of the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts the lineage, and any executor may be lost after."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docloom-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A scope whose written tables are deleted at its end; what it yields writes a table that outlives it.

    Only what was written through that may be used afterwards.
    """
    own: list[str] = []

    def result(df: DataFrame, name: str) -> DataFrame:
        last = _SCOPES.pop()
        try:
            return written(df, name)
        finally:
            _SCOPES.append(last)

    _SCOPES.append(own)
    try:
        yield result
    finally:
        _SCOPES.remove(own)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at.getParent(), True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """A scope in which so many rows at most go to Python at a time; for jobs that run within it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
