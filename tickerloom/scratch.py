"""Fault-tolerant intermediate tables.

Some operators need the same intermediate rows twice and must see identical
rows both times, even if executors are lost in between.  Those rows are
written to the shared folder named by ``spark.checkpoint.dir``; a session
without that setting uses a folder inside its warehouse, which executors
share as well.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession


#: Paths of the tables stored within the innermost :func:`temporary`.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/tickerloom/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` once, with ``options`` of the writer, and return a scan of the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("errorifexists").options(**{"compression": "lz4"} | (options or {})).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._scratch_path = path
    if (made := _made.get()) is not None:
        made.append(path)
    return stored


def observed(df: DataFrame, metrics: Sequence[Column]) -> tuple[DataFrame, Observation]:
    """``df`` with aggregates that its next job computes on the way."""
    seen = Observation()
    return df.observe(seen, *metrics), seen


def materialize_checked(df: DataFrame, label: str, metrics: Sequence[Column]) -> tuple[DataFrame, dict]:
    """:func:`materialize`, and the values of ``metrics`` over the rows, from the same job."""
    df, seen = observed(df, metrics)
    stored = materialize(df, label)
    return stored, seen.get


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(stored: DataFrame) -> None:
    """Delete a table that :func:`materialize` returned and nothing reads any more."""
    _delete(stored.sparkSession, stored._scratch_path)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now.

    Its cleaner drops them when the driver collects the garbage, which may else
    happen only after several large steps.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each query made and run within as soon as it ends.

    Data frames made within must not be run twice after it, so lazy results are made outside.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete at its end the tables stored within, and the shuffle files of the steps.

    It gives a function that returns the stored table it gets and leaves it to the
    code around. What a lazy result still reads must be left so. After an error all tables stay.
    """
    around, made, left = _made.get(), [], []

    def leave(stored: DataFrame) -> DataFrame:
        left.append(stored._scratch_path)
        return stored

    token = _made.set(made)
    try:
        yield leave
    finally:
        _made.reset(token)
    for path in made:
        if path not in left:
            _delete(spark, path)
    if around is not None:
        around.extend(left)
    release_shuffles(spark)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has stored; for the end of a session, when no result is read any more."""
    _delete(spark, f"{scratch_root(spark)}/tickerloom/{spark.sparkContext.applicationId}")
