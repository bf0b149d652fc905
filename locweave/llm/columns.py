"""Column expressions and small table helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import scratch
from ..shipping import ship as ship_package

#: Bytes of an Arrow batch between Spark and Python about. Spark's own 64 MB are held several times over on either side.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

WHITE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, and have batches to them of a moderate size unless the session sets another."""
    ship_package(spark)
    if spark.conf.get(_BATCH, "1b") == "1b":
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else, whatever the locale."""
    return F.translate(text, UPPER, UPPER.lower())


def without_white(text: Column) -> Column:
    """The text without its ASCII white space."""
    for char in WHITE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def all_of(frame: DataFrame) -> list[Column]:
    """The frame's columns by name, whatever characters the names have."""
    return [F.col(quoted(c)) for c in frame.columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The tables written in the innermost of the open blocks of this thread.
_WRITTEN: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, read back: its lineage ends there and a lost executor costs nothing."""
    spark = frame.sparkSession
    path = scratch(spark, name)
    frame.write.parquet(path)
    if (made := _WRITTEN.get()) is not None:
        made.append(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A block whose written tables are deleted at its end; what it gives writes one that stays."""
    outer, mine = _WRITTEN.get(), []
    token = _WRITTEN.set(mine)

    def lasting(frame: DataFrame, name: str) -> DataFrame:
        out = written(frame, name)
        path = mine.pop()
        if outer is not None:
            outer.append(path)
        return out

    try:
        yield lasting
    finally:
        _WRITTEN.reset(token)
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release_memory() -> None:
    """Give back what a Python worker has freed; workers live on after a task, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
