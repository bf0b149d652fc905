"""Sending this package to the Python workers of a session."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they need no path of the driver's."""
    context = spark.sparkContext
    if any("locweave-" in f for f in context.listFiles):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / f"locweave-{uuid.uuid4().hex[:8]}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it; one below the warehouse where none is set.

    On a cluster a warehouse on a local disk is no such folder, and refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and warehouse.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{warehouse}/_scratch"


#: Paths in shared folders that this process has named, by the application they were named for.
_NAMED: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there stays until it is cleared."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _NAMED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def cleared(spark: SparkSession, *paths: str) -> int:
    """Delete these tables, or without any all that this process has written for the session, and say how many there were.

    Frames that read them are of no more use, so this is for the end of a job or a session.
    """
    named = _NAMED.get(spark.sparkContext.applicationId, [])
    gone = 0
    for path in paths or list(named):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True))
        if path in named:
            named.remove(path)
    return gone


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """A block whose tables in the shared folder are deleted at its end; what it gives must not read them."""
    held = set(_NAMED.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        if mine := [p for p in _NAMED.get(spark.sparkContext.applicationId, []) if p not in held]:
            cleared(spark, *mine)
