"""An append-only log of edits of URLs: any of them can be taken back while later ones stay, and any version looked at.

An entry is an edit (a rewrite's specification, or a deletion, with the files it is for) or takes back an earlier
entry, which may itself be one that took something back. URLs are never overwritten: what they are as of a version is
the fold of the edits in force over what they were at first, as one chain of columns without a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rewriting

ENTRY = "version long, action string, spec string, files array<string>, undoes long, at timestamp"


class EditError(ValueError):
    """An entry that refers to one that is not there or not in force."""


@dataclass(frozen=True)
class Entry:
    version: int
    action: str
    spec: dict[str, Any] | None
    files: tuple[str, ...] | None
    undoes: int | None

    def applies(self, file: Column) -> Column:
        return F.lit(True) if self.files is None else F.coalesce(file.isin(*self.files), F.lit(False))


class EditLog:
    """The log below a path, a row a file of its own; entries are read in the order of versions.

    The driver reads the entries, which people make one at a time, and never the URLs. There is one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.spark.createDataFrame([], ENTRY).write.mode("append").parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ENTRY).parquet(self.path)

    def entries(self, version: int | None = None) -> list[Entry]:
        rows = self.rows() if version is None else self.rows().where(F.col("version") <= version)
        return [Entry(r.version, r.action, json.loads(r.spec) if r.spec else None, tuple(r.files) if r.files is not None else None, r.undoes) for r in rows.orderBy("version").collect()]

    def _append(self, action: str, spec: dict[str, Any] | None, files: list[str] | None, undoes: int | None, at: str | None) -> int:
        version = (self.rows().agg(F.max("version")).first()[0] or 0) + 1
        row = self.spark.range(1).select(
            F.lit(version).cast("long").alias("version"), F.lit(action).alias("action"), F.lit(json.dumps(spec, sort_keys=True) if spec else None).cast("string").alias("spec"),
            (F.array(*[F.lit(f) for f in files]) if files is not None else F.lit(None)).cast("array<string>").alias("files"), F.lit(undoes).cast("long").alias("undoes"),
            (F.current_timestamp() if at is None else F.lit(at).cast("timestamp")).alias("at"),
        )
        row.coalesce(1).write.mode("append").parquet(self.path)
        return version

    def edit(self, spec: dict[str, Any], files: list[str] | None = None, at: str | None = None) -> int:
        """Enter a rewrite by its specification (see rewriting.REWRITERS), of all files or of some; returns its version."""
        if spec.get("kind") not in rewriting.REWRITERS:
            raise EditError(f"no rewrite is called {spec.get('kind')!r}")
        return self._append("edit", spec, files, None, at)

    def delete(self, url: str, files: list[str] | None = None, at: str | None = None) -> int:
        """Enter the deletion of an URL as it is then."""
        return self._append("delete", {"url": url}, files, None, at)

    def undo(self, version: int, at: str | None = None) -> int:
        """Take back one entry that is in force; later ones stay. To take back what took something back puts that in force again."""
        held = {e.version: e for e in self.entries()}
        if version not in held:
            raise EditError(f"there is no version {version}")
        if version not in in_force(list(held.values())):
            raise EditError(f"version {version} is not in force")
        return self._append("undo", None, None, version, at)


def in_force(entries: list[Entry]) -> set[int]:
    """The versions in force: those that no entry in force takes back; a later entry is settled before an earlier one."""
    alive: set[int] = set()
    taken: set[int] = set()
    for e in sorted(entries, key=lambda e: -e.version):
        if e.version not in taken:
            alive.add(e.version)
            if e.undoes is not None:
                taken.add(e.undoes)
    return alive


def _steps(entries: list[Entry], loc: Column, file: Column) -> list[tuple[Entry, Column]]:
    """The edits in force in their order, each with the URL after it; after a deletion that is null."""
    alive, steps = in_force(entries), []
    for e in sorted(entries, key=lambda e: e.version):
        if e.version not in alive or e.action == "undo":
            continue
        if e.action == "delete":
            after = F.when(~(e.applies(file) & (loc == e.spec["url"])), loc)
        else:
            after = F.coalesce(F.when(e.applies(file), rewriting.REWRITERS[e.spec["kind"]](loc, e.spec)), loc)
        steps.append((e, after))
    return steps


def as_of(rows: DataFrame, entries: list[Entry], loc: str = "loc", file: str = "source_file") -> DataFrame:
    """The rows (as they were at first) with loc after the entries; deleted ones and those without a URL are left out."""
    held = rows
    for _, after in _steps(entries, F.col(loc), F.col(file)):
        held = held.withColumn(loc, after)
    return held.where(F.col(loc).isNotNull())


def history(rows: DataFrame, entries: list[Entry], key: str = "seq", loc: str = "loc", file: str = "source_file") -> DataFrame:
    """key, version, before, after of each change that the edits in force make, one row a URL and edit that changes it."""
    held = rows.withColumn("changes", F.array().cast("array<struct<version:long,before:string,after:string>>"))
    for e, after in _steps(entries, F.col(loc), F.col(file)):
        change = F.array(F.struct(F.lit(e.version).cast("long").alias("version"), F.col(loc).alias("before"), after.alias("after")))
        held = held.withColumns({"changes": F.when(F.col(loc).eqNullSafe(after), F.col("changes")).otherwise(F.concat("changes", change)), loc: after})
    return held.select(key, F.explode("changes").alias("c")).select(key, "c.*")
