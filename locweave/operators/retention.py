"""Retention over trees of files: newest times and sizes of folders, what is past its time, and what a ceiling leaves no room for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordering import placed

#: Rows of a block of the running sum.
BLOCK = 100_000


def folders(files: DataFrame) -> DataFrame:
    """folder, newest, bytes, files: of every folder above the files (path, modified, bytes), with all that is below it.

    The top folder is the empty name. A file counts for as many folders as its path has, and these are summed before they
    move, so a folder that holds everything is no task of its own. Null sizes are 0; null times are no times.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    spread = files.where("path IS NOT NULL").select(F.explode(above).alias("folder"), "modified", "bytes")
    return spread.groupBy("folder").agg(F.max("modified").alias("newest"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def expired(tree: DataFrame, now: Column, keep: str, depth: int = 1) -> DataFrame:
    """The folders so deep below the top in which nothing is newer than the time to keep; what has no time at all is past it."""
    deep = F.size(F.filter(F.split("folder", "/"), lambda p: p != "")) == depth
    return tree.where(deep & (F.coalesce(F.col("newest") < now - F.expr(f"INTERVAL {keep}"), F.lit(True))))


def running_total(rows: DataFrame, order: list[Column], size: str, name: str = "running") -> DataFrame:
    """The rows with the sum of sizes up to each in one order of all, its own included.

    Rows are placed in the order, summed by blocks of places, and within each block from where the ones before end: what
    one task has is a block, and a row a block.
    """
    held = placed(rows, order, "__at", 0).withColumn("__block", F.floor(F.col("__at") / BLOCK))
    sums = held.groupBy(F.col("__block").alias("__of")).agg(F.sum(size).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__of", before.alias("__before"))
    within = F.sum(size).over(Window.partitionBy("__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    joined = held.withColumn("__within", within).join(F.broadcast(offsets), F.col("__block") == F.col("__of"))
    return joined.select(*rows.columns, (F.col("__before") + F.col("__within")).alias(name))


def sweep(days: DataFrame, today: Column, retention_days: int, ceiling: int) -> DataFrame:
    """day, bytes, reason of day folders (day as an ISO date, bytes): expired, over ceiling, or kept.

    A day is expired when it is before the day so many days ago. Of the others the oldest go until the rest is no
    more than the ceiling: a day goes where it and all later ones come to more.
    """
    cutoff = F.date_format(F.date_sub(today, retention_days), "yyyy-MM-dd")
    marked = days.select("day", F.coalesce("bytes", F.lit(0)).alias("bytes"), (F.col("day") < cutoff).alias("past"))
    alive = running_total(marked.where(~F.col("past")), [F.col("day").desc()], "bytes")
    reason = F.when(F.col("running") > ceiling, "over ceiling").otherwise("kept")
    return alive.select("day", "bytes", reason.alias("reason")).unionByName(marked.where("past").select("day", "bytes", F.lit("expired").alias("reason")))
