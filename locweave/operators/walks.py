"""Walks over graphs of index files: level by level from a root, each file once, however the indexes point to each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..shipping import scratch


def edges_of(scanned: DataFrame, base: str = "url") -> DataFrame:
    """parent, child, position of the indexes among scanned files (url, root, locs): children by whole URLs, resolved against their index's own.

    A child named twice by an index stands where it first does. Children of other hosts are children too.
    """
    spread = scanned.where("root = 'sitemapindex'").select(F.col(base).alias("parent"), F.posexplode("locs").alias("position", "loc"))
    return spread.groupBy("parent", urls.resolve(F.col("parent"), F.col("loc")).alias("child")).agg(F.min("position").alias("position"))


def walk(edges: DataFrame, roots: DataFrame, depth: int, most: int | None = None) -> DataFrame:
    """url, level of what can be reached from the roots (url) in so many steps: the fewest steps that lead there.

    A level is what the one before points to, less all that was reached earlier, so cycles and many ways to one
    file end. With a bound the walk stops after the level that reaches it: what is reached is whole levels, nearest
    first. Each level is a table in the shared folder, and those of earlier ones are not computed again.
    """
    spark = edges.sparkSession

    def kept(rows: DataFrame) -> DataFrame:
        path = scratch(spark, "walk")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    held = kept(edges.select("parent", "child").where("parent IS NOT NULL AND child IS NOT NULL").distinct())
    level = kept(roots.select("url").where("url IS NOT NULL").distinct().withColumn("level", F.lit(0)))
    reached, n = level, level.count()
    for k in range(1, depth + 1):
        if most is not None and n >= most:
            break
        pointed = level.join(held, F.col("url") == F.col("parent")).select(F.col("child").alias("url")).distinct()
        level = kept(pointed.join(reached.select("url"), "url", "left_anti").withColumn("level", F.lit(k)))
        new = level.count()
        if not new:
            break
        reached, n = reached.unionByName(level), n + new
    return reached


def pages_below(scanned: DataFrame, roots: DataFrame, depth: int = 4, most: int = 100_000) -> DataFrame:
    """loc, level of the pages of the urlsets that a walk from the roots comes to, at most so many: nearest first, then by name.

    scanned has url, root and locs. The level of a page is that of the nearest file that has it; the bound is the
    operator's own. Files that are not there are passed over.
    """
    found = walk(edges_of(scanned), roots, depth)
    sets = scanned.where("root = 'urlset'").select(F.col("url").alias("of"), "locs")
    pages = found.join(sets, F.col("url") == F.col("of")).select(F.explode("locs").alias("loc"), "level")
    return pages.groupBy("loc").agg(F.min("level").alias("level")).orderBy("level", "loc").limit(most)
