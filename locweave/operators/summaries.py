"""Summaries of URL patterns that merge: batches of files are mined one by one, and any split gives the table of one pass.

A batch keeps, of each path position, how often it was seen and up to MANY_VALUES + 1 different segments: enough to know
whether it is a parameter in any union of batches. It keeps its URLs as shapes: their segments with a parameter wherever
the batch alone has too many values at a position, which no other batch can undo; counts and samples of least hash go
with each shape. Old URLs are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import templates
from ..shipping import scratch
from .patterns import MANY_VALUES, is_parameter, url_facts

SAMPLES = 5


def positions_of(facts: DataFrame) -> DataFrame:
    """pos, seen, segs of a batch: segs has the least MANY_VALUES + 1 different segments at most."""
    spread = facts.select(F.posexplode("segs").alias("pos", "seg")).groupBy("pos", "seg").agg(F.count("*").alias("n"))
    seen = spread.groupBy(F.col("pos").alias("of")).agg(F.sum("n").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("pos").orderBy("seg"))  # cut by tasks before rows meet
    least = spread.select("pos", "seg", rank.alias("rank")).where(F.col("rank") <= MANY_VALUES + 1).groupBy("pos").agg(F.sort_array(F.collect_list("seg")).alias("segs"))
    return least.join(seen, F.col("pos") == F.col("of")).select("pos", "seen", "segs")


def shapes_of(facts: DataFrame, positions: DataFrame, n: int = SAMPLES, seed: str = "0") -> DataFrame:
    """shape, urls, samples (hash, url) of a batch."""
    many = positions.where(F.size("segs") > MANY_VALUES).agg(F.collect_list("pos").alias("many"))
    shape = F.transform("segs", lambda s, i: F.when(F.array_contains("many", i), F.lit(templates.PARAM)).otherwise(s))
    shaped = facts.crossJoin(F.broadcast(many)).select(shape.alias("shape"), "loc", F.md5(F.concat(F.lit(seed), "loc")).alias("hash"))
    return _least(shaped.groupBy("shape", "hash", "loc").agg(F.count("*").alias("urls")), "shape", n)


def _least(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, urls and the n different URLs of least hash, from rows of key, hash, loc, urls."""
    totals = rows.groupBy(F.col(key).alias("of")).agg(F.sum("urls").alias("urls"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("hash", "loc"))
    kept = rows.select(key, "hash", "loc", rank.alias("rank")).where(F.col("rank") <= n).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("hash", "loc"))).alias("samples"))
    return kept.join(totals, F.col(key) == F.col("of")).select(key, "urls", "samples")


def summary(locs: DataFrame, n: int = SAMPLES) -> tuple[DataFrame, DataFrame]:
    """The positions and the shapes of a batch of locs (loc), to be kept as two tables; what is no URL counts for nothing."""
    spark = locs.sparkSession
    facts = url_facts(locs.select("loc"))
    # Written once: the shapes would count the positions again.
    path = scratch(spark, "positions")
    made = positions_of(facts)
    made.write.parquet(path)
    positions = spark.read.schema(made.schema).parquet(path)
    return positions, shapes_of(facts, positions, n)


def merged_positions(kept: DataFrame) -> DataFrame:
    """pos, seen, segs of all batches whose positions are kept: a merge of merges is one too."""
    both = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("segs")))), 1, MANY_VALUES + 1)
    return kept.groupBy("pos").agg(F.sum("seen").alias("seen"), both.alias("segs"))


def table(positions: DataFrame, shapes: DataFrame, n: int = SAMPLES) -> DataFrame:
    """template, urls, samples of everything that was summed up: positions and shapes are those of any number of batches."""
    held = merged_positions(positions)
    found = held.where(is_parameter(F.size("segs"), F.col("seen"))).agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    named = shapes.crossJoin(F.broadcast(found)).withColumn("template", templates.template(F.col("shape"), F.col("positions")))
    # Samples of a shape are those of its URLs alone, so the least of all lie among them; counts go with one of each shape's.
    rows = named.select("template", "urls", F.posexplode("samples").alias("at", "s")).select("template", "s.hash", "s.loc", F.when(F.col("at") == 0, F.col("urls")).otherwise(0).alias("urls"))
    return _least(rows.groupBy("template", "hash", "loc").agg(F.sum("urls").alias("urls")), "template", n).select("template", "urls", F.transform("samples", lambda s: s["loc"]).alias("samples"))
