"""URL patterns: which path positions are parameters, the templates that follow, their totals and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import templates, urls

# Fixed values of the parameter rule.
MANY_VALUES, VALUE_RATIO, LEAST_SEEN = 100, 0.6, 3
#: Locs of a file that count for patterns.
FILE_CAP = 500
#: Rows of one window partition of the running counts.
BLOCK = 100_000
AMOUNT = "decimal(38,10)"


def url_facts(locs: DataFrame, loc: str = "loc") -> DataFrame:
    """The rows that are URLs, with host, path, query and segs."""
    u = F.col(loc)
    facts = locs.where(urls.is_url(u)).withColumns({"host": urls.host(u), "path": urls.path(u), "query": urls.part(u, urls.QUERY)})
    return facts.withColumn("segs", urls.segments(F.col("path")))


def capped(locs: DataFrame, file: str = "source_file", position: str = "loc_idx", cap: int = FILE_CAP) -> DataFrame:
    """The first locs of each file by position from 0, each standing for total / cap of them (column weight)."""
    totals = locs.groupBy(F.col(file).alias("__file")).agg(F.count("*").alias("file_total"))
    weight = (F.greatest(F.col("file_total"), F.lit(cap)).cast(AMOUNT) / F.lit(cap)).cast(AMOUNT)
    return locs.where(F.col(position) < cap).join(totals, F.col(file) == F.col("__file")).drop("__file").withColumn("weight", F.when(F.col("file_total") > cap, weight).otherwise(F.lit(1).cast(AMOUNT)))


def _spread(facts: DataFrame, seq: str) -> DataFrame:
    return facts.select(F.col(seq).alias("seq"), F.posexplode("segs").alias("pos", "seg"))


def is_parameter(distinct: Column, seen: Column) -> Column:
    return (distinct > MANY_VALUES) | ((seen >= LEAST_SEEN) & (distinct >= VALUE_RATIO * seen))


def position_stats(facts: DataFrame, seq: str = "seq") -> DataFrame:
    """pos, distinct, seen and parameter by the totals of each position."""
    stats = _spread(facts, seq).groupBy("pos").agg(F.count_distinct("seg").alias("distinct_values"), F.count("*").alias("seen"))
    return stats.withColumn("parameter", is_parameter(F.col("distinct_values"), F.col("seen")))


def online_positions(facts: DataFrame, seq: str = "seq") -> DataFrame:
    """pos, parameter: whether the rule held at any point when URLs come in the order of seq.

    Running counts are taken in blocks of consecutive rows, each offset by the totals of the blocks
    before, so that no position is one window partition however many URLs there are.
    """
    spread = _spread(facts, seq).withColumn("block", F.floor(F.col("seq") / BLOCK))
    first = spread.groupBy("pos", "seg").agg(F.min("seq").alias("seq")).withColumn("new", F.lit(1))
    marked = spread.join(first, ["pos", "seg", "seq"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    totals = marked.groupBy("pos", "block").agg(F.count("*").alias("rows"), F.sum("new").alias("news"))
    earlier = Window.partitionBy("pos").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("pos", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("news").over(earlier), F.lit(0)).alias("news_before"))
    so_far = Window.partitionBy("pos", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    running = marked.join(offsets, ["pos", "block"]).select(
        "pos", (F.col("rows_before") + F.count("*").over(so_far)).alias("seen"), (F.col("news_before") + F.sum("new").over(so_far)).alias("distinct_values")
    )
    return running.groupBy("pos").agg(F.max(is_parameter(F.col("distinct_values"), F.col("seen"))).alias("parameter"))


def with_templates(facts: DataFrame, positions: DataFrame) -> DataFrame:
    """The facts with their template, by the positions whose parameter is true: one small row for all."""
    found = positions.where("parameter").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    return facts.crossJoin(F.broadcast(found)).withColumn("template", templates.template(F.col("segs"), F.col("positions"))).drop("positions")


def pattern_totals(rows: DataFrame) -> DataFrame:
    """template, total_urls and coverage_pct from rows with template and weight."""
    sums = rows.groupBy("template").agg(F.sum("weight").cast(AMOUNT).alias("__sum"))
    whole = sums.agg(F.sum("__sum").cast(AMOUNT).alias("__all"))
    total = F.greatest(F.lit(1), F.floor(F.col("__sum") + F.lit(0.5).cast(AMOUNT))).cast("long")
    return sums.crossJoin(F.broadcast(whole)).select(
        "template", total.alias("total_urls"), F.round(F.col("__sum") * 100 / F.col("__all"), 4).cast("decimal(7,4)").alias("coverage_pct")
    )


def file_occurrences(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """template, source_file, occurrences; the largest file of a template takes the rounding difference to its total."""
    sums = rows.groupBy("template", "source_file").agg(F.floor(F.sum("weight") + F.lit(0.5).cast(AMOUNT)).cast("long").alias("n"))
    by_template = Window.partitionBy("template")
    ranked = sums.withColumns({"rn": F.row_number().over(by_template.orderBy(F.desc("n"), "source_file")), "all": F.sum("n").over(by_template)})
    return ranked.join(totals.select("template", "total_urls"), "template").select(
        "template", "source_file", (F.col("n") + F.when(F.col("rn") == 1, F.col("total_urls") - F.col("all")).otherwise(0)).alias("occurrences")
    )


def source_file_lists(occurrences: DataFrame) -> DataFrame:
    """template, source_file: its files joined, the largest first."""
    files = F.sort_array(F.collect_list(F.struct((-F.col("occurrences")).alias("o"), F.col("source_file").alias("f"))))
    return occurrences.groupBy("template").agg(F.array_join(F.transform(files, lambda x: x["f"]), ", ").alias("source_file"))


def suspicious_segments(patterns: DataFrame) -> DataFrame:
    """template and the first of its fixed segments that looks like a leftover, null without one."""
    statics = patterns.select("template", F.explode(templates.static_segments(F.col("template"))).alias("segment"))
    shared = statics.groupBy("segment").agg(F.count_distinct("template").alias("templates"))
    found = statics.join(shared, "segment").where(templates.is_artifact(F.col("segment"), F.col("templates")))
    return patterns.select("template").join(found.groupBy("template").agg(F.min("segment").alias("suspicious_segment")), "template", "left")


def missing_in_current(patterns: DataFrame) -> DataFrame:
    """Patterns of role legacy whose template no pattern of role current has."""
    legacy, current = (patterns.where(F.col("source_role") == r) for r in ("legacy", "current"))
    return legacy.join(current.select("template"), "template", "left_anti")


def sample(rows: DataFrame, n: int, key: str = "template", url: str = "loc", seed: str = "0") -> DataFrame:
    """n rows of each key, the same ones every time: those of least hash of seed and URL."""
    order = Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed), F.col(url))), url)
    return rows.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def largest(patterns: DataFrame, n: int) -> DataFrame:
    return patterns.orderBy(F.desc("total_urls"), "template").limit(n)


def common_pattern(rows: DataFrame, key: str, segs: str = "segs") -> DataFrame:
    """key, template: fixed segments where all rows of a key with its number of segments agree, {param} elsewhere; null where numbers differ."""
    sizes = rows.groupBy(key).agg(F.min(F.size(segs)).alias("a"), F.max(F.size(segs)).alias("b"))
    spread = rows.select(key, F.posexplode(segs).alias("pos", "seg")).groupBy(key, "pos").agg(F.min("seg").alias("x"), F.max("seg").alias("y"))
    named = spread.select(key, F.struct("pos", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(templates.PARAM).alias("s")).alias("e"))
    built = named.groupBy(key).agg(F.concat(F.lit("/"), F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["s"]), "/")).alias("t"))
    return sizes.join(built, key, "left").select(key, F.when(F.col("a") == F.col("b"), F.coalesce("t", F.lit("/"))).alias("template"))
