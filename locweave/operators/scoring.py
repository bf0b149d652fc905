"""Scores of patterns from sampled URLs, the health of an inventory, and what redirects tell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, templates, urls

AMOUNT = "decimal(38,10)"


def observe(samples: DataFrame) -> DataFrame:
    """Samples with category, weight and is_hit, from http_status and is_soft_404."""
    kind = rules.category(F.col("http_status"), F.col("is_soft_404"))
    return samples.withColumn("category", kind).withColumn("weight", rules.weight(F.col("category"))).withColumn("is_hit", F.col("category") == "success")


def pattern_scores(samples: DataFrame) -> DataFrame:
    """pattern_id, samples, confidence_pct, redirect_pct and status."""
    pct = lambda c: F.round(F.sum(c).cast(AMOUNT) * 100 / F.count("*"), 2).cast("decimal(5,2)")
    scored = samples.groupBy("pattern_id").agg(F.count("*").alias("samples"), pct(F.col("weight")).alias("confidence_pct"), pct((F.col("redirect_count") > 0).cast("int")).alias("redirect_pct"))
    return scored.withColumn("status", rules.status_bucket(F.col("confidence_pct")))


def recomputed(samples: DataFrame, patterns: DataFrame) -> DataFrame:
    """Patterns with confidence and redirect share by stored categories; those without samples keep what they had."""
    pct = lambda c: F.round(F.sum(c).cast(AMOUNT) * 100 / F.count("*"), 2).cast("decimal(5,2)")
    new = samples.groupBy("pattern_id").agg(pct(rules.weight(F.col("category"))).alias("new_confidence"), pct((F.col("category") == "redirect").cast("int")).alias("new_redirect"))
    both = patterns.join(new, "pattern_id", "left")
    return both.withColumns({"confidence_pct": F.coalesce("new_confidence", "confidence_pct"), "redirect_pct": F.coalesce("new_redirect", "redirect_pct")}).drop("new_confidence", "new_redirect").withColumn(
        "status", rules.status_bucket(F.col("confidence_pct"))
    )


def health_score(patterns: DataFrame) -> DataFrame:
    """One row: the confidence of current patterns weighed by coverage, as a whole number; null without coverage."""
    current = patterns.where("source_role = 'current'")
    weighed = F.sum(F.coalesce("confidence_pct", F.lit(0)).cast(AMOUNT) * F.col("coverage_pct").cast("decimal(18,4)"))
    return current.agg(F.round(weighed.cast(AMOUNT) / F.nullif(F.sum("coverage_pct").cast(AMOUNT), F.lit(0).cast(AMOUNT)), 0).cast("int").alias("health_score"))


def status_counts(patterns: DataFrame) -> DataFrame:
    return patterns.agg(
        F.count_if(F.col("status") == "GOOD").alias("healthy"),
        F.count_if(F.col("status") == "WARNING").alias("warning"),
        F.count_if(F.col("status") == "BAD").alias("broken"),
        F.count_if(F.col("redirect_pct") > 50).alias("redirect_heavy"),
    )


def health_distribution(patterns: DataFrame) -> DataFrame:
    """bucket, n for the three buckets, with zeros."""
    spark = patterns.sparkSession
    buckets = spark.createDataFrame([("GOOD",), ("WARNING",), ("BAD",)], "bucket string")
    n = patterns.groupBy(F.col("status").alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def redirect_artifacts(samples: DataFrame, patterns: DataFrame) -> DataFrame:
    """pattern_id, segment: the fixed segment that most redirects drop, if half of them at least do.

    samples has pattern_id, url and final_url of redirected ones; ties go to the name.
    """
    moved = samples.join(patterns.select("pattern_id", "template"), "pattern_id")
    dropped = F.array_except(
        F.array_intersect(F.array_distinct(urls.segments(urls.path(F.col("url")))), templates.static_segments(F.col("template"))), urls.segments(urls.path(F.col("final_url")))
    )
    n = moved.groupBy("pattern_id").agg(F.count("*").alias("redirects"))
    counts = moved.select("pattern_id", F.explode(dropped).alias("segment")).groupBy("pattern_id", "segment").agg(F.count("*").alias("c")).join(n, "pattern_id")
    enough = counts.where(F.col("c") >= F.greatest(F.lit(1), F.ceil(F.col("redirects") / 2)))
    return enough.groupBy("pattern_id").agg(F.min_by("segment", F.struct(-F.col("c"), F.col("segment"))).alias("segment"))


def redirect_rules(pairs: DataFrame) -> DataFrame:
    """pattern_id, rule: what all source and dest pairs of a pattern agree on; patterns without agreement are left out."""
    found = pairs.where("source <> dest").withColumn("rule", rules.diff_rule(F.col("source"), F.col("dest")))
    shape = F.when(F.col("rule.find") != "", F.struct(F.lit("").alias("prefix"), F.col("rule.find").alias("find"), F.col("rule.put").alias("put"))).otherwise(F.col("rule"))
    agreed = found.withColumn("rule", shape).groupBy("pattern_id").agg(F.min("rule").alias("rule"), F.max("rule").alias("other"))
    return agreed.where("rule = other").select("pattern_id", "rule")


def insights(patterns: DataFrame) -> DataFrame:
    """pattern_id, ordinal, kind for up to six remarks a pattern, in their fixed order."""
    weak = F.col("status").isin("WARNING", "BAD")
    kinds = [
        (F.coalesce("missing_in_current", F.lit(False)), "missing"),
        (weak, "failed"),
        (F.col("suspicious_segment").isNotNull(), "suspicious"),
        (F.col("redirect_pct") > 50, "redirects"),
        (F.col("artifact_segment").isNotNull(), "artifact"),
        (F.coalesce("has_soft_404", F.lit(False)), "soft_404"),
    ]
    said = F.array(*[F.when(c, F.struct(F.lit(i).alias("ordinal"), F.lit(k).alias("kind"))) for i, (c, k) in enumerate(kinds)])
    return patterns.select("pattern_id", F.explode(F.filter(said, lambda x: x.isNotNull())).alias("s")).select("pattern_id", "s.ordinal", "s.kind")
