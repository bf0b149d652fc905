"""URLs on hosts that are not their session's: which they are, in which files, and what leaving them out would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from . import exports, workflow


def on_domain(loc: Column, expected: Column, unparsable: bool = False) -> Column:
    """Whether a loc's host is the expected one or below it; what has no host is taken for unparsable says."""
    return F.coalesce(urls.same_domain(urls.loc_host(loc), urls.normalize_host(expected)), F.lit(unparsable))


def on_domain_locs(locs: DataFrame, expected: str) -> DataFrame:
    """The locs for cleaning: those of other hosts, and those without a host, go."""
    return locs.where(on_domain(F.col("loc"), F.lit(expected)))


def downloadable(locs: DataFrame, expected: str) -> DataFrame:
    """The locs for a download without other hosts: what has no host stays as it is."""
    return locs.where(on_domain(F.col("loc"), F.lit(expected), True))


def split_hosts(locs: DataFrame, expected: str, role: str = "source_role") -> tuple[DataFrame, DataFrame]:
    """The locs to extract from, and the mismatched ones with host: only those of role current are held to the domain."""
    kept = (F.col(role) == "legacy") | on_domain(F.col("loc"), F.lit(expected))
    return locs.where(kept), locs.where(~kept).withColumn("host", urls.loc_host(F.col("loc")))


def per_file(mismatched: DataFrame, files: DataFrame) -> DataFrame:
    """file_idx, source_file, mismatches, hosts (different ones, in order, joined) of files with any."""
    found = mismatched.groupBy(F.col("file_idx").alias("__f")).agg(F.count("*").alias("mismatches"), F.array_join(F.sort_array(F.collect_set("host")), ", ").alias("hosts"))
    return files.join(found, F.col("file_idx") == F.col("__f")).select("file_idx", "source_file", "mismatches", "hosts")


def impact(files: DataFrame, edited_only: bool = False) -> DataFrame:
    """What a download without other hosts does to the current files that have such, the largest first: file_id, filename, total_urls, foreign_url_count, foreign_url_count_is_minimum, will_be_empty.

    files has file_id, session_id, stored_name, source_role, deleted, is_index, total_urls and mismatched_url_count (null: 0). Deleted
    files, indexes and those kept as URLs are passed over. A count below the file's total may be that of a sample, and
    so is a least one; a file is said to be emptied only where the count covers it all.
    """
    rows = files.where((F.col("source_role") == "current") & ~F.col("deleted") & ~F.col("is_index") & ~F.col("stored_name").rlike("^https?://"))
    rows = rows.where(workflow.is_edited(F.col("stored_name"), F.col("session_id"))) if edited_only else rows
    total, foreign = F.coalesce("total_urls", F.lit(0)).cast("long"), F.coalesce("mismatched_url_count", F.lit(0)).cast("long")
    told = rows.where(foreign > 0).select(
        "file_id", exports.download_name(F.col("stored_name"), F.col("session_id")).alias("filename"), total.alias("total_urls"), foreign.alias("foreign_url_count"),
        (total > foreign).alias("foreign_url_count_is_minimum"), ((total > 0) & (foreign >= total)).alias("will_be_empty"),
    )
    return told.orderBy(F.desc("foreign_url_count"), "filename")


def impact_totals(by_file: DataFrame) -> DataFrame:
    """One row: whether there are any, files touched, the least number of URLs that go, and whether any count is that of a sample."""
    return by_file.agg(
        (F.count("*") > 0).alias("has_foreign_urls"), F.count("*").alias("total_affected_files"), F.coalesce(F.sum("foreign_url_count"), F.lit(0)).alias("total_foreign_urls_min"),
        F.coalesce(F.max("foreign_url_count_is_minimum"), F.lit(False)).alias("counts_are_sampled"),
    )


def occurrences_of(locs: DataFrame, url: Column) -> DataFrame:
    """source_file, n of the files that hold exactly this URL."""
    return locs.where(F.col("loc") == url).groupBy("source_file").agg(F.count("*").alias("n"))
