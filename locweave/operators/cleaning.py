"""Cleaning of many sitemap files at once: selection, first-wins deduplication across files, reports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls
from ..shipping import scratch
from . import ordering


def file_totals(locs: DataFrame, expected: str) -> DataFrame:
    """file_idx, source_file, total and matching (locs of the expected domain or below it)."""
    match = F.coalesce(urls.same_domain(urls.loc_host(F.col("loc")), urls.normalize_host(F.lit(expected))), F.lit(False))
    return locs.groupBy("file_idx", "source_file").agg(F.count("*").alias("total"), F.count_if(match).alias("matching"))


def select_files(files: DataFrame) -> DataFrame:
    """The files with decision: unparsable, index (set aside), wrong_domain or candidate.

    files has is_valid, root_element, total and matching. A file without locs stays a candidate.
    """
    decision = (
        F.when(~F.col("is_valid"), "unparsable")
        .when(F.lower(F.coalesce("root_element", F.lit(""))) == "sitemapindex", "index")
        .when((F.col("total") > 0) & (2 * F.col("matching") < F.col("total")), "wrong_domain")
        .otherwise("candidate")
    )
    return files.withColumn("decision", decision)



def _keyed(locs: DataFrame, exact: bool, keep_query: bool) -> DataFrame:
    key = F.col("loc") if exact else urls.dedup_key(F.col("loc"), keep_query)
    held = locs.withColumn("__key", key)
    # The first of each key is found by a partial aggregate, so that a key that many files share is no task of its own.
    first = held.groupBy(F.col("__key").alias("__of")).agg(F.min_by("source_file", F.struct("file_idx", "loc_idx")).alias("kept_in"), F.min(F.struct("file_idx", "loc_idx")).alias("__first"))
    first = first.select(F.concat("__of", F.lit("")).alias("__of"), "kept_in", "__first")
    return held.join(first, F.col("__key") == F.col("__of")).withColumn("is_first", F.struct("file_idx", "loc_idx") == F.col("__first")).drop("__of", "__first")


def _kept(keyed: DataFrame, columns: list[str]) -> DataFrame:
    return keyed.where("is_first").select(*columns)


def _later(keyed: DataFrame) -> DataFrame:
    return keyed.where(~F.col("is_first")).select("file_idx", "loc_idx", F.col("loc").alias("url"), "kept_in", F.col("source_file").alias("duplicate_in"))


def first_wins(locs: DataFrame, exact: bool = False, keep_query: bool = False) -> DataFrame:
    """The first loc of each key in the order of files and positions, as it was written."""
    return _kept(_keyed(locs, exact, keep_query), locs.columns)


def duplicates(locs: DataFrame, exact: bool = False, keep_query: bool = False) -> DataFrame:
    """file_idx, loc_idx, url, kept_in, duplicate_in of every loc that is not the first of its key."""
    return _later(_keyed(locs, exact, keep_query))


def shared_urls(locs: DataFrame) -> DataFrame:
    """url and the sorted files that hold it, for URLs in more than one file."""
    files = locs.groupBy("loc").agg(F.sort_array(F.collect_set("source_file")).alias("files"))
    return files.where(F.size("files") > 1).select(F.col("loc").alias("url"), F.array_join("files", ", ").alias("files"), F.size("files").alias("n_files"))


def clean(locs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates' survivors, the duplicates report, and the files with decision, kept URLs and an empty ones' decision.

    locs are on-domain ones of all files. A candidate that keeps no loc is dropped as empty.
    """
    chosen = select_files(files)
    mine = locs.join(chosen.where("decision = 'candidate'").select(F.col("file_idx").alias("__f")), F.col("file_idx") == F.col("__f")).drop("__f")
    # The keys are joined once, in a table that survivors and duplicates are both read from.
    keyed = _keyed(mine, False, False)
    path = scratch(locs.sparkSession, "keyed-locs")
    keyed.write.parquet(path)
    keyed = locs.sparkSession.read.schema(keyed.schema).parquet(path)
    kept = _kept(keyed, locs.columns)
    counts = kept.groupBy(F.col("file_idx").alias("__f")).agg(F.count("*").alias("url_count"))
    result = chosen.join(counts, F.col("file_idx") == F.col("__f"), "left").drop("__f").withColumn("url_count", F.coalesce("url_count", F.lit(0)))
    result = result.withColumn("decision", F.when((F.col("decision") == "candidate") & (F.col("url_count") == 0), "empty").otherwise(F.col("decision")))
    return kept, _later(keyed), result


def summary(result: DataFrame, report: DataFrame) -> DataFrame:
    """One row: files processed, kept and dropped, URLs of kept files, removed duplicates and the reduction in percent.

    Removed duplicates count those of files that end up empty too; the URLs they are held against are the survivors'.
    """
    kept = F.col("decision") == "candidate"
    facts = result.agg(
        F.count_if(F.col("decision") != "index").alias("files_processed"),
        F.count_if(kept).alias("files_kept"),
        F.count_if(F.col("decision").isin("unparsable", "wrong_domain", "empty")).alias("files_dropped"),
        F.count_if(F.col("decision") == "index").alias("index_files_detected"),
        F.coalesce(F.sum(F.when(kept, F.col("matching"))), F.lit(0)).alias("total_urls_kept_files"),
        F.coalesce(F.sum(F.when(kept, F.col("url_count"))), F.lit(0)).alias("clean_urls_remaining"),
    )
    removed = report.agg(F.count("*").alias("duplicates_removed"))
    both = facts.crossJoin(removed)
    return both.withColumn("reduction_pct", F.when(F.col("total_urls_kept_files") > 0, F.col("duplicates_removed") * 100.0 / F.col("total_urls_kept_files")).otherwise(0.0))


def _placed_within(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """The rows with their place among those of their name (__n), from 1."""
    whole = ordering.placed(rows, [F.col("__n"), *order], "__at")
    first = whole.groupBy(F.col("__n").alias("__of")).agg(F.min("__at").alias("__first"))
    joined = whole.join(first, F.col("__n").eqNullSafe(F.col("__of")))
    return joined.withColumn(name, F.col("__at") - F.col("__first") + 1).drop("__at", "__of", "__first")


def output_names(files: DataFrame) -> DataFrame:
    """The files with output_name: a repeated name gets -2, -3 ... before its ending, past names that others have.

    Rows are numbered by places in the whole order, so that a name that all files have is not one task.
    """
    stem, ending = F.regexp_replace("filename", r"(\.xml(\.gz)?)$", ""), F.regexp_extract("filename", r"(\.xml(\.gz)?)$", 1)
    part = lambda i: F.regexp_extract("filename", r"^(.*)-([0-9]+)(\.xml(?:\.gz)?)$", i)
    taken = files.select(F.concat(part(1), part(3)).alias("__n"), part(1).alias("__s"), part(2).try_cast("int").alias("__v")).where("__s <> '' AND __v >= 2").select("__n", "__v").distinct()
    numbered = _placed_within(files.select(F.col("filename").alias("__n"), F.struct(*files.columns).alias("__file")), "__v", F.col("__file.file_idx"))
    # A name's j-th taken number v, from 0, stands before its row v - j: with these among them, a row's place is the number that is free for it.
    skips = _placed_within(taken.withColumnRenamed("__v", "__k"), "__j", F.col("__k")).select("__n", (F.col("__k") - F.col("__j") + 1).alias("__v"), F.lit(None).cast(numbered.schema["__file"].dataType).alias("__file"))
    free = _placed_within(numbered.select("__n", "__v", "__file").unionByName(skips), "__free", F.col("__v"), F.col("__file").isNotNull())
    made = free.where("__file IS NOT NULL").select("__file.*", "__v", F.col("__free").cast("string").alias("__free"))
    return made.select(*files.columns, F.when(F.col("__v") == 1, F.col("filename")).otherwise(F.concat(stem, F.lit("-"), "__free", ending)).alias("output_name"))


def latest_batches(attempts: DataFrame) -> DataFrame:
    """Of each run and batch the rows of the latest attempt."""
    last = attempts.groupBy("run_id", "batch").agg(F.max("attempt").alias("attempt"))
    return attempts.join(last, ["run_id", "batch", "attempt"])


def missing_batches(attempts: DataFrame, expected: DataFrame) -> DataFrame:
    """run_id, batch of the batches 0 to total_batches - 1 that have not come."""
    wanted = expected.where("total_batches > 0").select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_batches").cast("long") - 1)).alias("batch"))
    return wanted.join(attempts.select("run_id", F.col("batch").cast("long").alias("batch")), ["run_id", "batch"], "left_anti")
