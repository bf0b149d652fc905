"""The whole cleaning of a folder of sitemaps: scan, select, deduplicate, write sitemaps, index, report and summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import passing, scratch
from ..sources import readers, writers
from . import cleaning, mismatches


def numbered_files(scanned: DataFrame, domain: str) -> DataFrame:
    """path, file_idx, filename, is_valid, root_element, total, matching of all scanned files, those without locs too.

    Totals are those of each file's own row, so that no loc moves for them.
    """
    is_set = F.col("root") == "urlset"
    matching = F.size(F.filter("locs", lambda loc: mismatches.on_domain(loc, F.lit(domain))))
    count = lambda n: F.when(is_set, n).otherwise(0).cast("long")
    facts = scanned.select("path", F.col("source_file").alias("filename"), "is_valid", F.col("root").alias("root_element"), count(F.size("locs")).alias("total"), count(matching).alias("matching"))
    return facts.join(readers.file_numbers(scanned), "path")


def clean_folder(spark: SparkSession, source: str, out: str, domain: str, folder: str = "sitemaps", lastmod: Column | None = None, names: str = readers.SITEMAP_NAMES) -> DataFrame:
    """Clean the sitemaps below source for a domain; returns the summary's row.

    Below out come sitemaps/source_file=NAME/ (one document a kept file, a part for each 50,000 places),
    index/, report/ (every duplicate: url, kept_in, duplicate_in, in order), files/ (each file's decision
    and counts, as CSV) and summary/ (JSON). Each file is parsed once, into a table in the shared folder, which
    is deleted with the others of the job at its end.
    """
    with passing(spark):
        parsed = scratch(spark, "scanned-files")
        scanned = readers.scan_files(spark, source, names)
        scanned.write.parquet(parsed)
        scanned = spark.read.schema(scanned.schema).parquet(parsed)
        files = scratch(spark, "numbered-files")
        cleaning.output_names(numbered_files(scanned, domain)).write.parquet(files)
        listed = spark.read.parquet(files)
        # Files meet their numbers and names before their locs are spread out.
        numbers = listed.select(F.col("path").alias("of"), "file_idx", F.col("output_name").alias("source_file"))
        named = scanned.where("root = 'urlset'").select("path", "locs").join(numbers, F.col("path") == F.col("of"))
        locs = named.select("file_idx", "source_file", F.posexplode("locs").alias("loc_idx", "loc"))
        kept, report, result = cleaning.clean(mismatches.on_domain_locs(locs, domain), listed.drop("path"))
        writers.write_documents(writers.sitemap_documents(kept, lastmod), f"{out}/sitemaps")
        index = result.where("decision = 'candidate'").select("file_idx", F.col("output_name").alias("source_file"))
        writers.index_document(index, f"https://{domain}", folder, lastmod).select(F.rtrim("xml").alias("value")).write.text(f"{out}/index")
        writers.write_csv(report.orderBy("file_idx", "loc_idx"), f"{out}/report")
        writers.write_csv(result, f"{out}/files")
        summary = cleaning.summary(result, report)
        summary.write.json(f"{out}/summary")
    return spark.read.schema(summary.schema).json(f"{out}/summary")
