"""Writers: sitemap and index XML, reports as CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

URLSET_OPEN = '<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
INDEX_OPEN = '<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n'
#: Locs that one sitemap file may have, and so the most that are gathered into one row.
FILE_LOCS = 50_000


def url_entry(loc: Column, lastmod: Column) -> Column:
    return F.concat(F.lit("  <url>\n    <loc>"), rules.xml_escape(loc), F.lit("</loc>\n    <lastmod>"), F.date_format(lastmod, "yyyy-MM-dd"), F.lit("</lastmod>\n  </url>\n"))


def sitemap_documents(locs: DataFrame, lastmod: Column | None = None, most: int = FILE_LOCS) -> DataFrame:
    """source_file, part, xml: whole documents in the order of loc_idx, in parts of so many positions at most."""
    day = F.current_date() if lastmod is None else lastmod
    rows = locs.select("source_file", F.floor(F.col("loc_idx") / most).alias("part"), F.struct("loc_idx", url_entry(F.col("loc"), day).alias("xml")).alias("e"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["xml"]), "")
    return rows.groupBy("source_file", "part").agg(F.concat(F.lit(URLSET_OPEN), body, F.lit("</urlset>\n")).alias("xml"))


def index_document(files: DataFrame, domain: str, folder: str = "", lastmod: Column | None = None) -> DataFrame:
    """part, xml: the index of files (file_idx, source_file) below a domain and a folder, 50,000 files an index."""
    base = domain.rstrip("/") + "/" + (folder.strip("/") + "/" if folder.strip("/") else "")
    day = F.date_format(F.current_date() if lastmod is None else lastmod, "yyyy-MM-dd")
    entry = F.concat(F.lit(f"  <sitemap>\n    <loc>{base}"), rules.xml_escape(F.col("source_file")), F.lit("</loc>\n    <lastmod>"), day, F.lit("</lastmod>\n  </sitemap>\n"))
    listed = F.sort_array(F.collect_list(F.struct("file_idx", entry.alias("xml"))))
    # An index has 50,000 files at most, by the format; further ones go to further indexes.
    parts = files.groupBy(F.floor(F.col("file_idx") / FILE_LOCS).alias("part")).agg(F.array_join(F.transform(listed, lambda e: e["xml"]), "").alias("body"))
    return parts.select("part", F.concat(F.lit(INDEX_OPEN), "body", F.lit("</sitemapindex>\n")).alias("xml"))


def index_folder(xml: Column) -> Column:
    """The folder of the first loc of an index, /sitemaps/ without one."""
    path = F.regexp_extract(xml, r"(?s)<loc>\s*https?://[^/<]*((?:/[^/<]*)*/)[^/<]*</loc>", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.lit("/sitemaps/"))


def write_documents(documents: DataFrame, path: str, packed: bool = False) -> None:
    """Each document as text in a file of its own below a folder of its source file's name, in the order of parts."""
    # Many small files: their writing is dealt to all tasks, however little text it is. Parts of one file stay together for their order.
    tasks = documents.sparkSession.sparkContext.defaultParallelism
    part = F.col("part") if "part" in documents.columns else F.lit(0).alias("part")
    rows = documents.select("source_file", F.rtrim("xml").alias("value"), part).repartition(tasks, "source_file").sortWithinPartitions("source_file", "part")
    texts = rows.select("source_file", "value").write.partitionBy("source_file").option("maxRecordsPerFile", 1)
    texts.option("compression", "gzip" if packed else "none").option("lineSep", "\n").text(path)


def with_lastmod(entries: DataFrame, day: Column | None = None) -> DataFrame:
    """The entries (loc, lastmod ...) of a sitemap or an index with lastmod set to a day, today if none is given, whether they had one or not."""
    return entries.withColumn("lastmod", F.date_format(F.current_date() if day is None else day, "yyyy-MM-dd"))


def write_csv(rows: DataFrame, path: str, most: int | None = None) -> None:
    """Rows as CSV with quotes doubled, in files of so many records at most."""
    writer = rows.write.option("header", "true").option("quote", '"').option("escape", '"')
    (writer.option("maxRecordsPerFile", most) if most else writer).csv(path)
