"""Queries over files: pages are written as sitemaps, indexes, lists and tables to the shared folder and read back by the readers."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..operators import mismatches
from ..shipping import scratch
from ..sources import datasource, in_place, readers, writers
from .inventory import LOCS, page_locs, read

QUERIES: dict = {}
SQL: dict = {}
DAY = "2024-02-03"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


PLACED = f"{LOCS}, placed AS (SELECT source_file || '.xml' AS source_file, file_idx, row_number() OVER (PARTITION BY file_idx ORDER BY loc_idx) - 1 AS loc_idx, loc FROM locs)"


def _sitemaps(spark, d, packed=False, spoil=None):
    """The folder of the pages' sitemaps, one file a source_file; spoil changes the documents before they are written."""
    locs = page_locs(spark, d).withColumn("source_file", F.concat("source_file", F.lit(".xml")))
    documents = writers.sitemap_documents(locs, F.lit(DAY).cast("date"))
    path = scratch(spark, "sitemaps")
    writers.write_documents(spoil(documents) if spoil else documents, path, packed)
    return path


def _index(spark, d):
    files = page_locs(spark, d).select("file_idx", F.concat("source_file", F.lit(".xml")).alias("source_file")).distinct()
    return writers.index_document(files, "https://example.com", "maps", F.lit(DAY).cast("date")).select(F.lit("index.xml").alias("source_file"), "xml")


@query(f"WITH {PLACED} SELECT dense_rank() OVER (ORDER BY source_file) - 1 AS file_idx, source_file, loc_idx, loc FROM placed")
def file_urlset_scan(spark, d):
    scanned = readers.scan_files(spark, _sitemaps(spark, d), readers.WRITTEN_NAMES)
    return readers.ordered_locs(scanned).withColumn("loc_idx", F.col("loc_idx").cast("long"))


@query(f"WITH {PLACED} SELECT source_file, loc_idx, loc FROM placed")
def file_gzip_scan(spark, d):
    scanned = readers.scan_files(spark, _sitemaps(spark, d, packed=True), readers.WRITTEN_NAMES)
    return readers.ordered_locs(scanned).select("source_file", F.col("loc_idx").cast("long").alias("loc_idx"), "loc")


@query(f"WITH {PLACED} SELECT source_file, loc, '{DAY}' AS lastmod FROM placed")
def file_xml_rows(spark, d):
    return readers.read_sitemap_rows(spark, f"{_sitemaps(spark, d)}/*/part-*").select("source_file", "loc", "lastmod")


@query(f"""WITH {PLACED} SELECT source_file, 'urlset' AS root, file_idx % 3 <> 1 AS is_valid, FALSE AS is_index, FALSE AS is_empty, count(*) AS total_urls, file_idx % 3 = 2 AS had_preamble
    FROM placed GROUP BY source_file, file_idx""")
def file_facts(spark, d):
    """Of files that are whole, cut off before their end, or have junk in front, in turn: what was complete counts."""
    kind = F.substring("source_file", 2, 1).cast("int") % 3
    cut = F.when(kind == 1, F.expr("substring(xml, 1, length(xml) - 12)")).when(kind == 2, F.concat(F.lit("Warning: junk\n"), "xml")).otherwise(F.col("xml"))
    facts = readers.file_facts(readers.scan_files(spark, _sitemaps(spark, d, spoil=lambda x: x.withColumn("xml", cut)), readers.WRITTEN_NAMES))
    return facts.select("source_file", "root", "is_valid", "is_index", "is_empty", "total_urls", "had_preamble")


@query(f"WITH {PLACED} SELECT DISTINCT 'index.xml' AS source_file, 'https://example.com/maps/' || source_file AS child, CAST(dense_rank() OVER (ORDER BY file_idx) - 1 AS INTEGER) AS position FROM placed")
def file_index_children(spark, d):
    path = scratch(spark, "index")
    writers.write_documents(_index(spark, d), path)
    return readers.index_children(readers.scan_files(spark, path, readers.WRITTEN_NAMES))


@query(f"WITH {PLACED} SELECT source_file, loc FROM placed UNION ALL SELECT DISTINCT 'index.xml', 'https://example.com/maps/' || source_file FROM placed")
def file_scan_with_index(spark, d):
    scanned = readers.scan_files(spark, _sitemaps(spark, d), readers.WRITTEN_NAMES)
    path = scratch(spark, "index")
    writers.write_documents(_index(spark, d), path)
    both = scanned.unionByName(readers.scan_files(spark, path, readers.WRITTEN_NAMES))
    return readers.ordered_locs(both, include_index=True).select("source_file", "loc")


@query(f"WITH {PLACED} SELECT loc, 1 AS level FROM placed GROUP BY loc ORDER BY loc LIMIT 100000")
def file_tree(spark, d):
    scanned = readers.scan_files(spark, _sitemaps(spark, d), readers.WRITTEN_NAMES)
    path = scratch(spark, "index")
    writers.write_documents(_index(spark, d), path)
    return readers.tree_locs(scanned.unionByName(readers.scan_files(spark, path, readers.WRITTEN_NAMES)), "index.xml")


@query("SELECT url AS sitemap FROM pages WHERE page_id % 4 <> 3")
def file_robots(spark, d):
    line = F.when(F.col("page_id") % 4 == 3, F.concat(F.lit("Disallow: "), "url")).when(F.col("page_id") % 2 == 0, F.concat(F.lit("Sitemap: "), "url")).otherwise(F.concat(F.lit("  SITEMAP:"), "url"))
    path = scratch(spark, "robots")
    read(spark, d, "pages").select(line.alias("value")).write.text(path)
    return readers.robots_sitemaps(spark.read.text(path))


@query("""SELECT 'https://h' || page_id AS site, 'https://h' || page_id || '/own.xml' AS sitemap, TRUE AS from_robots FROM pages WHERE page_id % 2 = 0
    UNION ALL SELECT 'https://h' || page_id, 'https://h' || page_id || unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/sitemap/sitemap.xml', '/sitemaps/sitemap.xml', '/sitemap/index.xml', '/wp-sitemap.xml', '/news-sitemap.xml', '/product-sitemap.xml', '/page-sitemap.xml']), FALSE FROM pages WHERE page_id % 2 = 1""")
def sitemaps_to_try(spark, d):
    sites = read(spark, d, "pages").select("page_id", F.concat(F.lit("https://h"), F.col("page_id").cast("string")).alias("site"))
    return readers.sitemaps_to_try(sites, sites.where("page_id % 2 = 0").select("site", F.concat("site", F.lit("/own.xml")).alias("sitemap")))


@query("SELECT url FROM pages WHERE page_id % 3 <> 0")
def file_url_list(spark, d):
    line = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("# "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit(" ")))
    path = scratch(spark, "list")
    read(spark, d, "pages").select(F.concat(line, F.lit("\n")).alias("value")).write.text(path)
    return readers.list_lines(spark.read.text(path))


@query("SELECT url, CAST(page_id AS VARCHAR) AS n FROM pages WHERE page_id % 5 <> 0")
def file_csv_urls(spark, d):
    path = scratch(spark, "csv")
    rows = read(spark, d, "pages").select(F.when(F.col("page_id") % 5 != 0, F.col("url")).alias(" URL "), F.col("page_id").alias("N"))
    writers.write_csv(rows, path, 50)
    return readers.csv_urls(spark, path)


@query("SELECT url, CAST(page_id % 100 AS DOUBLE) AS da, CAST(page_id % 7 AS DOUBLE) AS spam_score FROM pages")
def file_tsv_sites(spark, d):
    i = F.col("page_id")
    path = scratch(spark, "tsv")
    read(spark, d, "pages").select(F.concat_ws("\t", "url", F.concat(F.lit("DA "), (i % 100).cast("string")), F.concat((i % 7).cast("string"), F.lit("%"))).alias("value")).write.text(path)
    return readers.tsv_sites(spark.read.text(path))


@query(f"WITH {LOCS} SELECT source_file, row_number() OVER (PARTITION BY file_idx ORDER BY loc_idx) - 1 AS loc_idx, loc, file_idx FROM locs")
def file_json_batches(spark, d):
    """Batches of {name, urls}: one JSON array a file, each entry a sitemap of its own."""
    entry = page_locs(spark, d).groupBy("file_idx", F.col("source_file").alias("name")).agg(F.transform(F.sort_array(F.collect_list(F.struct("loc_idx", "loc"))), lambda x: x["loc"]).alias("urls"))
    path = scratch(spark, "json")
    lines = entry.select(F.concat(F.lit("["), F.to_json(F.struct("name", "urls")), F.lit("]")).alias("value"), F.concat(F.lit("b"), F.col("file_idx").cast("string")).alias("batch"))
    lines.write.partitionBy("batch").text(path)
    read_back = readers.json_batches(spark, f"{path}/*")
    return read_back.select("source_file", F.col("loc_idx").cast("long").alias("loc_idx"), "loc", "file_idx")


@query("SELECT 'https://e.com/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'indexed' ELSE 'unknown' END AS status FROM pages WHERE page_id % 6 <> 0")
def file_result_csv(spark, d):
    i = F.col("page_id")
    status = F.when(i % 6 == 0, "").when(i % 2 == 0, '"indexed"').otherwise("unknown")
    path = scratch(spark, "results")
    rows = read(spark, d, "pages").select(F.concat_ws(",", F.concat(F.lit("https://e.com/"), i.cast("string")), status, F.lit("x")).alias("value"))
    rows.unionByName(spark.range(1).select(F.lit("URL,Status,More").alias("value"))).write.text(path)
    return readers.result_csv(spark, path)


@query(f"WITH {PLACED} SELECT source_file, loc, '2024-05-06' AS lastmod FROM placed")
def file_lastmod_rewrite(spark, d):
    entries = file_xml_rows(spark, d)
    return writers.with_lastmod(entries.drop("lastmod"), F.lit("2024-05-06").cast("date"))


BYTES_HEAD = '<?xml version="1.0"?>\n<urlset>\n<!-- kept as it is -->\n'


def _entry_sql(loc: str) -> str:
    return f"""'  <url>' || chr(10) || '    <loc>' || replace(replace(replace({loc}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc>' || chr(10)
      || '    <lastmod>2024-02-0' || (loc_idx % 9 + 1) || '</lastmod><priority>0.' || (loc_idx % 10) || '</priority>' || chr(10) || '  </url>' || chr(10)"""


@query(f"""WITH {PLACED}, made AS (SELECT *, loc_idx % 5 = 3 AS gone, CASE WHEN contains(loc, 'example') THEN replace(loc, 'example', 'sample') ELSE loc END AS new FROM placed)
    SELECT source_file, sha256('{BYTES_HEAD.replace(chr(10), "' || chr(10) || '")}' || coalesce(string_agg(CASE WHEN NOT gone THEN {_entry_sql("new")} END, '' ORDER BY loc_idx), '') || '</urlset>' || chr(10)) AS digest,
      count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS removed, count(*) FILTER (NOT gone AND new <> loc) AS rewritten FROM made GROUP BY source_file""")
def file_rewrite_bytes(spark, d):
    """Files with dates, priorities and a comment: hosts are replaced and each fifth block goes, all other bytes stay."""
    path = _rich_files(spark, d)
    found = in_place.byte_locs(spark, path, readers.WRITTEN_NAMES)
    new = F.when(rules.has(F.col("loc"), "example", False), rules.find_replace(F.col("loc"), "example", "sample", False))
    return _told(in_place.rewrite_files(spark, path, in_place.edits_of(found, new, F.col("position") % 5 == 3), readers.WRITTEN_NAMES))


def _rich_files(spark, d):
    """The folder of the pages' sitemaps with dates, priorities and a comment."""
    locs = page_locs(spark, d).withColumn("source_file", F.concat("source_file", F.lit(".xml")))
    # The place in the file, and not among all locs.
    ranked = locs.withColumn("loc_idx", F.row_number().over(Window.partitionBy("source_file").orderBy("loc_idx")) - 1)
    i = F.col("loc_idx")
    plain = F.replace(F.replace(F.replace("loc", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("  <url>\n    <loc>"), plain, F.lit("</loc>\n    <lastmod>2024-02-0"), (i % 9 + 1).cast("string"), F.lit("</lastmod><priority>0."), (i % 10).cast("string"), F.lit("</priority>\n  </url>\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("loc_idx", entry.alias("xml")))), lambda e: e["xml"]), "")
    path = scratch(spark, "bytes")
    writers.write_documents(ranked.groupBy("source_file").agg(F.concat(F.lit(BYTES_HEAD), body, F.lit("</urlset>")).alias("xml")), path)
    return path


def _told(files):
    return files.select(F.url_decode(F.regexp_extract("path", "/source_file=([^/]+)/", 1)).alias("source_file"), F.sha2("content", 256).alias("digest"), "kept", "removed", "rewritten")


MINE = "regexp_matches(lower(loc), '^https?://([^/?#]*\\.)?example\\.net(:[0-9]*)?([/?#]|$)')"


@query(f"""WITH {PLACED}, made AS (SELECT *, regexp_matches(lower(loc), '^https?://') AND NOT {MINE} AS gone FROM placed)
    SELECT source_file, sha256('{BYTES_HEAD.replace(chr(10), "' || chr(10) || '")}' || coalesce(string_agg(CASE WHEN NOT gone THEN {_entry_sql("loc")} END, '' ORDER BY loc_idx), '') || '</urlset>' || chr(10)) AS digest,
      count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS removed, CAST(0 AS BIGINT) AS rewritten FROM made GROUP BY source_file""")
def file_domain_stripped(spark, d):
    """The files as they are downloaded without other hosts: their blocks go, what has no host stays, and so do all other bytes."""
    path = _rich_files(spark, d)
    found = in_place.byte_locs(spark, path, readers.WRITTEN_NAMES)
    other = ~mismatches.on_domain(F.col("loc"), F.lit("example.net"), True)
    return _told(in_place.rewrite_files(spark, path, in_place.edits_of(found, F.lit(None).cast("string"), other), readers.WRITTEN_NAMES))


@query(f"""WITH {PLACED} SELECT replace(source_file, '.xml', CASE WHEN loc_idx >= 3 THEN '-' || (loc_idx // 3 + 1) ELSE '' END || '.xml') AS source_file, 'urlset' AS root, loc_idx % 3 AS position, loc, CASE WHEN loc_idx % 2 = 0 THEN '2024-02-03' END AS lastmod FROM placed""")
def file_sitemap_source(spark, d):
    """Written and read as a data source, three locs a document."""
    locs = page_locs(spark, d).withColumn("source_file", F.concat("source_file", F.lit(".xml")))
    position = F.row_number().over(Window.partitionBy("source_file").orderBy("loc_idx")) - 1
    path = scratch(spark, "source")
    datasource.write_sitemaps(locs.select("source_file", position.alias("position"), "loc", F.when(position % 2 == 0, "2024-02-03").alias("lastmod")), path, most=3)
    return spark.read.format("sitemap").load(path).select("source_file", "root", "position", "loc", "lastmod")


@query("SELECT page_id, page_id % 5 IN (0, 1) AS in_session, page_id % 5 IN (0, 1, 2, 3) AS in_cleaner FROM pages")
def upload_filter(spark, d):
    """Which uploads count by their names: a session takes XML files, the cleaner packed ones too."""
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.element_at(F.array(*[F.lit(e) for e in (".xml", ".XML", ".xml.gz", ".Xml.GZ", ".xml.txt")]), (F.col("page_id") % 5 + 1).cast("int")))
    return read(spark, d, "pages").select("page_id", name.rlike(readers.SESSION_NAMES).alias("in_session"), name.rlike(readers.SITEMAP_NAMES).alias("in_cleaner"))


@query(f"WITH {PLACED} SELECT source_file, loc FROM placed")
def file_any_namespace(spark, d):
    """Locs of documents whose elements have prefixes, as they are read by their local names."""
    spoil = lambda x: x.withColumn("xml", F.regexp_replace("xml", r"<(/?)(urlset|url|loc|lastmod)", "<$1sm:$2"))
    return readers.ordered_locs(readers.scan_files(spark, _sitemaps(spark, d, spoil=spoil), readers.WRITTEN_NAMES)).select("source_file", "loc")


@query(f"WITH {PLACED} SELECT source_file, loc_idx, loc FROM placed WHERE file_idx % 3 <> 2")
def file_zip_entries(spark, d):
    """Of ZIP files with a sitemap in a folder, a hidden twin and a note beside it; every third is cut off and gives its error alone."""

    def pack(batches):
        for batch in batches:
            paths, contents = [], []
            for name, part, xml in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
                    for place, text in ((f"maps/{name}", xml), (f"__MACOSX/maps/._{name}", xml), ("maps/note.txt", "no sitemap")):
                        out.writestr(place, text)
                cut = int(name[1:-4]) % 3 == 2
                paths.append(f"{part}-{name}.zip")
                contents.append(held.getvalue()[:-30] if cut else held.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    locs = page_locs(spark, d).withColumn("source_file", F.concat("source_file", F.lit(".xml")))
    documents = writers.sitemap_documents(locs, F.lit(DAY).cast("date"))
    packed = documents.select("source_file", "part", "xml").mapInArrow(pack, "path string, content binary")
    return readers.ordered_locs(readers.entries_of(packed)).select("source_file", F.col("loc_idx").cast("long").alias("loc_idx"), "loc")
