"""Readers: sitemap files in order, robots files, URL lists, HTML links, JSON batches, CSV and TSV with odd headers."""

from __future__ import annotations

import gzip
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from typing import IO
from urllib.parse import unquote
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..operators.ordering import placed
from ..shipping import ship

SITEMAP_NAMES = r"(?i)\.xml(\.gz)?$"
SESSION_NAMES = r"(?i)\.xml$"
#: Files that writers.write_documents has written.
WRITTEN_NAMES = r"/source_file=[^/]+/part-[^/]*$"
PEEK = 2048
PREAMBLE_PEEK = 500

SCAN = "path string, source_file string, root string, is_valid boolean, had_preamble boolean, error string, error_offset long, locs array<string>"


def strip_preamble(content: bytes) -> tuple[bytes, bool]:
    """The document from its first tag on, if junk of under 500 bytes stands before it."""
    start = content.lstrip(b"\xef\xbb\xbf \t\r\n")
    if start.startswith((b"<?xml", b"<urlset", b"<sitemapindex")):
        return start, False
    at = content[:PREAMBLE_PEEK].find(b"<")
    return (content[at:], True) if at > 0 else (start, False)


def _pieces(content: bytes | IO[bytes], size: int = 1 << 20) -> Iterator[bytes]:
    """The document in pieces; a gzipped one is unpacked piece by piece."""
    source = io.BytesIO(content) if isinstance(content, bytes) else content
    packed = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    stream = gzip.GzipFile(fileobj=source) if packed else source
    while piece := stream.read(size):
        yield piece


def scan_xml(content: bytes | IO[bytes]) -> dict:
    """Root, validity, error with its place, and the locs that were complete before any error, in document order.

    Names count without prefixes and case, so loc elements of any namespace are locs. Text and CDATA
    are taken, trimmed; empty ones are left out. Of a broken gzip file or ZIP entry, what came before the break counts.
    """
    locs: list[str] = []
    state: dict = {"root": None, "text": None}

    def start(name: str, _: dict) -> None:
        local = name.rpartition(":")[2].lower()
        if state["root"] is None:
            state["root"] = local
        state["text"] = [] if local == "loc" else None

    def end(name: str) -> None:
        if name.rpartition(":")[2].lower() == "loc" and state["text"] is not None:
            value = "".join(state["text"]).strip()
            if value:
                locs.append(value)
        state["text"] = None

    def said(data: str) -> None:
        if state["text"] is not None:
            state["text"].append(data)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, said
    error, place, had, first = None, None, False, True
    try:
        for piece in _pieces(content):
            if first:
                piece, had = strip_preamble(piece)
                first = False
            parser.Parse(piece, False)
        parser.Parse(b"", True)
    except expat.ExpatError as failed:
        error, place = str(failed), parser.ErrorByteIndex
    except (OSError, EOFError, zlib.error, zipfile.BadZipFile) as failed:
        error, place = str(failed), 0
    root = state["root"]
    known = root in ("urlset", "sitemapindex")
    return {"root": root, "is_valid": error is None and known, "had_preamble": had, "error": error or (None if known else "unknown root"), "error_offset": place, "locs": locs}


def _scanned(path: str, content: bytes | IO[bytes]) -> dict:
    """A file's row; one that writers.write_documents has written goes by the name of its folder."""
    folder = re.search(r"/source_file=([^/]+)/part-[^/]*$", path)
    return {"path": path, "source_file": unquote(folder[1]) if folder else path.rpartition("/")[2], **scan_xml(content)}


_SCAN = pa.schema([("path", pa.string()), ("source_file", pa.string()), ("root", pa.string()), ("is_valid", pa.bool_()), ("had_preamble", pa.bool_()), ("error", pa.string()), ("error_offset", pa.int64()), ("locs", pa.list_(pa.string()))])
#: Locs that are gathered into one batch at most, besides those of its last file.
BATCH_LOCS = 100_000


def _batches_of(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Files' rows in batches of many small files, or of one large one."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row["locs"]) + 1
        if n >= BATCH_LOCS:
            yield pa.RecordBatch.from_pylist(held, schema=_SCAN)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_SCAN)


def scan_files(spark: SparkSession, path: str, names: str = SITEMAP_NAMES) -> DataFrame:
    """One row per sitemap file below a path: see SCAN. A file is one row of one task, as its order needs.

    names says which base names count; SESSION_NAMES leaves packed files out. Only files with such
    names are opened. Where files are too large for a row there is datasource, which yields a row a loc.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches_of(_scanned(p.as_py(), c.as_py()) for batch in batches for p, c in zip(batch.column(0), batch.column(1), strict=True))

    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").rlike(names)).select("path", "content").mapInArrow(run, SCAN)


def _entries(path: str, content: bytes) -> Iterator[dict]:
    """The rows of a ZIP file's sitemaps, each unpacked piece by piece; one with the error alone where the ZIP file cannot be opened."""
    broken = {"path": path, "source_file": path.rpartition("/")[2], "root": None, "is_valid": False, "had_preamble": False, "error_offset": 0, "locs": []}
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as packed:
            for entry in packed.infolist():
                hidden = any(part.startswith((".", "__MACOSX")) for part in entry.filename.split("/"))
                if entry.is_dir() or hidden or not re.search(SITEMAP_NAMES, entry.filename):
                    continue
                place = f"{path}!/{entry.filename}"
                try:
                    with packed.open(entry) as stream:
                        yield _scanned(place, stream)
                except (RuntimeError, NotImplementedError, zipfile.BadZipFile) as failed:  # with a password, by an unknown method, or without its header
                    yield {**broken, "path": place, "source_file": entry.filename.rpartition("/")[2], "error": str(failed)}
    except zipfile.BadZipFile as failed:
        yield {**broken, "error": str(failed)}


def entries_of(files: DataFrame) -> DataFrame:
    """As scan_files, of the sitemaps in ZIP files (path, content): entries by base name, without hidden ones.

    path is that of the ZIP file with the entry's behind it. Entries are unpacked in pieces, so that a task holds
    the packed file and one entry's locs. A ZIP file or an entry that cannot be opened is a row with its error;
    a null content gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches_of(
            row for batch in batches for p, c in zip(batch.column(0), batch.column(1), strict=True) if c.is_valid for row in _entries(p.as_py() or "", c.as_py())
        )

    ship(files.sparkSession)
    return files.select("path", "content").mapInArrow(run, SCAN)


def zip_entries(spark: SparkSession, path: str) -> DataFrame:
    """entries_of the ZIP files below a path."""
    return entries_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[zZ][iI][pP]").load(path))


def file_facts(scanned: DataFrame) -> DataFrame:
    """source_file, root, is_valid, is_index, is_empty, total_urls and the error, from scanned files."""
    return scanned.select(
        "path", "source_file", "root", "is_valid", (F.col("root") == "sitemapindex").alias("is_index"), (F.size("locs") == 0).alias("is_empty"), F.size("locs").cast("long").alias("total_urls"), "had_preamble", "error", "error_offset",
    )


def file_numbers(scanned: DataFrame) -> DataFrame:
    """path, file_idx: files numbered from 0 in the order of their names, then paths; two files of one name are two files."""
    files = scanned.select("path", "source_file")
    return placed(files, [F.col("source_file"), F.col("path")], "file_idx", 0).select("path", "file_idx")


def ordered_locs(scanned: DataFrame, root: str = "urlset", include_index: bool = False) -> DataFrame:
    """file_idx, source_file, loc_idx, loc of the files with this root (and of index files, if asked); see file_numbers."""
    roots = [root, "sitemapindex"] if include_index else [root]
    mine = scanned.where(F.col("root").isin(*roots))
    numbers = file_numbers(scanned).withColumnRenamed("path", "__path")
    spread = mine.select("path", "source_file", F.posexplode("locs").alias("loc_idx", "loc"))
    return spread.join(numbers, F.col("path") == F.col("__path")).select("file_idx", "source_file", "loc_idx", "loc")


def index_children(scanned: DataFrame) -> DataFrame:
    """source_file, child, position of the children of index files, each child once, where it first stands."""
    children = scanned.where("root = 'sitemapindex'").select("source_file", F.posexplode("locs").alias("position", "child"))
    return children.groupBy("source_file", "child").agg(F.min("position").alias("position"))


def tree_locs(scanned: DataFrame, root_file: str, depth: int = 4, most: int = 100_000) -> DataFrame:
    """loc, level of the pages below an index file: indexes are followed by their children's base names, down to a depth.

    At most so many pages are returned, the nearest ones first, then by name: the bound is the operator's own. This is for files
    that are known by base names only; where their URLs are known, walks.pages_below keeps equal names of two folders apart.
    """
    named = scanned.select("source_file", "root", "locs")
    level = named.where(F.col("source_file") == root_file).select("source_file")
    pages: DataFrame | None = None
    for k in range(depth + 1):
        here = named.join(level.distinct(), "source_file")
        found = here.where("root = 'urlset'").select(F.explode("locs").alias("loc"), F.lit(k).alias("level"))
        pages = found if pages is None else pages.unionByName(found)
        children = here.where("root = 'sitemapindex'").select(F.explode("locs").alias("child"))
        level = children.select(F.element_at(F.split("child", "/"), -1).alias("source_file"))
    return pages.groupBy("loc").agg(F.min("level").alias("level")).orderBy("level", "loc").limit(most)


def child_kind(url: Column) -> Column:
    """How a child of an index is read: xml, list (text), or xml at first try for other endings."""
    path = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    return F.when(path.rlike(r"\.xml(\.gz)?$"), "xml").when(path.endswith(".txt"), "list").otherwise("try_xml")


def read_sitemap_rows(spark: SparkSession, path: str, row_tag: str = "url") -> DataFrame:
    """loc, lastmod and source_file by Spark's own XML reader, where order within files does not matter."""
    rows = spark.read.format("xml").option("rowTag", row_tag).schema("loc string, lastmod string").load(path)
    folder = F.regexp_extract("_metadata.file_path", r"/source_file=([^/]+)/part-[^/]*$", 1)
    name = F.when(folder != "", F.url_decode(folder)).otherwise(F.col("_metadata.file_name"))
    return rows.select(F.trim("loc").alias("loc"), "lastmod", name.alias("source_file")).where("loc <> ''")


def peek_root(content: Column) -> Column:
    """The local name of the root element, from the first 2 KB."""
    head = F.substring(content, 1, PEEK).cast("string")
    return F.nullif(F.lower(F.regexp_extract(head, r"(?s)<(?:[A-Za-z_][\w.-]*:)?([A-Za-z_][\w.-]*)(?=[\s/>])", 1)), F.lit(""))


def is_tag_soup(text: Column) -> Column:
    """Whether a text is an HTML page rather than XML."""
    return F.lower(F.ltrim(text)).rlike(r"^<(!doctype|html)")


def robots_sitemaps(lines: DataFrame, line: str = "value") -> DataFrame:
    """sitemap: what the Sitemap directives of robots files name."""
    return lines.where(F.lower(F.ltrim(F.col(line))).startswith("sitemap:")).select(F.trim(F.substring(F.ltrim(F.col(line)), 9, 1 << 20)).alias("sitemap")).where("sitemap <> ''")


# Where a sitemap is looked for when no robots file names one.
FALLBACK_PATHS = (
    "/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap/sitemap.xml", "/sitemaps/sitemap.xml", "/sitemap/index.xml", "/wp-sitemap.xml", "/news-sitemap.xml",
    "/product-sitemap.xml", "/page-sitemap.xml",
)


def sitemaps_to_try(sites: DataFrame, directives: DataFrame) -> DataFrame:
    """site, sitemap, from_robots: what a site's robots file names, or the usual places where it names none.

    sites has site (scheme and host), directives site and sitemap.
    """
    named = directives.select("site", "sitemap").distinct().withColumn("from_robots", F.lit(True))
    places = F.explode(F.array(*[F.lit(p) for p in FALLBACK_PATHS]))
    other = sites.select("site").distinct().join(named.select("site"), "site", "left_anti").select("site", places.alias("place"))
    return named.unionByName(other.select("site", F.concat(F.regexp_replace("site", "/+$", ""), "place").alias("sitemap"), F.lit(False).alias("from_robots")))


def list_lines(texts: DataFrame, text: str = "value") -> DataFrame:
    """url: the lines of lists, trimmed, without empty ones and comments."""
    lines = texts.select(F.explode(F.transform(F.split(F.col(text), r"\r?\n"), lambda x: F.trim(x))).alias("url"))
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#"))


def all_urls(texts: DataFrame, text: str = "value") -> DataFrame:
    """url: every different http(s) URL in the texts."""
    return texts.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"https?://[^\s<>\"]+"), F.lit(0))).alias("url")).distinct()


def html_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """The pages' columns but html, with position and href of each link, entities decoded."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\b[^>]*?\bhref\s*=\s*\"([^\"]*)\""), F.lit(1))
    kept = [c for c in pages.columns if c != html]
    return pages.select(*kept, F.posexplode(found).alias("position", "href")).withColumn("href", rules.xml_unescape(F.col("href")))


def json_batches(spark: SparkSession, path: str) -> DataFrame:
    """file_idx, source_file, loc_idx, loc of JSON arrays of {name, urls}: files by path, and entries as they stand in each."""
    texts = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), "value")
    entries = texts.select("path", F.posexplode(F.from_json("value", "array<struct<name:string,urls:array<string>>>")).alias("entry", "e"))
    counts = entries.select("path", "entry", F.col("e.name").alias("source_file"), F.col("e.urls").alias("urls"))
    numbered = placed(counts, [F.col("path"), F.col("entry")], "file_idx", 0)
    return numbered.select("file_idx", "source_file", F.posexplode("urls").alias("loc_idx", "loc"))


def result_csv(spark: SparkSession, path: str) -> DataFrame:
    """url, status of a results CSV: the first two cells of each line but the header, without lines that lack either."""
    lines = spark.read.text(path).select(F.split("value", ",").alias("cells"), F.lower(F.trim("value")).alias("line"))
    cell = lambda i: F.trim(F.regexp_replace(F.get("cells", F.lit(i)), '^\\s*"|"\\s*$', ""))
    rows = lines.where(~F.col("line").startswith("url,") & (F.col("line") != "")).select(cell(0).alias("url"), cell(1).alias("status"))
    return rows.where((F.col("url") != "") & (F.coalesce("status", F.lit("")) != ""))


def csv_urls(spark: SparkSession, path: str, column: str = "url") -> DataFrame:
    """A CSV with its headers trimmed and in lower case, without rows that lack the column."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.toDF(*[c.strip().lower() for c in rows.columns]).na.drop(subset=[column])


def tsv_sites(texts: DataFrame, text: str = "value") -> DataFrame:
    """url, da, spam_score of pasted lines of tab-separated values; numbers keep digits and points only."""
    lines = texts.select(F.explode(F.split(F.col(text), r"\r?\n")).alias("line")).where(F.trim("line") != "")
    cells = F.split("line", "\t")
    number = lambda i: F.regexp_replace(F.trim(F.get(cells, F.lit(i))), "[^0-9.]", "").try_cast("double")
    return lines.select(F.trim(F.get(cells, F.lit(0))).alias("url"), number(1).alias("da"), number(2).alias("spam_score")).where("url <> ''")
