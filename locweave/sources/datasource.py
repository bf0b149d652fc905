"""Sitemaps as a data source of Spark: spark.read.format("sitemap"), and a writer that commits whole documents.

A task reads many small files or one large one, and yields rows while it parses. What tasks write lies in a staging folder until
the job commits; a failed task or job leaves nothing. Files are reached by Arrow's file systems (a local or mounted
path, hdfs://, s3://, gs://); for stores that only Spark's own readers reach there are readers.scan_files and
writers.write_documents.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ship
from . import readers, writers

SCHEMA = "path string, source_file string, root string, position long, loc string, lastmod string"
PIECE = 1 << 18
#: Bytes that a task reads, those that opening a file counts for, and the tasks that many files are shared out among at least.
TASK_BYTES, FILE_COST, TASKS = 1 << 25, 1 << 16, 200


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*://", path) else (fs.LocalFileSystem(), path.removeprefix("file:"))


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[str, int, str, str | None]]:
    """root, position, loc, lastmod of the entries of a document, as soon as each is complete.

    Names count without case, in any namespace; locs and dates of another namespace than their entry's, such as those of
    images, are none of the entry's. Entries are told at their end, so that a date may stand before or after the loc;
    what comes before an error in a broken document is told.
    """
    ready: list[tuple[str, int, str, str | None]] = []
    state = {"root": None, "text": None, "loc": None, "date": None, "space": "", "n": 0}

    def start(name: str, _: dict) -> None:
        prefix, _, local = name.lower().rpartition(":")
        state["root"] = state["root"] or local
        if local in ("url", "sitemap"):
            state["loc"] = state["date"] = None
            state["space"] = prefix
        state["text"] = [] if prefix == state["space"] and local in ("loc", "lastmod") else None

    def end(name: str) -> None:
        local = name.rpartition(":")[2].lower()
        text = "".join(state["text"]).strip() if state["text"] is not None else None
        if text and local == "loc":
            state["loc"] = text
        elif text and local == "lastmod":
            state["date"] = text
        elif local in ("url", "sitemap") and state["loc"]:
            ready.append((state["root"], state["n"], state["loc"], state["date"]))
            state["n"] += 1
        state["text"] = None

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda data: state["text"] is not None and state["text"].append(data)
    first = True
    try:
        for piece in pieces:
            parser.Parse(readers.strip_preamble(piece)[0] if first else piece, False)
            first = first and not piece
            yield from ready
            ready.clear()
        parser.Parse(b"", True)
    except expat.ExpatError:
        pass
    yield from ready


@dataclass
class FilePartition(InputPartition):
    """The files that a task reads, one after another."""

    paths: list[str]


def shared_out(files: list[tuple[str, int]], cost: int = FILE_COST, most: int = TASK_BYTES, tasks_wanted: int = TASKS) -> list[FilePartition]:
    """Files (path, bytes) by tasks in their order: as many as come to so many bytes, where each counts some more for being opened.

    Below so many files each is a task of its own, and more are shared out among that many tasks at least.
    """
    most = min(most, sum(size + cost for _, size in files) // tasks_wanted)
    tasks: list[FilePartition] = []
    held = most
    for path, size in files:
        if held + size + cost > most:
            tasks.append(FilePartition([]))
            held = 0
        tasks[-1].paths.append(path)
        held += size + cost
    return tasks


class SitemapReader(DataSourceReader):
    def __init__(self, path: str, names: str):
        self.path, self.names = path, names

    def partitions(self) -> list[FilePartition]:
        store, path = _store(self.path)
        root = self.path.removesuffix(path) if path != self.path else ""
        info = store.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        hidden = re.compile(r"/[_.][^/]*")
        return shared_out([(root + f.path, f.size or 0) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and re.search(self.names, f.path) and not hidden.search(f.path[len(path) :])])

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._rows(path)

    def _rows(self, place: str) -> Iterator[tuple]:
        store, path = _store(place)
        with store.open_input_stream(path, compression=None) as source:

            def pieces() -> Iterator[bytes]:
                unpack = None
                while piece := source.read(PIECE):
                    if unpack is None:
                        unpack = zlib.decompressobj(31) if piece[:2] == b"\x1f\x8b" else False
                    try:
                        yield unpack.decompress(piece) if unpack else piece
                    except zlib.error:
                        return

            name = path.rpartition("/")[2]
            for root, position, loc, lastmod in parsed(pieces()):
                yield place, name, root, position, loc, lastmod


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: places in the staging folder with the names they are to have."""

    files: list[tuple[str, str]]


class SitemapWriter(DataSourceWriter):
    """Rows of (source_file, part, position, loc, lastmod) in order of these: a document for each source_file and part."""

    def __init__(self, path: str, overwrite: bool, packed: bool):
        self.path, self.overwrite, self.packed = path.rstrip("/"), overwrite, packed
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def _name(self, source_file: str, part: int) -> str:
        stem, ending = re.fullmatch(r"(.*?)(\.xml(?:\.gz)?)?", source_file, re.S).groups()
        stem = re.sub(r"[^A-Za-z0-9._-]", "_", stem).lstrip("._") or "sitemap"
        return f"{stem}{f'-{part + 1}' if part else ''}{'.xml.gz' if self.packed or (ending or '').endswith('.gz') else '.xml'}"

    def write(self, rows: Iterator) -> Written:
        store, staging = _store(self.staging)
        mine = f"{staging}/{uuid.uuid4().hex}"
        store.create_dir(mine, recursive=True)
        done: list[tuple[str, str]] = []
        out, pack, open_for = None, None, None

        def say(text: str) -> None:
            data = text.encode()
            out.write(pack.compress(data) if pack else data)

        def close() -> None:
            if out is not None:
                say("</urlset>\n")
                if pack:
                    out.write(pack.flush())
                out.close()

        for row in rows:
            of = row["source_file"], row["part"]
            if of != open_for:
                close()
                name, place = self._name(*of), f"{mine}/{len(done)}"
                out, open_for = store.open_output_stream(place, compression=None), of
                pack = zlib.compressobj(6, zlib.DEFLATED, 31) if name.endswith(".gz") else None
                done.append((place, name))
                say(writers.URLSET_OPEN)
            date = f"    <lastmod>{escape(row['lastmod'])}</lastmod>\n" if row["lastmod"] else ""
            say(f"  <url>\n    <loc>{escape(row['loc'], {chr(34): '&quot;', chr(39): '&apos;'})}</loc>\n{date}  </url>\n")
        close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = _store(self.path)
        moves = [m for w in messages if w for m in w.files]
        names = [name for _, name in moves]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"documents of one name: {sorted({n for n in names if names.count(n) > 1})[:5]}")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path)):
                if old.type == fs.FileType.File and re.search(readers.SITEMAP_NAMES, old.path):
                    store.delete_file(old.path)
        for place, name in moves:
            store.move(place, f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, staging = _store(self.staging)
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


class SitemapSource(DataSource):
    """Options: path, names (which files count), packed (whether all written files are gzipped)."""

    @classmethod
    def name(cls) -> str:
        return "sitemap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SitemapReader:
        return SitemapReader(self.options["path"], self.options.get("names", readers.SITEMAP_NAMES))

    def writer(self, schema: StructType, overwrite: bool) -> SitemapWriter:
        return SitemapWriter(self.options["path"], overwrite, self.options.get("packed", "false").lower() == "true")


def register(spark: SparkSession) -> None:
    """Make format("sitemap") known to the session."""
    ship(spark)
    spark.dataSource.register(SitemapSource)


def write_sitemaps(locs: DataFrame, path: str, mode: str = "append", packed: bool = False, most: int = writers.FILE_LOCS) -> None:
    """Write locs (source_file, position, loc, and lastmod as text) as documents of so many positions at most, all or none.

    Rows of a document are brought together and sorted by Spark; a task writes its documents one after another and holds
    none. Null locs are left out, a null source_file is sitemap.
    """
    register(locs.sparkSession)
    rows = locs.where("loc IS NOT NULL").select(F.coalesce("source_file", F.lit("sitemap")).alias("source_file"), F.floor(F.col("position") / most).cast("long").alias("part"), F.col("position").cast("long").alias("position"), "loc", F.col("lastmod").cast("string").alias("lastmod"))
    rows = rows.repartition("source_file", "part").sortWithinPartitions("source_file", "part", "position")
    rows.write.format("sitemap").option("packed", str(packed).lower()).mode(mode).save(path)
