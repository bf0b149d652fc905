"""Changes to sitemap files that leave every other byte as it was: new texts of locs, and url blocks taken out.

Files are cut into tokens by tasks; what is to change is decided by DataFrame operations on the table of
their locs, by any rule that columns can say; tasks then put the files together again from the untouched
pieces and the changes. Comments, alternates, images, dates, line ends and encodings stay.
"""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from . import readers

PIECE = 1 << 20
#: What a token can be: an url block with the white space before it opening and closing, or a loc.
TOKEN = re.compile(rb"\s*<url>|</url>|<loc>(?P<inner>.*?)</loc>", re.S)
#: How far back from the end of what was read an unfinished token may begin; longer runs of white space are cut.
LONGEST = 1 << 16
INNER = re.compile(rb"(?P<lead>\s*)(?:<!\[CDATA\[(?P<cdata>.*?)\]\]>|(?P<plain>.*?))(?P<trail>\s*)\Z", re.S)
NAMED = re.compile(r"&(?:lt|gt|quot|apos|amp);")


@dataclass
class Change:
    """What becomes of a loc: a new text, or the removal of its block."""

    text: str | None = None
    drop: bool = False


def unpacked(content: bytes) -> Iterator[bytes]:
    """The content in pieces; a gzipped one is unpacked on the way."""
    if content[:2] != b"\x1f\x8b":
        view = memoryview(content)
        yield from (bytes(view[k : k + PIECE]) for k in range(0, len(content), PIECE))
        return
    source, unpack = io.BytesIO(content), zlib.decompressobj(31)
    while piece := source.read(PIECE // 8):
        yield unpack.decompress(piece)
        while unpack.eof and unpack.unused_data:  # members one after another
            rest, unpack = unpack.unused_data, zlib.decompressobj(31)
            yield unpack.decompress(rest)
    yield unpack.flush()


def tokens(pieces: Iterator[bytes]) -> Iterator[tuple[str, bytes]]:
    """The document as text, open, close and loc tokens; joined together they are the document."""
    held = b""
    at_end = False
    pieces = iter(pieces)
    while not at_end:
        piece = next(pieces, None)
        at_end = piece is None
        held += piece or b""
        at = 0
        for m in TOKEN.finditer(held):
            if m.start() > at:
                yield "text", held[at : m.start()]
            kind = "loc" if m["inner"] is not None else "close" if m[0].startswith(b"</") else "open"
            yield kind, m[0]
            at = m.end()
        # What may be the beginning of a token waits for the next piece.
        keep = held.find(b"<loc>", at)
        if keep < 0:
            last = re.compile(rb"(?:\s+(?:<[^>]{0,5})?|<[^>]{0,5})\Z").search(held, max(at, len(held) - LONGEST))
            keep = last.start() if last else len(held)
        keep = len(held) if at_end else keep
        if keep > at:
            yield "text", held[at:keep]
        held = held[keep:]


def loc_of(token: bytes) -> str:
    """The URL in a loc token, trimmed, entities decoded unless it is CDATA."""
    m = INNER.match(token[5:-6])
    text = (m["cdata"] if m["cdata"] is not None else m["plain"]).decode("utf-8", "replace")
    return text.strip() if m["cdata"] is not None else NAMED.sub(lambda e: unescape(e[0]), text)


def with_text(token: bytes, text: str) -> bytes:
    """The loc token with another URL in its place, in CDATA where the old one was, with the white space round it."""
    m = INNER.match(token[5:-6])
    if m["cdata"] is not None:
        inner = b"<![CDATA[" + text.encode() + b"]]>"
    else:
        inner = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").encode()
    return b"<loc>" + m["lead"] + inner + m["trail"] + b"</loc>"


def changed(pieces: Iterator[bytes], changes: dict[int, Change], counts: dict[str, int]) -> Iterator[bytes]:
    """The document with changes by the number of the loc, from 0; counts are filled with kept, removed and rewritten.

    A block goes where its first loc is to be dropped, with the white space before it. A block that the
    document's end cuts off stays as it is.
    """
    counts.update(kept=0, removed=0, rewritten=0)
    block: list[bytes] | None = None
    drop, first, number = False, True, 0
    for kind, token in tokens(pieces):
        if kind == "open" and block is None:
            block, drop, first = [], False, True
        if kind == "loc":
            change = changes.get(number)
            number += 1
            if change and change.drop and block is not None and first:
                drop = True
            elif change and change.text is not None and change.text != loc_of(token):
                token = with_text(token, change.text)
                counts["rewritten"] += 1
            first = False
        if block is None:
            yield token
            continue
        block.append(token)
        if kind == "close":
            counts["removed" if drop else "kept"] += 1
            if not drop:
                yield b"".join(block)
            block = None
    if block:
        yield b"".join(block)


def _packed(pieces: Iterator[bytes]) -> bytes:
    """Gzipped, without a time, so that the same pieces give the same bytes."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([*(pack.compress(p) for p in pieces), pack.flush()])


def byte_locs(spark: SparkSession, path: str, names: str = readers.SITEMAP_NAMES) -> DataFrame:
    """path, position, loc, in_block of the locs of the files below path, numbered from 0 as they stand in their file.

    A file comes to a task whole (sitemaps are of 50 MB at most); files without locs have no rows. in_block says whether
    the loc is the first of an url block, and so stands for it. Broken documents are read as far as tokens go.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                rows, block, first = [], False, False
                for kind, token in tokens(unpacked(bytes(content))):
                    if kind == "open" and not block:
                        block, first = True, True
                    elif kind == "close":
                        block = False
                    elif kind == "loc":
                        rows.append((p, len(rows), loc_of(token), block and first))
                        first = False
                yield pd.DataFrame(rows, columns=["path", "position", "loc", "in_block"])

    ship(spark)
    return _files(spark, path, names).mapInPandas(run, "path string, position long, loc string, in_block boolean")


def _files(spark: SparkSession, path: str, names: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").rlike(names)).select("path", "content")


def rewrite_files(spark: SparkSession, path: str, edits: DataFrame, names: str = readers.SITEMAP_NAMES) -> DataFrame:
    """path, content, kept, removed, rewritten of the files below path after edits (path, position, text, drop).

    kept and removed count url blocks. Files without edits keep every byte; so do packed ones without changes,
    while changed ones are packed again. A null text changes nothing. Of several edits of one loc a drop goes
    first, then the least text. Edits of what is not there are passed over.
    """
    one = edits.groupBy(F.col("path").alias("of"), "position").agg(F.max(F.coalesce("drop", F.lit(False))).alias("drop"), F.min("text").alias("text"))
    by_file = one.where(F.col("drop") | F.col("text").isNotNull()).groupBy("of").agg(F.collect_list(F.struct("position", "text", "drop")).alias("edits"))
    files = _files(spark, path, names).join(by_file, F.col("path") == F.col("of"), "left").select("path", "content", "edits")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, content, listed in zip(frame["path"], frame["content"], frame["edits"], strict=True):
                content, counts = bytes(content), {}
                changes = {int(e["position"]): Change(e["text"], bool(e["drop"])) for e in (listed if listed is not None else [])}
                made = list(changed(unpacked(content), changes, counts))
                touched = counts["removed"] or counts["rewritten"]
                new = content if not touched else _packed(iter(made)) if content[:2] == b"\x1f\x8b" else b"".join(made)
                yield pd.DataFrame([(p, new, counts["kept"], counts["removed"], counts["rewritten"])], columns=["path", "content", "kept", "removed", "rewritten"])

    ship(spark)
    return files.mapInPandas(run, "path string, content binary, kept long, removed long, rewritten long")


def edits_of(locs: DataFrame, new: Column, drop: Column | None = None) -> DataFrame:
    """path, position, text, drop from a table of locs: new is the loc's rewriting (null: none), drop says whether its block goes."""
    gone = F.lit(False) if drop is None else F.coalesce(drop, F.lit(False)) & F.col("in_block")
    return locs.select("path", "position", F.when(~gone, new).alias("text"), gone.alias("drop")).where(F.col("drop") | F.col("text").isNotNull())
