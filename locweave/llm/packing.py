"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Whole sequences of a long document come first. What is left of it, or a document that fits, is one
piece; one between capacity / (k + 1) and capacity / k belongs to class k, and a bin of class k takes k
of them whole. The head of the next piece fills what is left, so that every bin is full to the last
token and has one cut at most. Each task fills bins of its own, so nothing is shuffled; what its
unfilled bins hold in the end is dealt to full sequences and to some whose lengths are powers of two,
which need no padding either.
"""

from __future__ import annotations

import gc
import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .columns import release_memory, ship, table

CAPACITY = 1024
#: Encoded words a task keeps at most; they are let go with the task.
CACHE_WORDS = 200_000
#: Words that the tokenizer gets at a time; its results are far larger than the ids that are kept of them.
BATCH_WORDS = 8192
#: Rows an Arrow batch hands on at most.
OUT_ROWS = 50_000

PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
)

#: Texts are encoded together up to so many characters.
BLOCK_CHARS = 1_000_000

#: What the fast way leaves to the tokenizer: white space other than single blanks and line ends between
#: words, and characters beyond Latin letters. There a blank always opens a new word of the tokenizer.
ODD = "[\\s\x0b][\\s\x0b]|^[\\s\x0b]|[\\s\x0b]$|[\t\x0b\x0c\r\x1c-\x1f\u0085\u00a0\u0250-\U0010ffff]|<\\|endoftext\\|>"

SPECIAL = "<|endoftext|>"

#: Marks a word that has no blank before it; no plain text has it.
GLUE = "\x1c"

# Byte-level vocabularies write a byte as itself where it prints, else as a letter from U+0100 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

#: Tokenizers by file, kept while the Python worker lives.
MODELS: dict[str, object] = {}


def splits_at_words(model: object) -> bool:
    """Whether the tokenizer is a plain byte-level one, whose words the fast way knows; any other gets texts whole."""
    if model.normalizer is not None or model.pre_tokenizer is None or model.truncation or model.padding:
        return False
    first = json.loads(model.pre_tokenizer.__getstate__())
    usual = first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space")
    own = model.model
    plain = type(own).__name__ == "BPE" and not (own.dropout or own.unk_token or own.continuing_subword_prefix or own.end_of_word_suffix or own.ignore_merges)
    return bool(usual and plain and {t.content for t in model.get_added_tokens_decoder().values()} <= {SPECIAL})


class Encoder:
    """Token ids of texts as arrays of little-endian 32-bit integers; a word is encoded once while it is kept."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path not in MODELS:
            MODELS[path] = Tokenizer.from_file(path)
        self.model, self.known = MODELS[path], {}
        self.fast = splits_at_words(self.model)
        self.merge = self.model.model.tokenize

    def _encode(self, texts: list[str]) -> list[bytes]:
        enabled = gc.isenabled()
        gc.disable()  # a great many small objects come and go here, none of them in cycles
        try:
            out: list[bytes] = []
            for i in range(0, len(texts), BATCH_WORDS):
                out += [array("I", e.ids).tobytes() for e in self.model.encode_batch_fast(texts[i : i + BATCH_WORDS], add_special_tokens=False)]
            return out
        finally:
            if enabled:
                gc.enable()

    def _words(self, words: list[str]) -> list[bytes]:
        known = self.known
        coded = [known.get(w) for w in words]
        missing = [i for i, c in enumerate(coded) if c is None]
        # A word of letters is one piece to the model; the others go through the splitter first.
        letters = [i for i in missing if words[i].removeprefix(" ").isalpha()]
        others = [i for i in missing if not words[i].removeprefix(" ").isalpha()]
        for i in letters:
            coded[i] = array("I", [t.id for t in self.merge(words[i].encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()
        for i, c in zip(others, self._encode([words[i] for i in others]), strict=True):
            coded[i] = c
        for i in missing[: max(0, CACHE_WORDS - len(known))]:
            known[words[i]] = coded[i]
        return coded

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array a text."""
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)
        odd |= pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        odd |= not self.fast
        slow = np.flatnonzero(odd)
        for i, coded in zip(slow, self._encode(texts.take(pa.array(slow)).to_pylist()), strict=True):
            out[i] = np.frombuffer(coded, "<u4")
        plain = np.flatnonzero(~odd)
        if not len(plain):
            return out
        # Line ends, and a stop or comma that ends a word, are words of their own to the tokenizer.
        lines = pc.replace_substring_regex(texts.take(pa.array(plain)), r"([\pL\pN])([.,])([ \n]|$)", " ".join([r"\1", GLUE + r"\2\3"]))
        lines = pc.replace_substring(lines, "\n", " \n ")
        split = pc.split_pattern(lines, " ")
        counts = pc.list_value_length(split).to_numpy()
        words = split.flatten().dictionary_encode()
        index, names = words.indices.to_numpy(), words.dictionary.to_pylist()
        line_end = index == (names.index("\n") if "\n" in names else -1)
        bare = line_end.copy()  # a word at the start of a line has no blank before it
        bare[1:] |= line_end[:-1]
        bare[np.concatenate([[0], np.cumsum(counts)[:-1]])] = True
        code = index.astype(np.int64) * 2 + bare
        used = np.flatnonzero(np.bincount(code, minlength=2 * len(names)))
        coded = self._words([(names[c >> 1] if c & 1 else " " + names[c >> 1]).removeprefix(" " + GLUE).removeprefix(GLUE) for c in used.tolist()])
        size = np.zeros(2 * len(names), np.int64)
        size[used] = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        begin = np.zeros(2 * len(names), np.int64)
        begin[used] = np.cumsum(size[used]) - size[used]
        flat = np.frombuffer(b"".join(coded), "<u4")
        sizes = size[code]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(begin[code] - (ends - sizes), sizes) + np.arange(ends[-1])]
        doc_ends = ends[np.cumsum(counts) - 1]
        for i, piece in zip(plain, np.split(ids, doc_ends[:-1]), strict=True):
            out[i] = piece
        return out


def blocks(texts: pa.Array, chars: int = BLOCK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many bytes of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(sizes):
        done = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, done + chars, "right")))
        yield start, stop
        start = stop


class Bins:
    """The open bins of a task, one a class.

    A piece of n tokens, fewer than the capacity, belongs to class k = capacity // n, and a bin of that
    class takes k such pieces whole. What then is left of the bin is shorter than any piece of the
    class, so the head of the next one fills it, and the rest of that piece goes to the class of its
    own length. So a bin has one cut at most.
    """

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list[tuple]] = {}
        self.room: dict[int, int] = {}

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> list[tuple]:
        """The rows of the bins that this piece (its ids as bytes) fills."""
        rows: list[tuple] = []
        while n := len(ids) // 4:
            k = self.capacity // max(1, n) or 1
            waiting, room = self.open.setdefault(k, []), self.room.setdefault(k, self.capacity)
            take = n if len(waiting) < k and n <= room else room
            waiting.append((doc_id, start, ids[: 4 * take], total))
            self.room[k] = room - take
            if take == room:
                rows += self._close(self.open.pop(k))
                del self.room[k]
            start, ids = start + take, ids[4 * take :]
        return rows

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        rows, at = [], 0
        for doc_id, start, ids, total in pieces:
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), total, self.next_id, at))
            at += len(ids) // 4
        self.next_id += 1
        return rows

    def rest(self) -> Iterator[tuple]:
        """What is in bins that no piece has filled, in full sequences and last in some whose lengths are powers of two."""
        pieces = [p for _, waiting in sorted(self.open.items()) for p in waiting]
        left = sum(len(p[2]) for p in pieces) // 4
        self.open, self.room = {}, {}
        held: list[tuple] = []
        while left:
            room = size = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            while room:
                doc_id, start, ids, total = pieces.pop(0)
                take = min(room, len(ids) // 4)
                held.append((doc_id, start, ids[: 4 * take], total))
                if 4 * take < len(ids):
                    pieces.insert(0, (doc_id, start + take, ids[4 * take :], total))
                room -= take
            yield from self._close(held)
            held, left = [], left - size


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its token ids and then id 0, so an empty or null text is one token. Repeated rows
    and null ids are packed like any others. Sequence ids are the task's number in the upper bits
    and a count below, so that tasks need not agree on them. An empty table gives no rows.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        encoder = Encoder(tokenizer)
        bins = Bins(capacity, TaskContext.get().partitionId() << 33)
        schema = pa.schema([pa.field(f.name, pa.int64()) for f in PIECES])
        out: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1), "")
            for first, stop in blocks(texts):
                for doc_id, coded in zip(ids[first:stop], encoder.encode(texts.slice(first, stop - first)), strict=True):
                    tokens = coded.tobytes() + b"\0\0\0\0"
                    out += bins.add(doc_id, 0, tokens, len(tokens) // 4)
                    if len(out) >= OUT_ROWS:
                        yield flush(out)
                        out = []
        out += bins.rest()
        if out:
            yield flush(out)
        encoder.known.clear()
        out = []
        release_memory()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
