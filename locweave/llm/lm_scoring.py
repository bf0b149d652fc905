"""Scores of texts by a bigram model whose counts are in a log-frequency Bloom filter.

A count is kept as the number of powers of BASE it reaches. An n-gram that reaches q of them is put
into the filter q times, as (n-gram, 1) to (n-gram, q), and read by asking for one after the other until
an answer is no. The
filter has three bits for each byte of text to learn from, and is cut into cells: the task that sums a cell's
counts also sets that cell's bits, so no bits of different tasks are merged, and texts ask the cells by a
shuffle, so that no worker holds more than one cell.

What is broadcast has a bound whatever the corpus: the filter's answers for frequent words and bigrams, asked
once by the tasks that fill it, so that scores are the filter's at every size and the same whatever is broadcast.
A bigram whose last word is frequent is in the cell of its own hash, any other in the cell of that word, which so
knows all that a token's score needs. The base score needs exact counts of all words; those of frequent words are
broadcast beside their answers, those of others come back from their cells as sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as sh
from .columns import ship, table, written

#: The filter has so many bits for each byte of text to learn from, and this many at least.
BITS_PER_BYTE = 3
MIN_BITS = 1 << 20
#: Bits of one cell at most.
CELL_BITS = 1 << 26
HASHES = 2
BASE = 1.5
MAX_LEVEL = 64
#: Weight of the unigram estimate, in counts.
PRIOR = 4.0
#: Frequent words and bigrams whose answers are in the broadcast: 17 and 9 bytes each.
HOT_WORDS = 1 << 18
HOT_PAIRS = 1 << 18
#: Bytes of text that the frequent ones are chosen from. The choice decides where counts are kept, not what they are.
SAMPLE_BYTES = 16 << 20
#: Bytes of texts that are worked on together: each block sends a pack to each cell.
BLOCK_BYTES = 4 << 20
#: Tokens whose n-grams a task sums before it sends them.
GATHER_TOKENS = 3_500_000

END = np.uint64(0x9E3779B97F4A7C15)
PACK = "cell long, kind int, a binary, b binary, c binary, d binary"
_PACK = pa.schema([("cell", pa.int64()), ("kind", pa.int32()), *[(x, pa.binary()) for x in "abcd"]])
COUNTS, RARE, TEXTS, PAIRS = 0, 1, 2, 3


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    full = [(r[0], r[1], *[x.tobytes() for x in r[2:]], *[b""] * (6 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], f.type) for i, f in enumerate(_PACK)], schema=_PACK)


def _read(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[list[bytes]]]]:
    out: dict[int, dict[int, list[list[bytes]]]] = {}
    for batch in batches:
        for cell, kind, *blobs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            out.setdefault(cell, {}).setdefault(kind, []).append(blobs)
    return out


def _join(rows: list[list[bytes]], k: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), kind)


def cell_of(hashes: np.ndarray, cells: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(cells) >> np.uint64(32)).astype(np.int64)


def bigrams(hashes: np.ndarray, before: np.ndarray) -> np.ndarray:
    return sh.mix(sh.mix(before) * np.uint64(3) + hashes)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of texts with an end after each, the hashes before them (the end's at the start), tokens per text."""
    codes, names, counts = sh.words(texts)
    ends = np.cumsum(counts + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    if len(codes):
        out[inner] = sh.word_hashes(names)[codes]
    before = np.empty_like(out)
    if len(out):
        before[0], before[1:] = END, out[:-1]
    return out, before, counts + 1


def levels(counts: np.ndarray) -> np.ndarray:
    """How many of the powers 1, BASE, BASE**2 ... each count reaches."""
    return np.searchsorted(BASE ** np.arange(MAX_LEVEL), counts, "right")


#: The count that stands for each level: the middle of the whole numbers at that level.
MEAN = np.concatenate([[0.0], [(math.ceil(BASE ** (q - 1)) + max(math.ceil(BASE ** (q - 1)), math.ceil(BASE**q) - 1)) / 2 for q in range(1, MAX_LEVEL + 1)]])


def _positions(hashes: np.ndarray, level: int, k: int, cells: int, cell_bits: int) -> np.ndarray:
    salt = np.uint64((level * HASHES + k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return cell_of(hashes, cells) * cell_bits + (sh.mix(hashes + salt) & np.uint64(cell_bits - 1)).astype(np.int64)


def filled(hashes: np.ndarray, reached: np.ndarray, cell: int, cells: int, cell_bits: int) -> np.ndarray:
    """The packed bits of one cell that holds these n-grams with these levels."""
    bits = np.zeros(cell_bits, bool)
    for level in range(1, int(reached.max(initial=0)) + 1):
        hashes, reached = hashes[reached >= level], reached[reached >= level]
        for k in range(HASHES):
            bits[_positions(hashes, level, k, cells, cell_bits) - cell * cell_bits] = True
    return np.packbits(bits, bitorder="little")


def probed(filter_bits: np.ndarray, hashes: np.ndarray, cells: int, cell_bits: int) -> np.ndarray:
    """The level of each n-gram as the filter knows it."""
    out = np.zeros(len(hashes), np.int64)
    alive = np.arange(len(hashes))
    for level in range(1, MAX_LEVEL):
        for k in range(HASHES):
            at = _positions(hashes, level, k, cells, cell_bits)
            yes = (filter_bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            alive, hashes = alive[yes], hashes[yes]
        if not len(alive):
            break
        out[alive] = level
    return out


def trained_on(id_col: str = "doc_id") -> Column:
    """Whether a row is learned from: its remainder is not 1 (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 != 1


def found(names: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each asked one is among the sorted names, and its place there."""
    if not len(names):
        return np.zeros(len(asked), bool), np.zeros(len(asked), np.int64)
    place = np.minimum(np.searchsorted(names, asked), len(names) - 1)
    return names[place] == asked, place


def home(pairs: np.ndarray, last: np.ndarray, hot: np.ndarray, cells: int) -> np.ndarray:
    """The cell of each bigram: that of its last word, or of its own hash where that word is frequent."""
    return cell_of(np.where(found(hot, last)[0], pairs, last), cells)


class Model:
    """What a worker needs to ask the cells: totals, and the cells' answers for frequent words (with their counts) and bigrams."""

    def __init__(self, cells: int, cell_bits: int, total: int, kinds: int, hot: np.ndarray, hot_counts: np.ndarray, hot_levels: np.ndarray, pairs: np.ndarray, pair_levels: np.ndarray):
        self.cells, self.cell_bits, self.total, self.kinds = cells, cell_bits, total, kinds
        self.hot, self.hot_counts, self.hot_levels = hot, hot_counts, hot_levels
        self.pairs, self.pair_levels = pairs, pair_levels
        # log10 of a token's probability is a part for the levels of the token and its bigram, less one for that of its context.
        uni = (MEAN + 0.5) / (total + 0.5 * (kinds + 1))
        self.parts = np.log10(np.minimum(MEAN[:, None], MEAN[None, :]) + PRIOR * uni[:, None]).ravel()
        self.context = np.log10(MEAN + PRIOR)

    @property
    def norm(self) -> float:
        return math.log10(self.total + 0.5 * (self.kinds + 1))


def code(own: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The place in Model.parts for the levels of a token and of its bigram."""
    return own.astype(np.int64) * len(MEAN) + seen


def frequent(texts: DataFrame, size: int) -> list[np.ndarray]:
    """The sorted hashes of frequent words and of frequent bigrams, by a sample with a bound."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            column = batch.column(0)
            for i, j in sh.blocks(column, BLOCK_BYTES):
                h, before, _ = tokens(column.slice(i, j - i))
                held.append((h, bigrams(h, before)))
        if held:
            yield _pack([(0, kind, *(x.astype("<i8") for x in np.unique(np.concatenate(flat), return_counts=True))) for kind, flat in enumerate(zip(*held, strict=True))])

    part = texts if size <= SAMPLE_BYTES else texts.sample(SAMPLE_BYTES / size, seed=1)
    rows = part.mapInArrow(count, PACK).select("kind", "a", "b").collect()
    out = []
    for kind, most in enumerate((HOT_WORDS, HOT_PAIRS)):
        mine = [(r["a"], r["b"]) for r in rows if r["kind"] == kind]
        names, at = np.unique(_join(mine, 0, "<u8"), return_inverse=True)
        n = np.bincount(at, _join(mine, 1, "<i8"), len(names))
        out.append(np.sort(names[np.argsort(-n, kind="stable")[:most]]))
    return out


def layout(size: int) -> tuple[int, int]:
    """How many cells the filter of so many bytes of text has, and how many bits each (a power of two)."""
    bits = max(MIN_BITS, BITS_PER_BYTE * size)
    cell_bits = min(CELL_BITS, 1 << ((bits // 16).bit_length() - 1))
    return -(-bits // cell_bits), cell_bits


def learn(docs: DataFrame, text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of all rows of docs, and by cell the exact counts of all words and the filter (cell, a: hashes, b: counts, bits)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("body"))
    size = texts.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    cells, cell_bits = layout(size)
    chosen = docs.sparkSession.sparkContext.broadcast(frequent(texts, size))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def send() -> pa.RecordBatch:
            rows = []
            words, pairs = (np.concatenate(x) for x in zip(*held, strict=True))
            for kind, flat in enumerate((words, pairs)):
                names, first, n = np.unique(flat, return_index=True, return_counts=True)
                cell = cell_of(names, cells) if kind == 0 else home(names, words[first], chosen.value[0], cells)
                order = np.argsort(cell, kind="stable")
                names, n = names[order], n[order]
                edges = np.searchsorted(cell[order], np.arange(cells + 1))
                rows += [(c, kind, names[i:j].astype("<u8"), n[i:j].astype("<i8")) for c, (i, j) in enumerate(zip(edges, edges[1:], strict=False)) if j > i]
            held.clear()
            return _pack(rows)

        for batch in batches:
            column = batch.column(0)
            for i, j in sh.blocks(column, BLOCK_BYTES):
                h, before, _ = tokens(column.slice(i, j - i))
                held.append((h, bigrams(h, before)))
                if sum(len(x) for x, _ in held) >= GATHER_TOKENS:
                    yield send()
        if held:
            yield send()

    blobs_made = ("a", "b", "bits", "hot", "hot_counts", "hot_levels", "hot_pairs", "pair_levels")
    made = pa.schema([("cell", pa.int64()), *[(x, pa.binary()) for x in blobs_made], ("total", pa.int64()), ("kinds", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, kinds in _read(batches).items():
            parts = []
            for kind in (0, 1):
                rows = kinds.get(kind, [])
                flat, n = _join(rows, 0, "<u8"), _join(rows, 1, "<i8")
                names, at = np.unique(flat, return_inverse=True)
                parts.append((names, np.bincount(at, n, len(names)).astype(np.int64)))
            (words, counts), (pairs, pair_counts) = parts
            slice_ = filled(np.concatenate([words, pairs]), levels(np.concatenate([counts, pair_counts])), 0, 1, cell_bits)
            hot, hot_pairs = (found(names, x)[0] for names, x in zip(chosen.value, (words, pairs), strict=True))
            # The exact counts end here: what scores are made of is asked of the cell's bits.
            answers = [probed(slice_, x, 1, cell_bits).astype(np.uint8) for x in (words[hot], pairs[hot_pairs])]
            blobs = [words.astype("<u8"), counts.astype("<i8"), slice_, words[hot].astype("<u8"), counts[hot].astype("<i8"), answers[0], pairs[hot_pairs].astype("<u8"), answers[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([cell]), *[pa.array([x.tobytes()], pa.binary()) for x in blobs], pa.array([int(counts.sum())]), pa.array([len(words)])], schema=made
            )

    packed = texts.mapInArrow(gather, PACK).repartitionById(cells, F.col("cell").cast("int"))
    counted = written(packed.mapInArrow(build, f"cell long, {', '.join(f'{x} binary' for x in blobs_made)}, total long, kinds long"), "lm-cells")
    # What comes to the driver has a bound: HOT_WORDS words, HOT_PAIRS bigrams and two numbers a cell.
    rows = counted.select(*blobs_made[3:], "total", "kinds").collect()
    hot, hot_counts, hot_levels, pairs, pair_levels = (_join([tuple(r) for r in rows], k, kind) for k, kind in enumerate(("<u8", "<i8", "u1", "<u8", "u1")))
    by, by_pair = np.argsort(hot), np.argsort(pairs)
    model = Model(cells, cell_bits, sum(r["total"] for r in rows), sum(r["kinds"] for r in rows), hot[by], hot_counts[by], hot_levels[by], pairs[by_pair], pair_levels[by_pair])
    return model, counted.select("cell", "a", "b", "bits")


def scores(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words of the text, A-Z lower-cased and cut at ASCII white space, and an end; a null or
    empty text is the end alone. base_score takes exact counts, score the filter's. Repeated rows and
    null ids are scored like any others.
    """
    spark = docs.sparkSession
    ship(spark)
    cells, targets = model.cells, model.cells
    shared = spark.sparkContext.broadcast(model)
    norm = model.norm

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        part = TaskContext.get().partitionId()
        row, turn = part << 33, part * 31
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for i, j in sh.blocks(column, BLOCK_BYTES):
                h, before, n = tokens(column.slice(i, j - i))
                pairs = bigrams(h, before)
                starts = np.cumsum(n) - n
                owner = np.repeat(np.arange(len(n), dtype="<u4"), n)
                is_hot, place = found(own.hot, h)
                hot_place = place[is_hot]
                exact, score, level = np.zeros(len(h)), np.zeros(len(h)), np.zeros(len(h), np.uint8)
                exact[is_hot], level[is_hot] = np.log10(own.hot_counts[hot_place] + 0.5), own.hot_levels[hot_place]
                # Each token is the context of one: the next, or its text's first where it is the end.
                score[is_hot] = -own.context[level[is_hot]]
                here, place = found(own.pairs, pairs)
                here &= is_hot
                score[here] += own.parts[code(level[here], own.pair_levels[place[here]])]
                base = np.add.reduceat(exact, starts) - n * norm
                known = np.bincount(owner, is_hot, len(n)).astype("<i8")
                rows = np.arange(row, row + len(n))
                # All of a block's rows are finished by the same task.
                head = np.array([row, turn % targets], "<i8")
                row += len(n)
                doc = np.array([(0, 1) if x is None else (x, 0) for x in ids.slice(i, j - i).to_pylist()], "<i8").reshape(-1, 2)
                table_ = np.column_stack([rows, doc, n, known]).astype("<i8")
                packs = [(turn % cells, TEXTS, head, table_, np.column_stack([base, np.add.reduceat(score, starts)]).astype("<f8"))]
                turn += 1
                for kind, asked, by in ((RARE, ~is_hot, h), (PAIRS, is_hot & ~here, pairs)):
                    at = np.flatnonzero(asked)
                    cell = cell_of(by[at], cells).astype(np.uint16 if cells <= 1 << 16 else np.int64)
                    order = np.argsort(cell, kind="stable")
                    at, edges = at[order], np.searchsorted(cell[order], np.arange(cells + 1))
                    third = (h if kind == RARE else level)[at]
                    first, second = pairs[at], owner[at]
                    packs += [(c, kind, head, first[a:b].astype("<u8"), second[a:b], third[a:b]) for c, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
                yield _pack(packs)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for kinds in _read(batches).values():
            out = [(int(np.frombuffer(head, "<i8")[1]), TEXTS, np.frombuffer(table_, "<i8"), np.frombuffer(values, "<f8")) for head, table_, values, _ in kinds.get(TEXTS, [])]
            stored = kinds.get(COUNTS, [])
            bits = np.frombuffer(stored[0][2], np.uint8) if stored else np.zeros(own.cell_bits // 8, np.uint8)
            for kind in (RARE, PAIRS):
                packs = kinds.get(kind, [])
                if not packs:
                    continue
                seen = probed(bits, _join(packs, 1, "<u8"), 1, own.cell_bits)
                sizes = np.array([len(r[2]) // 4 for r in packs])
                edges = np.concatenate([[0], np.cumsum(sizes)])
                if kind == PAIRS:
                    codes = code(_join(packs, 3, np.uint8), seen).astype("<u2")
                    for r, a, b in zip(packs, edges, edges[1:], strict=False):
                        head = np.frombuffer(r[0], "<i8")
                        out.append((int(head[1]), PAIRS, np.frombuffer(r[2], "<u4"), codes[a:b], head[:1]))
                    continue
                asked = _join(packs, 3, "<u8")
                words, n = (_join(stored, k, t) for k, t in enumerate(("<u8", "<i8")))
                order = np.argsort(words)
                is_known, place = found(words[order], asked)
                count = np.where(is_known, n[order][place], 0) if len(n) else np.zeros(len(asked))
                level = probed(bits, asked, 1, own.cell_bits)
                heads = np.array([np.frombuffer(r[0], "<i8") for r in packs])
                rows = _join(packs, 2, "<u4").astype(np.int64) + np.repeat(heads[:, 0], sizes)
                values = np.log10(count + 0.5), count > 0, own.parts[code(level, seen)] - own.context[level]
                names, first, at = np.unique(rows, return_index=True, return_inverse=True)
                sums = np.column_stack([np.bincount(at, v, len(names)) for v in values]).astype("<f8")
                target = np.repeat(heads[:, 1], sizes)[first]
                by = np.argsort(target, kind="stable")
                edges = np.searchsorted(target[by], np.arange(targets + 1))
                out += [(t, RARE, names[by[a:b]].astype("<i8"), sums[by[a:b]]) for t, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
            if out:
                yield _pack(out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value.parts
        for kinds in _read(batches).values():
            text_rows = kinds.get(TEXTS, [])
            whole = _join(text_rows, 0, "<i8").reshape(-1, 5).copy()
            values = _join(text_rows, 1, "<f8").reshape(-1, 2).copy()
            order = np.argsort(whole[:, 0])
            whole, values = whole[order], values[order]
            rare = kinds.get(RARE, [])
            names, sums = _join(rare, 0, "<i8"), _join(rare, 1, "<f8").reshape(-1, 3)
            at = np.searchsorted(whole[:, 0], names)
            values[:, 0] += np.bincount(at, sums[:, 0], len(whole))
            values[:, 1] += np.bincount(at, sums[:, 2], len(whole))
            known = whole[:, 4] + np.bincount(at, sums[:, 1], len(whole)).astype(np.int64)
            for rows, codes, start in (r[:3] for r in kinds.get(PAIRS, [])):
                at = np.searchsorted(whole[:, 0], np.frombuffer(start, "<i8")[0]) + np.frombuffer(rows, "<u4").astype(np.int64)
                values[:, 1] += np.bincount(at, parts[np.frombuffer(codes, "<u2")], len(whole))
            yield pa.RecordBatch.from_arrays(
                [pa.array(whole[:, 1], mask=whole[:, 2] == 1), pa.array(whole[:, 3]), pa.array(known), pa.array(values[:, 0]), pa.array(values[:, 1])], names=["id", "n_tokens", "n_known", "base_score", "score"]
            )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    empty = F.lit(b"")
    vocabulary = counts.select("cell", F.lit(COUNTS).alias("kind"), "a", "b", F.col("bits").alias("c"), empty.alias("d"))
    asked = source.mapInArrow(work, PACK).unionByName(vocabulary).repartitionById(cells, F.col("cell").cast("int"))
    back = asked.mapInArrow(answer, PACK).repartitionById(targets, F.col("cell").cast("int"))
    done = back.mapInArrow(finish, "id long, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = learn(docs.where(trained_on()))
    return scores(docs, model, counts).withColumn("held_out", ~trained_on()).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
