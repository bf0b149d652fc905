"""Exact n-gram Jaccard joins by vertical partitioning, and the components of what they link.

The global order of n-grams (rare ones first) is cut into fragments by the hash of the n-gram, so that
one task has all holders of its n-grams. The first cut counts holders: an n-gram that one set alone
holds overlaps with nothing, and a set with too few others can have no partner. What is left is
small. Sets that share an n-gram of their prefixes are candidates; their overlaps are counted in
each fragment separately and summed for each pair.

A group of near copies is not expanded into pairs. Each prefix n-gram compares its holders with a few
of them, turn by turn; holders that are already connected need no further comparison. When few pairs
are left, or after the last turn, all pairs between what is still apart are compared. So every link
between different components is found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles as sh
from .columns import passing_tables, release_memory, ship, table, written
from .components import components

#: A link needs 100 * overlap >= PERCENT * union.
PERCENT = 75
#: Hashes that one fragment holds about; it is what a task sorts in memory.
FRAGMENT_HASHES = 1_500_000
#: Hashes that a task gathers before it deals them out to the fragments.
GATHER_HASHES = 1_000_000
#: Pairs that one cell of a verification holds about.
CELL_PAIRS = 1_000_000
#: Holders that the others of a prefix n-gram are compared with in one turn, after the first.
PIVOTS = 4
#: Turns at most before all remaining pairs are compared; fewer where the remaining pairs are few.
MAX_TURNS = 4
#: Keys of sets are broadcast up to this many, 16 bytes each, to pick the sets that pairs need.
BROADCAST_KEYS = 500_000
#: Holders in a chunk of a token's holders about.
CHUNK = 1024
#: Set keys that a task remembers, not to send a copy of a set again.
SEEN_KEYS = 200_000

PACK = "cell long, kind int, a binary, b binary, c binary, d binary, e binary"
_PACK = pa.schema([("cell", pa.int64()), ("kind", pa.int32()), *[(x, pa.binary()) for x in "abcde"]])


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    """rows: cell, kind and up to five arrays."""
    full = [(r[0], r[1], *[x.tobytes() for x in r[2:]], *[b""] * (7 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], f.type) for i, f in enumerate(_PACK)], schema=_PACK)


def _grouped(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, list[tuple]]]:
    """The packed rows of a partition by cell and kind; a partition seldom has more than one cell."""
    out: dict[int, dict[int, list[tuple]]] = {}
    for batch in batches:
        for cell, kind, *blobs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            out.setdefault(cell, {}).setdefault(kind, []).append(blobs)
    return out


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple]]]]:
    """The cells of a partition one after the other, each let go when the next is asked for."""
    held = _grouped(batches)
    while held:
        yield held.popitem()
    release_memory()


def _column(rows: list[tuple], k: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[k] for r in rows), kind)


def _deal(cell: np.ndarray, owner: np.ndarray, hashes: np.ndarray, extra: np.ndarray | None, keys: np.ndarray, sizes: np.ndarray, kind: int = 0) -> list[tuple]:
    """Rows of keys, sizes, counts and hashes for each cell, from flat arrays of one entry a hash."""
    order = np.lexsort((owner, cell))
    cell, owner, hashes = cell[order], owner[order], hashes[order]
    extra = None if extra is None else extra[order]
    new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (owner[1:] != owner[:-1])])) if len(cell) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(cell)))
    run_cell, run_owner = cell[new], owner[new]
    edges = np.flatnonzero(np.concatenate([[True], run_cell[1:] != run_cell[:-1]])) if len(new) else np.zeros(0, np.int64)
    rows = []
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(new)], strict=True):
        lo, hi = new[i], new[j] if j < len(new) else len(cell)
        more = () if extra is None else (extra[lo:hi].astype("<i4"),)
        rows.append((int(run_cell[i]), kind, keys[run_owner[i:j]].astype("<i8"), sizes[run_owner[i:j]].astype("<i4"), counts[i:j].astype("<i4"), hashes[lo:hi].astype("<u8"), *more))
    return rows


def _fragment(hashes: np.ndarray, fragments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(fragments) >> np.uint64(32)).astype(np.int64)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, n (different shingles) and set_key (null without any) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n, keys = batch.column(1), [], []
            for i, j in sh.blocks(texts):
                for s in sh.sets(texts.slice(i, j - i), size):
                    n.append(len(s))
                    keys.append(sh.set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64())], names=["id", "n", "set_key"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return source.mapInArrow(run, "id long, n long, set_key long")


def _spread(docs: DataFrame, text_col: str, size: int, fragments: int) -> DataFrame:
    """Every different set, cut at the fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        new: dict[int, np.ndarray] = {}
        gathered = 0

        def send() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, new.values()), np.int64, len(new))
            flat = np.concatenate(list(new.values()))
            owner = np.repeat(np.arange(len(new), dtype=np.int32), lengths)
            rows = _deal(_fragment(flat, fragments), owner, flat, None, np.fromiter(new, np.int64, len(new)), lengths)
            new.clear()
            return _pack(rows)

        for batch in batches:
            texts = batch.column(0)
            for i, j in sh.blocks(texts):
                for s in sh.sets(texts.slice(i, j - i), size):
                    if len(s) and (key := sh.set_key(s)) not in seen:
                        new[key] = s
                        gathered += len(s)
                        if len(seen) < SEEN_KEYS:
                            seen.add(key)
                if gathered >= GATHER_HASHES:
                    yield send()
                    gathered = 0
        if new:
            yield send()
        release_memory()

    return docs.select(F.col(text_col)).mapInArrow(run, PACK)


def _shared(spread: DataFrame, fragments: int, targets: int) -> DataFrame:
    """Of each fragment, the n-grams with two holders or more, with their number, dealt out by set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in _cells(batches):
            rows = kinds[0]
            keys, sizes, counts, hashes = (_column(rows, k, t) for k, t in enumerate(("<i8", "<i4", "<i4", "<u8")))
            # The same set can come from several tasks; the first is taken.
            kinds.clear(), rows.clear()
            first = np.zeros(len(keys), bool)
            first[np.unique(keys, return_index=True)[1]] = True
            owner = np.repeat(np.arange(len(keys), dtype=np.int32), counts)
            keep = first[owner]
            owner, hashes = owner[keep], hashes[keep]
            order = np.argsort(hashes, kind="stable")
            owner, hashes = owner[order], hashes[order]
            new = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
            held = np.diff(np.append(new, len(hashes))).astype(np.int32)
            held = np.repeat(held, held)
            many = held > 1
            owner, hashes, held = owner[many], hashes[many], held[many]
            if len(owner):
                target = (keys[owner] % targets).astype(np.int64)
                yield _pack(_deal(target, owner, hashes, held, keys, sizes))

    return spread.repartitionById(fragments, F.col("cell").cast("int")).mapInArrow(run, PACK)


def _alive(shared: DataFrame, targets: int, percent: int) -> DataFrame:
    """The sets that can have a partner: key, n, hashes (the shared ones, rare first), prefix (how many of them find partners)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in _cells(batches):
            rows = kinds[0]
            keys, sizes, counts, hashes, held = (_column(rows, k, t) for k, t in enumerate(("<i8", "<i4", "<i4", "<u8", "<i4")))
            names, at = np.unique(keys, return_inverse=True)
            n = np.zeros(len(names), np.int64)
            n[at] = sizes
            owner = np.repeat(at, counts)
            s = np.bincount(owner, minlength=len(names))
            need = -(-percent * n // 100)
            live = (s >= need)[owner]
            owner, hashes, held = owner[live], hashes[live], held[live]
            order = np.lexsort((hashes, held, owner))
            owner, hashes = owner[order], hashes[order]
            ids = np.unique(owner)
            ends = np.cumsum(np.bincount(owner, minlength=len(names))[ids])
            blobs = [x.astype("<u8").tobytes() for x in np.split(hashes, ends[:-1])] if len(ids) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[ids], pa.int64()), pa.array(n[ids], pa.int64()), pa.array(blobs, pa.binary()), pa.array((s - need + 1)[ids], pa.int64())],
                names=["key", "n", "hashes", "prefix"],
            )

    return shared.repartitionById(targets, F.col("cell").cast("int")).mapInArrow(run, "key long, n long, hashes binary, prefix long")


def _prefixes(alive: DataFrame) -> DataFrame:
    """A row for each n-gram of each prefix: token, key, n, rest (n-grams of the set from there on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n, blobs, prefix = (c.to_pylist() for c in batch.columns)
            tokens = [np.frombuffer(b, "<i8")[:p] for b, p in zip(blobs, prefix, strict=True)]
            rest = [len(b) // 8 - np.arange(p) for b, p in zip(blobs, prefix, strict=True)]
            times = np.array(prefix, np.int64)
            if len(times):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.repeat(np.array(keys, np.int64), times)), pa.array(np.repeat(np.array(n, np.int64), times)), pa.array(np.concatenate(rest).astype(np.int64))],
                    names=["token", "key", "n", "rest"],
                )

    return alive.select("key", "n", "hashes", "prefix").mapInArrow(run, "token long, key long, n long, rest long")


def _apart(key: Column) -> Column:
    """The key as a value that Spark shuffles anew, so that its adaptive joins can split a frequent one."""
    return key.bitwiseXOR(F.lit(0))


def _possible(n_a: Column, rest_a: Column, n_b: Column, rest_b: Column, percent: int) -> Column:
    """Whether sets of these sizes whose first common n-gram stands there can overlap enough."""
    return F.least(rest_a, rest_b) * (100 + percent) >= percent * (n_a + n_b)


def _different(tokens: DataFrame) -> DataFrame:
    """Of the tokens that the same sets hold, the one that comes first; tokens with one holder go.

    The order of n-grams is the same in all sets, so the first token leaves every holder the most n-grams
    from there on, and any pair that another token of the same holders allows is allowed by it too.
    """
    held = tokens.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("key")).alias("holders"), F.sum("rest").alias("r")).where("c > 1")
    first = held.groupBy("holders", "c").agg(F.max_by("token", F.struct("r", "token")).alias("first"))
    return tokens.join(first.select("first"), F.col("token") == F.col("first"), "left_semi")


def _pair_packs(pairs: DataFrame, parts: int) -> DataFrame:
    """Rows of pairs (a, b) as packs, dealt to parts by a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, part = (c.to_numpy(zero_copy_only=False).astype("<i8") for c in batch.columns)
            yield _pack([(p, 1, a[part == p], b[part == p]) for p in np.unique(part).tolist()])

    return pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(parts)).alias("part")).mapInArrow(run, PACK)


def _cross_packs(active: DataFrame, parts: int, percent: int) -> DataFrame:
    """The pairs between components that share a prefix n-gram, as packs.

    A token's holders are packed by classes of size in chunks of bounded length. Similar sets are in the
    same class or the next one, so each holder outside the largest component meets those chunks only;
    the pairs that sizes and positions allow are made there.
    """
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.lit(max(1e-9, 1.000001 * math.log(100 / percent)))).cast("int")
    active = active.withColumn("class", size_class)
    sizes = active.groupBy(F.col("token").alias("of"), F.col("class").alias("of_class")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = active.join(sizes, (F.col("token") == F.col("of")) & (F.col("class") == F.col("of_class"))).withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    chunks = dealt.groupBy("token", "class", "chunk").agg(F.collect_list(F.struct("key", "n", "rest", "root")).alias("held"))
    chunks = chunks.select(_apart(F.col("token")).alias("at"), F.col("class").alias("at_class"), "held")
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class")
    outside = active.where("root <> largest").select("token", "key", "n", "rest", "root", "largest", F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(("key", "n", "rest", "root", "largest", "part"))}
            held = batch.column(6)
            times = pc.list_value_length(held).to_numpy(zero_copy_only=False)
            k, n, rest, root, largest, part = (np.repeat(c.to_numpy(zero_copy_only=False), times) for c in cols.values())
            other = held.flatten()
            ok, on, orest, oroot = (other.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            keep = (root != oroot) & ((oroot == largest) | (k < ok)) & (np.minimum(rest, orest) * (100 + percent) >= percent * (n + on))
            pairs = np.unique(np.column_stack([part[keep], k[keep], ok[keep]]), axis=0)
            if len(pairs):
                yield _pack([(p, 1, pairs[pairs[:, 0] == p, 1].astype("<i8"), pairs[pairs[:, 0] == p, 2].astype("<i8")) for p in np.unique(pairs[:, 0]).tolist()])

    met = outside.join(chunks, (F.col("token") == F.col("at")) & (F.col("class") == F.col("at_class")))
    return met.select("key", "n", "rest", "root", "largest", "part", "held").mapInArrow(run, PACK)


def _links(alive: DataFrame, packs: DataFrame, parts: int, fragments: int, percent: int) -> DataFrame:
    """a, b of the pairs that are similar: overlaps are counted in each fragment, then summed for each pair."""
    packs = written(packs, "pair-packs")

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, list[np.ndarray]] = {}
            for part, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.setdefault(part, []).extend([np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")])
            for part, blobs in found.items():
                names = np.unique(np.concatenate(blobs))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), part, np.int64)), pa.array(names)], names=["part", "need"])

    needed = written(packs.select("cell", "a", "b").mapInArrow(keys, "part long, need long").distinct(), "needed")
    needed = F.broadcast(needed) if needed.count() <= BROADCAST_KEYS else needed
    nodes = alive.join(needed, F.col("key") == F.col("need")).select("part", "key", "n", "hashes")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, key, n, blobs = (c.to_pylist() for c in batch.columns)
            if part:
                lengths = np.array([len(b) // 8 for b in blobs])
                flat = np.frombuffer(b"".join(blobs), "<u8")
                owner = np.repeat(np.arange(len(key)), lengths)
                cell = np.array(part, np.int64)[owner] * fragments + _fragment(flat, fragments)
                yield _pack(_deal(cell, owner, flat, None, np.array(key, np.int64), np.array(n, np.int64)))

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield _pack([(part * fragments + f, 1, np.frombuffer(a, "<i8"), np.frombuffer(b, "<i8")) for f in range(fragments)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, kinds in _cells(batches):
            if 0 not in kinds or 1 not in kinds:
                continue
            names, sizes, counts, hashes = (_column(kinds[0], k, t) for k, t in enumerate(("<i8", "<i4", "<i4", "<u8")))
            a, b = (_column(kinds[1], k, "<i8") for k in (0, 1))
            order = np.argsort(names)
            place = [np.minimum(np.searchsorted(names, x, sorter=order), len(names) - 1) for x in (a, b)]
            here = np.all([names[order[p]] == x for x, p in zip((a, b), place, strict=True)], axis=0)
            codes = np.unique(order[place[0][here]].astype(np.int64) * len(names) + order[place[1][here]])
            i, j = codes // len(names), codes % len(names)
            tokens, local = np.unique(hashes, return_inverse=True)
            ends = np.cumsum(counts)
            begins = ends - counts
            mark = np.zeros(len(tokens), bool)
            common = np.zeros(len(i), np.int64)
            runs = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
            for lo, hi in zip(runs.tolist(), [*runs[1:].tolist(), len(i)], strict=True):
                own = local[begins[i[lo]] : ends[i[lo]]]
                mark[own] = True
                c = counts[j[lo:hi]]
                first = np.concatenate([[0], np.cumsum(c)[:-1]])
                at = np.repeat(begins[j[lo:hi]] - first, c) + np.arange(c.sum())
                common[lo:hi] = np.add.reduceat(mark[local[at]].astype(np.int64), first)
                mark[own] = False
            some = common > 0
            i, j, common = i[some], j[some], common[some]
            target = cell // fragments * fragments + (names[i] ^ names[j]) % fragments
            yield _pack(
                [(t, 2, names[i[m]], names[j[m]], (sizes[i[m]].astype("<i8") + sizes[j[m]]), common[m].astype("<i8")) for t in np.unique(target).tolist() if len(m := np.flatnonzero(target == t))]
            )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in _cells(batches):
            a, b, both, common = (_column(kinds[2], k, "<i8") for k in range(4))
            order = np.lexsort((b, a))
            a, b, both, common = a[order], b[order], both[order], common[order]
            new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            overlap = np.add.reduceat(common, new)
            linked = new[100 * overlap >= percent * (both[new] - overlap)]
            yield pa.RecordBatch.from_arrays([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])

    cells = nodes.mapInArrow(cut, PACK).unionByName(packs.select("cell", "a", "b").mapInArrow(copy, PACK)).repartitionById(parts * fragments, F.col("cell").cast("int"))
    sums = cells.mapInArrow(count, PACK).repartitionById(parts * fragments, F.col("cell").cast("int"))
    return written(sums.mapInArrow(total, "a long, b long"), "links")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = sh.SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: id, n_shingles (size of its set), component_id (the least id it is connected to).

    Sets are the different runs of size words, A-Z lower-cased and cut at ASCII white space; fewer
    words are one run. Two rows are linked when 100 * overlap >= percent * union. Rows without words,
    null texts among them, have an empty set and no links. Rows with equal sets are one node, so
    repeated rows cost nothing; a null id is nobody's least id unless all are null.
    """
    ship(docs.sparkSession)
    with passing_tables(docs.sparkSession) as lasting:
        labelled = lasting(_labelled(docs, id_col, text_col, size, percent), "labelled")
    least = labelled.where("label is not null").groupBy("label").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1")
    least = least.select(_apart(F.col("label")).alias("group"), "least")
    return labelled.join(least, F.col("label") == F.col("group"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id")
    )


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """id, n, label of each row: rows of one component have the same label, and no others; null without words."""
    sets = written(shingle_sets(docs, id_col, text_col, size), "shingle-sets")
    total = sets.where("set_key is not null").agg(F.sum("n").alias("n")).first()["n"] or 0
    fragments = max(12, math.ceil(total / FRAGMENT_HASHES))
    shared = _shared(_spread(docs, text_col, size, fragments), fragments, fragments)
    alive = written(_alive(shared, fragments, percent), "live-sets")
    # Later fragments hold what is alive, which is far less.
    few = max(6, math.ceil((alive.agg(F.sum(F.length("hashes"))).first()[0] or 0) / 8 / FRAGMENT_HASHES))

    tokens = written(_different(written(_prefixes(alive), "prefix-tokens")), "bucket-tokens")
    size_of_tokens = tokens.count()
    links = None
    held = tokens.withColumn("root", F.col("key"))
    for turn in range(MAX_TURNS):
        # Each token's holders against a few of them, others each turn; what is connected already is not compared.
        picks = [F.min_by(F.struct("key", "n", "rest", "root"), F.struct(F.xxhash64(F.col("key"), F.lit(turn), F.lit(i)), "key")) for i in range(PIVOTS if turn else 1)]
        pivots = (
            held.groupBy("token")
            .agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.array_distinct(F.array(*picks)).alias("ps"))
            .where("r0 <> r1")
            .select(_apart(F.col("token")).alias("at"), F.explode("ps").alias("p"))
            .select("at", F.col("p.key").alias("a"), F.col("p.n").alias("n_a"), F.col("p.rest").alias("rest_a"), F.col("p.root").alias("root_a"))
        )
        star = held.join(pivots, F.col("token") == F.col("at")).where(
            (F.col("root") != F.col("root_a")) & _possible(F.col("n_a"), F.col("rest_a"), F.col("n"), F.col("rest"), percent)
        )
        pairs = written(star.select("a", F.col("key").alias("b")).distinct(), "pairs")
        parts = max(1, math.ceil(pairs.count() / CELL_PAIRS))
        new = _links(alive, _pair_packs(pairs, parts), parts, few, percent)
        links = new if links is None else written(links.union(new), "links")
        roots = components(links)
        held = tokens.join(roots, F.col("key") == F.col("node"), "left").select("token", "key", "n", "rest", F.coalesce("root", "key").alias("root"))
        held = written(held, "held-tokens")
        by_root = held.groupBy("token", "root").agg(F.count("*").alias("c"))
        mixed = by_root.groupBy("token").agg(F.count("*").alias("roots"), F.sum("c").alias("all"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("largest")).where("roots > 1")
        open_tokens = written(mixed.select(F.col("token").alias("open"), "largest", (F.col("all") - F.col("most")).alias("outside"), "all"), "open-tokens")
        pairs_left = open_tokens.agg(F.sum(F.col("outside") * F.col("all"))).first()[0] or 0
        if pairs_left <= size_of_tokens:
            break

    # What is still apart: in each token, all pairs between different components; the largest one is not paired with itself.
    active = written(held.join(open_tokens.select("open", "largest"), F.col("token") == F.col("open")).drop("open"), "active-tokens")
    parts = max(1, math.ceil(pairs_left / CELL_PAIRS / 4))
    last = _links(alive, _cross_packs(active, parts, percent), parts, few, percent)
    roots = components(links.union(last))

    return sets.join(roots, F.col("set_key") == F.col("node"), "left").select("id", "n", F.coalesce("root", "set_key").alias("label"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), e AS (
  SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = w.doc_id
"""
