"""A manifest of a dataset as a Merkle tree: digests, authentication paths and their check.

The rows of each part (a language, say) are the leaves of a tree of eight children a node, and the parts'
roots those of one more tree. Leaves are dealt out in aligned blocks of 4096. A block is walked by fractal
traversal: at each height one existing subtree has the digests of the present path, while a desired one,
of the node to the right, is fed a leaf a step and is whole when the walk comes to it. So a task holds a
few dozen digests above its leaves. What lies above the blocks is a small table a level, made by Spark,
and its paths are appended to those within the block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .columns import ascii_lower, passing_tables, ship, table, written

ARITY = 8
#: Levels within a block; 8^4 leaves are the most that a task gathers.
BLOCK_LEVELS = 4
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the values in turn, each its number of bytes, a colon and itself, or - where null."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in values)]
    return F.sha2(F.concat(*told), 256)


def digest_of(parts: Sequence[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


@dataclass
class _Growing:
    """The children of one node in the making: fed leaves in turn, it keeps what is not yet hashed at each height below."""

    height: int
    levels: list[list[str]] = field(init=False)

    def __post_init__(self) -> None:
        self.levels = [[] for _ in range(self.height + 1)]

    def feed(self, leaf: str) -> None:
        self.levels[0].append(leaf)
        for k in range(self.height):
            if len(self.levels[k]) < ARITY:
                return
            self._close(k)

    def _close(self, k: int) -> None:
        self.levels[k + 1].append(digest_of(self.levels[k]))
        self.levels[k].clear()

    def children(self) -> list[str]:
        """What it has grown to; runs that the end of the leaves cut short are closed as they are."""
        for k in range(self.height):
            if self.levels[k]:
                self._close(k)
        return self.levels[self.height]


def subtree_root(leaves: Sequence[str], height: int) -> str:
    """The digest of the node so many levels above a run of leaves that starts below it."""
    grown = _Growing(height)
    for leaf in leaves:
        grown.feed(leaf)
    return grown.children()[0]


def traverse(leaves: Sequence[str], height: int) -> Iterator[list[tuple[list[str], int]]]:
    """For each leaf in turn its path below the node of that height: by level the run of digests and the place in it."""
    spans = [ARITY ** (i + 1) for i in range(height)]
    existing, desired = [], []
    for i, span in enumerate(spans):
        first = _Growing(i)
        for leaf in leaves[:span]:
            first.feed(leaf)
        existing.append(first.children())
        desired.append(_Growing(i))
    for j in range(len(leaves)):
        yield [(existing[i], j // ARITY**i % ARITY) for i in range(height)]
        for i, span in enumerate(spans):
            if j + span < len(leaves):
                desired[i].feed(leaves[j + span])
            if (j + 1) % span == 0:
                existing[i], desired[i] = desired[i].children(), _Growing(i)


def fold(leaf: str, path: Sequence[tuple[Sequence[str], int]]) -> str:
    """The root that a leaf and the others of each run on its way give."""
    for run, place in path:
        leaf = digest_of([*run[:place], leaf, *run[place + 1 :]])
    return leaf


def siblings_of(path: Sequence[tuple[Sequence[str], int]]) -> list[str]:
    return [d for run, place in path for k, d in enumerate(run) if k != place]


def height_of(n: int) -> int:
    """Levels above n leaves; none above one."""
    height = 0
    while ARITY**height < n:
        height += 1
    return height


def _numbered(rows: DataFrame, part: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """The rows as a table with position (from 0, by order within the part), and the parts with their number n of rows.

    Rows are dealt by ranges of part and order, and by where they lay where these are equal, so that neither
    a large part nor a row often repeated is one task. Each range counts on from where the one before ends.
    """
    dealt = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(part, *order, "tie")
    ranged = written(dealt.withColumn("range", F.spark_partition_id()), f"{name}-ranges")
    sizes = ranged.groupBy(part, "range").agg(F.count("*").alias("size"))
    before = F.sum("size").over(Window.partitionBy(part).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col(part).alias("of"), F.col("range").alias("in"), F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy(part, "range").orderBy(*order, "tie")) - 1
    numbered = ranged.withColumn("within", within).join(starts, F.col(part).eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
    parts = sizes.groupBy(part).agg(F.sum("size").alias("n"))
    return numbered.select(*rows.columns, (F.col("start") + F.col("within")).alias("position")), parts


def _paths_up(nodes: DataFrame, most: int, name: str) -> DataFrame:
    """tree, node, path, top for nodes (tree, node, digest, size: the tree's nodes): path has the runs and places up to the tree's top.

    A table a level, of an eighth of the rows of the one below; most is the size of the largest tree.
    """
    level = written(nodes, f"{name}-level")
    paths = level.select("tree", "node", F.col("node").alias("at"), F.array().cast("array<struct<run:array<string>,place:int>>").alias("path"), F.col("digest").alias("top"))
    for _ in range(height_of(most)):
        run = F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda c: c["digest"])
        grouped = level.groupBy("tree", F.floor(F.col("node") / ARITY).alias("up")).agg(run.alias("run"), F.max("size").alias("size"))
        digest = F.when(F.col("size") > 1, F.sha2(F.array_join("run", ""), 256)).otherwise(F.col("run")[0])
        grouped = written(grouped.withColumn("digest", digest), f"{name}-runs")
        above = grouped.select(F.col("tree").alias("in_tree"), "up", "run", "size", F.col("digest").alias("higher"))
        step = F.array(F.struct(F.col("run"), F.pmod("at", F.lit(ARITY)).cast("int").alias("place")))
        joined = paths.join(above, (F.col("tree") == F.col("in_tree")) & (F.floor(F.col("at") / ARITY) == F.col("up")))
        longer = F.when(F.col("size") > 1, F.concat("path", step)).otherwise(F.col("path"))
        paths = joined.select("tree", "node", F.col("up").alias("at"), longer.alias("path"), F.col("higher").alias("top"))
        level = grouped.select("tree", F.col("up").alias("node"), "digest", F.ceil(F.col("size") / ARITY).cast("long").alias("size"))
    return written(paths.select("tree", "node", "path", "top"), f"{name}-paths")


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", part_col: str = "lang", seen: Column | None = None, with_siblings: bool = False) -> DataFrame:
    """One row per input row: id, leaf, subroot, root, proof_sha256, folded_root, verified; siblings too, if asked for.

    Leaves are digests of the fields (see leaf_digest), in each part by id; ids that are equal follow their
    digests, and a null id comes first. A null part is a part of its own, before the others. Eight nodes
    at a time give one above until one is left: the part's subroot; subroots in the order of the parts
    give root in the same way. A part of one row has its leaf for a subroot, a table of one part its subroot
    for a root, and an empty table no rows. Rows that repeat others are leaves like any others.

    seen gives the digest of a row as found later (null: as it was); folded_root is what that leaf and the
    row's siblings come to, and verified whether this is the root. Only digests and ids are shuffled, never
    the fields; other columns of the input are not looked at.
    """
    spark = docs.sparkSession
    ship(spark)
    leaf = leaf_digest([F.col(f) for f in fields])
    source = docs.select(F.col(id_col).alias("id"), F.col(part_col).cast("string").alias("part"), leaf.alias("leaf"), (F.lit(None).cast("string") if seen is None else seen).alias("seen"))
    id_type = source.schema["id"].dataType.simpleString()
    with passing_tables(spark) as lasting:
        placed, parts = _numbered(source, "part", ["id", "leaf"], "merkle")
        parts, _ = _numbered(parts.withColumn("one", F.lit(0)), "one", ["part"], "merkle-parts")
        parts = written(parts.select(F.col("part").alias("of"), "n", F.col("position").alias("tree")), "merkle-parts")
        blocked = placed.join(parts, F.col("part").eqNullSafe(F.col("of"))).select("tree", F.floor(F.col("position") / BLOCK).alias("node"), "position", "n", "id", "leaf", "seen")
        blocks = written(blocked, "merkle-blocks")

        def block_root(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("position")
            height, size = height_of(int(rows["n"].iloc[0])), -(-int(rows["n"].iloc[0]) // BLOCK)
            return pd.DataFrame({"tree": rows["tree"].iloc[:1], "node": rows["node"].iloc[:1], "digest": [subtree_root(list(rows["leaf"]), min(height, BLOCK_LEVELS))], "size": [size]})

        roots = blocks.select("tree", "node", "position", "n", "leaf").groupBy("tree", "node").applyInPandas(block_root, "tree long, node long, digest string, size long")
        largest, count = parts.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
        in_parts = _paths_up(roots, -(-largest // BLOCK), "merkle-blocks")
        subroots = in_parts.where("node = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), F.col("top").alias("digest"), F.lit(count).cast("long").alias("size"))
        to_root = _paths_up(subroots, count, "merkle-parts").select(F.col("node").alias("of_tree"), F.col("path").alias("last"), F.col("top").alias("root"))
        uppers = in_parts.join(to_root, F.col("tree") == F.col("of_tree")).select("tree", "node", F.concat("path", "last").alias("path"), F.col("top").alias("subroot"), "root")

        def prove(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("position")
            leaves, seen_leaves = list(rows["leaf"]), list(rows["seen"])
            upper = [(list(s["run"]), int(s["place"])) for s in above["path"].iloc[0]]
            subroot, root = above["subroot"].iloc[0], above["root"].iloc[0]
            out = []
            for leaf, later, path in zip(leaves, seen_leaves, traverse(leaves, min(height_of(int(rows["n"].iloc[0])), BLOCK_LEVELS)), strict=True):
                whole = path + upper
                siblings, folded = siblings_of(whole), fold(leaf if later is None else later, whole)
                row = (leaf, subroot, root, digest_of(siblings), folded, folded == root)
                out.append((*row, siblings) if with_siblings else row)
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in columns[1:]])
            frame.insert(0, "id", rows["id"].array)
            return frame

        columns = [f"id {id_type}", "leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean"]
        columns += ["siblings array<string>"] if with_siblings else []
        proved = blocks.groupBy("tree", "node").cogroup(uppers.groupBy("tree", "node")).applyInPandas(prove, ", ".join(columns))
        return lasting(proved.withColumnRenamed("id", id_col), "merkle")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of documents by language, and what it says of copies whose text was put in lower case where 3 divides crc32 of the id."""
    docs = table(spark, sf_dir, "documents")
    lowered = [ascii_lower(F.col(f)) if f == "text" else F.col(f) for f in FIELDS]
    drawn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    return manifest(docs, seen=F.when(drawn, leaf_digest(lowered)))


def _levels_sql(name: str, base: str, levels: int) -> str:
    """Levels of a tree above base (p, i, h), as SQL: <name><k> has each node with the others of its run."""
    frame = "(PARTITION BY p, i // 8 ORDER BY i ROWS BETWEEN {})"
    out = []
    for k in range(levels):
        nodes = base if k == 0 else f"(SELECT p, i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h FROM {name}{k - 1} GROUP BY p, i // 8)"
        left, right = frame.format("UNBOUNDED PRECEDING AND 1 PRECEDING"), frame.format("1 FOLLOWING AND UNBOUNDED FOLLOWING")
        out.append(f"""{name}{k} AS (SELECT p, i, h, count(*) OVER (PARTITION BY p) AS n,
  coalesce(string_agg(h, '') OVER {left}, '') AS l, coalesce(string_agg(h, '') OVER {right}, '') AS r FROM {nodes})""")
    return ",\n".join(out)


def _climb_sql(first: str, name: str, number: str, tree: str, levels: int) -> tuple[str, str]:
    """The rows of first (with proof and folded) taken up so many levels; what it gives is named by the second string."""
    out, at = [], first
    for k in range(levels):
        step = f"c_{name}{k}"
        out.append(f"""{step} AS (SELECT c.* REPLACE (CASE WHEN s.n > 1 THEN c.proof || s.l || s.r ELSE c.proof END AS proof,
  CASE WHEN s.n > 1 THEN sha256(s.l || c.folded || s.r) ELSE c.folded END AS folded)
  FROM {at} c JOIN {name}{k} s ON s.p = {tree} AND s.i = {number} // {8**k})""")
        at = step
    return ",\n".join(out), at


def _op13_sql(levels: int = 7, part_levels: int = 4) -> str:
    """SQL for up to 8^7 rows a part and 8^4 parts."""
    value = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
    number = lambda c: f"coalesce(length({c}::VARCHAR) || ':' || {c}, '-')"
    text = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda t: f"sha256({number('doc_id')} || {value('source')} || {value('lang')} || {number('n_chars')} || {value(t)})"
    crc = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)), lambda v, k: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)"""
    docs_up, docs_top = _climb_sql("d", "t", "c.i", "c.p", levels)
    parts_up, parts_top = _climb_sql(docs_top, "u", "c.p", "0", part_levels)
    return f"""
WITH d AS (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS p, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         leaf, leaf AS h, seen AS folded, '' AS proof
  FROM (SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(text)} ELSE {leaf("text")} END AS seen FROM documents)
),
{_levels_sql("t", "d", levels)},
sub AS (SELECT 0 AS p, p AS i, h FROM t{levels - 1}),
{_levels_sql("u", "sub", part_levels)},
{docs_up},
{parts_up}
SELECT c.doc_id, c.leaf, sub.h AS subroot, u.h AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root, c.folded = u.h AS verified
FROM {parts_top} c JOIN sub ON sub.i = c.p CROSS JOIN u{part_levels - 1} u
"""


OP13_SQL = _op13_sql()
