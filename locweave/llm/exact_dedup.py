"""Exact duplicates by progressive refinement: length, then a prefix hash, then a hash of the whole text.

Each level looks only at what the level before could not tell apart. Only fixed-width digests are
shuffled, never texts. The keys that survive a level reach the next one as a bitmap of fixed size; a
bit set by another key costs one needless look and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import table, text_or_empty, without_white, written

PREFIX_CHARS = 64
#: Bits of the bitmap of surviving groups: eight a group, so that few others pass, from 128 KB up to 32 MB. Beyond
#: that more and more texts are hashed that need not be; results are the same.
BITS_PER_GROUP = 8
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28
#: Bits in one row of the bitmap, as bitmap_construct_agg packs them.
ROW_BITS = 32768


def _slots(groups: int) -> Column:
    """How many bits the bitmap of so many groups has."""
    return F.lit(min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_GROUP * groups - 1).bit_length() if groups else 0)))


def _bitmap(keys: DataFrame, slot: Column) -> DataFrame:
    """32768 bits a row, a bit set for each key."""
    return (
        keys.select(slot.alias("slot"))
        .groupBy(F.floor(F.col("slot") / ROW_BITS).alias("bitmap_row"))
        .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(ROW_BITS))).alias("bitmap"))
    )


def _marked(frame: DataFrame, bitmap: DataFrame, slot: Column) -> DataFrame:
    """The frame with a boolean column survives: whether the row's bit is set."""
    position = F.pmod(slot, F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(position, F.lit(8)).cast("int"))) != 0
    joined = frame.join(F.broadcast(bitmap), F.floor(slot / ROW_BITS) == F.col("bitmap_row"), "left")
    return joined.select(*frame.columns, F.coalesce(bit, F.lit(False)).alias("survives"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, full_hash.

    Two texts are equal when they are the same after ASCII white space is deleted; a null text is an
    empty one. Of equal texts the one with the most code points stays, then the smallest id, so empty
    and null texts form one group. A repeated row counts in its group; every row that has the id to
    keep is kept. A null id orders last. full_hash is null where length or prefix already set a text
    apart, unless digest_all asks for the digest of those too. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    normal = source.select("id", F.length("body").alias("n_chars"), without_white(F.col("body")).alias("norm"))
    by_length, by_prefix = F.xxhash64("norm_len"), F.xxhash64("norm_len", "prefix_hash")
    facts = written(
        normal.select("id", "n_chars", F.length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash")),
        "exact-facts",
    )
    # Level 1: lengths that occur once are settled.
    lengths = written(facts.groupBy("norm_len").agg(F.count("*").alias("n")).where("n > 1"), "exact-lengths")
    slots = _slots(lengths.count())
    level_2 = _marked(facts, _bitmap(lengths, F.pmod(by_length, slots)), F.pmod(by_length, slots)).where("survives")
    # Level 2: of the others, prefixes that occur once at their length.
    prefixes = written(level_2.groupBy("norm_len", "prefix_hash").agg(F.count("*").alias("n")).where("n > 1"), "exact-prefixes")
    slots = _slots(prefixes.count())
    surviving = _bitmap(prefixes, F.pmod(by_prefix, slots))
    # Level 3: the whole text, for what is left.
    keyed = normal.withColumns({"norm_len": F.length("norm"), "prefix_hash": F.xxhash64(F.substring("norm", 1, PREFIX_CHARS))})
    full = F.unhex(F.sha2(F.col("norm"), 256))
    hashed = written(
        _marked(keyed, surviving, F.pmod(by_prefix, slots)).select(
            "id", "n_chars", "survives", (full if digest_all else F.when(F.col("survives"), full)).alias("full_hash")
        ),
        "exact-hashed",
    )
    # Counted by task first, so the largest group shuffles a row a task; its rows then meet it in a join that can be split.
    groups = (
        hashed.where("survives")
        .groupBy("full_hash")
        .agg(F.count("*").alias("group_size"), F.min(F.struct(-F.col("n_chars"), F.col("id").isNull(), F.col("id"))).alias("best"))
        .where("group_size > 1")
        .select(F.hex("full_hash").alias("group_key"), "group_size", F.col("best.id").alias("keep_id"))
    )
    member = F.when(F.col("survives"), F.hex("full_hash"))
    return hashed.join(groups, member == F.col("group_key"), "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("group_size").isNull() | (F.col("id").eqNullSafe(F.col("keep_id")))).alias("kept"),
        "full_hash",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), digest_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full_hash")).alias("text_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d
WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""
