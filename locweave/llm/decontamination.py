"""Benchmark passages in documents: a prefix-filtered set join on word shingles, then exact comparison.

A benchmark item is cut into windows. A window can only occur where all its shingles do, so one of
them is enough to find it by (for a required overlap of everything the prefix is one shingle long):
the one that documents hold least often. A document's shingles are joined with these; a match fixes
where the window must start, bounds drop what does not fit, and the words themselves decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import ascii_lower, table, text_or_empty, written

WINDOW_WORDS = 13
SHINGLE_WORDS = 5
#: Windows are broadcast up to so many bytes of words and ids; above, the join is shuffled.
BROADCAST_BYTES = 16 << 20

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The arrays below are never empty, so the outer generators give the same rows; the plain ones would
# make the optimiser test the size of each array by a second evaluation of all that makes it.

#: Stands before a document's shingles, so that one without a match has a row too.
MARK = 0


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), SEPARATORS), "")


def _hash(words: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(words, at + j) for j in range(size)])


def _shingles(words: Column, size: int) -> Column:
    """The hashes of all runs of so many words, in order."""
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: _hash(words, i, size))).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Each different window once: win_id, win, win_len, items (the ids of its items as strings)."""
    words = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(text_or_empty(text_col)).alias("words"))
    n = F.size("words")
    starts = F.when(n > window, F.sequence(F.lit(1), n - window + 1)).otherwise(F.array(F.lit(1)))
    windows = words.where(n > 0).select("item", F.explode_outer(F.transform(starts, lambda s: F.slice(F.col("words"), s, window))).alias("win"))
    return windows.groupBy(F.md5(F.array_join("win", " ")).alias("win_id")).agg(
        F.first("win").alias("win"), F.first(F.size("win")).alias("win_len"), F.collect_set("item").alias("items")
    )


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
    broadcast_bytes: int = BROADCAST_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, items (sorted), contaminated.

    Words are runs of digits, letters and characters beyond ASCII, after A-Z is lower-cased. A word is
    hit if it lies in an occurrence of a window; a row is contaminated if words are hit and they are a
    twentieth of its words at least. Null and empty texts have no words and no hits. Items without
    words match nothing; a null item id is an empty string; equal items are all named. Repeated rows
    and null ids are rows like any other.
    """
    windows = written(item_windows(items, window, item_col, text_col), "item-windows")
    facts = windows.agg(
        F.sum(F.aggregate("win", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16)).alias("a"),
        F.sum(F.aggregate("items", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16)).alias("b"),
        F.sort_array(F.collect_set(F.least("win_len", F.lit(shingle))), asc=False).alias("sizes"),
    ).first()
    small = (facts["a"] or 0) + (facts["b"] or 0) <= broadcast_bytes
    sizes = list(facts["sizes"]) or [shingle]
    hinted = F.broadcast if small else (lambda frame: frame)

    source = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body")).withColumn("row", F.monotonically_increasing_id())
    if not small:
        source = written(source, "decontaminate-docs")
    texts = source.select("row", "id", words_of(F.col("body")).alias("words"))
    shingled = texts.select(
        "row", "id", "words", F.size("words").alias("n"), F.concat(F.array(F.lit(MARK).cast("long")), *[_shingles(F.col("words"), k) for k in sizes]).alias("hashes")
    )

    # How often documents hold each shingle of a window: the order by rarity.
    size = F.least("win_len", F.lit(shingle))
    hashes = F.coalesce(*[F.when(size == k, _shingles(F.col("win"), k)) for k in sizes])
    of_windows = windows.select("win_id", "win", "win_len", "items", size.alias("size"), F.posexplode_outer(hashes).alias("offset", "hash"))
    wanted = of_windows.select(F.col("hash").alias("wanted")).distinct()
    held = (
        shingled.select(F.explode_outer("hashes").alias("held"))
        .join(hinted(wanted), F.col("held") == F.col("wanted"))
        .groupBy("held")
        .agg(F.count("*").alias("n_held"))
    )
    # The prefix of a window is its rarest shingle; one that no document holds ends the matter.
    rarest = of_windows.join(hinted(held), F.col("hash") == F.col("held")).groupBy("win_id").agg(
        F.count("*").alias("n_found"), F.min_by(F.struct("hash", "offset", "size", "win", "win_len", "items"), F.struct("n_held", "hash", "offset")).alias("m")
    )
    prefix = rarest.where(F.col("n_found") == F.col("m.win_len") - F.col("m.size") + 1).select("win_id", "m.*")
    mark = docs.sparkSession.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "hash" else F.lit(MARK).cast("long").alias("hash") for f in prefix.schema]
    )
    prefix = written(prefix.unionByName(mark), "window-prefixes")

    # Where each match puts its window.
    at = F.col("pos") - 1
    begin: Column = F.lit(None).cast("int")
    before: Column = F.lit(0)
    for k in sizes:
        runs = F.greatest(F.col("n") - k + 1, F.lit(0))
        begin = F.when((F.col("size") == k) & (at >= before) & (at < before + runs), at - before - F.col("offset")).otherwise(begin)
        before = before + runs
    marked = F.col("win_id").isNull() & (F.col("pos") == 0)
    fits = (F.col("pos") > 0) & (F.col("start") >= 0) & (F.col("start") + F.col("win_len") <= F.col("n"))
    same = F.slice(F.col("words"), F.col("start") + 1, F.col("win_len")) == F.col("win")
    names = ["row", "id", "n"] + (["words"] if small else [])
    spread = shingled.select(*names, F.posexplode_outer("hashes").alias("pos", "found"))
    found = spread.join(hinted(prefix), F.col("found") == F.col("hash")).withColumn("start", F.when(F.col("pos") > 0, begin))
    found = found.where(marked | fits)
    if small:
        found = found.where(marked | same)
    else:
        found = found.alias("f").join(texts.select(F.col("row").alias("text_row"), "words"), F.col("row") == F.col("text_row"))
        found = found.where(marked | same)
    hit = F.when(F.col("win_id").isNotNull(), F.struct("start", (F.col("start") + F.col("win_len")).alias("end")))
    by_row = found.groupBy("row").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.sort_array(F.collect_set(hit)).alias("hits"), F.collect_set("items").alias("items"))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit"))
    covered = F.aggregate(
        "hits",
        zero,
        lambda a, h: F.struct(
            F.greatest(a["end"], h["end"]).alias("end"), (a["hit"] + F.greatest(h["end"] - F.greatest(a["end"], h["start"]), F.lit(0))).alias("hit")
        ),
        lambda a: a["hit"],
    )
    return by_row.select(
        F.col("id").alias(id_col),
        F.col("n").cast("long").alias("n_words"),
        covered.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


OP3_SQL = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), dw AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), iwin AS (
  SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM iw WHERE len(w) > 0)
), dwin AS (
  SELECT doc_id, l, s, array_to_string(w[s:s + l - 1], ' ') AS k
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM dw, (SELECT DISTINCT l FROM iwin) WHERE len(w) >= l)
), m AS (
  SELECT doc_id, item, s, l FROM dwin JOIN iwin USING (l, k)
), h AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN i ON i.doc_id = dw.doc_id
"""
