"""A training corpus from raw documents: good texts, one of each kind, without benchmark passages, packed.

Each stage takes (spark, docs, sf_dir) and returns rows with the columns of documents, the last one
packed pieces. Between stages the rows are written as Parquet and read again, so that a stage's work is
done once and survives lost executors. Decisions are made on narrow tables and applied to the texts by
the keys of the rows to drop; those are broadcast while their size allows it and joined by a shuffle beyond.
A row's key is a number of its own, so that rows which share a doc_id, or have none, are told apart.

The same holds in all stages: other columns than doc_id and text are carried along, whatever their names
(but __locweave_row and __locweave_score, which are the pipeline's own); a null text counts as an empty
one; texts are read whole, however long; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locweave.llm import decontamination, exact_dedup, jaccard_join, packing, quality
from locweave.llm.columns import all_of, table, written

#: The column of row keys, written once and carried from stage to stage.
ROW = "__locweave_row"
SCORE = "__locweave_score"
#: Parts that the rows of a component are dealt to, to be told which one of them stays.
PARTS = 32
#: Ids to drop are broadcast up to this many: 8 bytes each.
BROADCAST_IDS = 1_000_000

#: SQL can't express the trained classifier, so the stages are tested against plain versions instead.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their keys, the same ones however often they are read.

    A row read from a file is known by the file and its place there, so a frame that is read from files
    row by row needs no copy; whether these keys tell all rows apart is counted. Any other frame is
    written with numbered rows first, as a second evaluation could number them otherwise.
    """
    if ROW in docs.columns:
        return docs
    try:
        placed = docs.withColumn(ROW, F.xxhash64("_metadata.file_path", "_metadata.row_index"))
        repeated = placed.groupBy(ROW).agg(F.count("*").alias("n")).where("n > 1")
        if repeated.isEmpty():
            return placed
    except AnalysisException:  # no files behind it
        pass
    return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "keyed")


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key isn't among the dropped ones. Rows of one key, or of none, go or stay together."""
    gone = written(dropped.select(F.col(key).alias("__gone")).distinct(), "dropped")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, docs[key].eqNullSafe(F.col("__gone")), "left_anti")


def order() -> Column:
    """What orders rows of one group: ids, a missing one last, and then the row's key."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("doc_id"), F.col(ROW).alias(ROW))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of documents outside the held-out fold.

    Each row is judged by its text alone: rows that share an id, or have none, may fare differently,
    repeated rows fare alike, and empty texts have the score of an empty text. Without labels all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model, name=SCORE).where(F.col(SCORE) >= quality.THRESHOLD).select(*all_of(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space, the longest as written.

    Ties go to the least id (a missing one last), then to the least row key, so exactly one row of a
    group stays, of wholly repeated rows too. Empty and null texts are one group.
    """
    rows = keyed(docs)
    groups = exact_dedup.exact_groups(rows.withColumn("__order", order()), id_col="__order")
    return without(rows, groups.where(~F.col("kept")).select(f"__order.{ROW}"), ROW).select(*all_of(docs))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.75, the one with the least id.

    Ties go to the least row key; a missing id is chosen last. Texts without words are connected with
    nothing and all stay.
    """
    rows = keyed(docs)
    groups = jaccard_join.similar_groups(rows, id_col=ROW).select(F.col(ROW).alias("__member"), "component_id")
    members = written(groups.join(rows.select(ROW, "doc_id"), F.col("__member") == F.col(ROW)).drop("__member"), "near-members")
    # The row that stays meets a component's others in parts, so that a large component is not one task.
    first = members.groupBy("component_id").agg(F.count("*").alias("n"), F.min(order())[ROW].alias("stays")).where("n > 1")
    first = first.select(F.col("component_id").alias("of"), "stays", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("of_part"))
    parted = members.withColumn("part", F.pmod(F.xxhash64(ROW), F.lit(PARTS)).cast("int"))
    dropped = parted.join(first, (F.col("component_id") == F.col("of")) & (F.col("part") == F.col("of_part"))).where(F.col(ROW) != F.col("stays"))
    return without(rows, dropped, ROW).select(*all_of(docs))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are benchmark passages.

    Each row is judged by itself; texts without words stay. With an empty benchmark all stay.
    """
    rows = keyed(docs)
    found = decontamination.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=ROW)
    return without(rows, found.where("contaminated"), ROW).select(*all_of(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens. Empty texts are one token; each repeated row is packed; row keys are dropped."""
    return packing.pack(docs)


STAGES = [
    ("quality", good),
    ("exact_dedup", exact),
    ("near_duplicates", near),
    ("decontamination", clean),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        docs = written(out if ROW in out.columns else out.withColumn(ROW, F.monotonically_increasing_id()), f"stage-{name}")
    return STAGES[-1][1](spark, docs.drop(ROW), sf_dir)
