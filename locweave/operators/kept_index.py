"""A kept index of first locs: uploads come one after another, in any order, and each costs what it touches.

The index is a table of the first place of each key, partitioned by slots of the keys and bucketed by key. An upload
reads only the slots that its keys fall into and joins them without moving them: the new side is brought to the
buckets. What it changes is written back slot by slot. Where an earlier file comes late, the loc that was kept
until then is told as retracted.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..shipping import scratch

SLOTS, BUCKETS = 16, 8
PLACE = ("file_idx", "loc_idx")


def slot_of(key: Column, slots: int) -> Column:
    """Which slot a key is in; by another hash than that of buckets."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


@contextlib.contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass
class KeptIndex:
    """An index in a table of the session's catalog, kept below a path."""

    spark: SparkSession
    table: str
    path: str
    slots: int
    buckets: int

    def rows(self) -> DataFrame:
        """key, file_idx, loc_idx, source_file, loc: the survivors of all uploads so far."""
        return self.spark.table(self.table).select("key", *PLACE, "source_file", "loc")

    def incoming(self, locs: DataFrame, exact: bool = False) -> DataFrame:
        """The first loc of each key of an upload, with its slot; found by a partial aggregate, so that no key is a task of its own."""
        key = F.col("loc") if exact else urls.dedup_key(F.col("loc"))
        first = locs.where("loc IS NOT NULL").groupBy(key.alias("key")).agg(F.min_by(F.struct("source_file", "loc"), F.struct(*PLACE)).alias("told"), F.min(F.struct(*PLACE)).alias("place"))
        return first.select("key", "place.*", "told.*", slot_of(F.col("key"), self.slots).alias("slot"))

    def compared(self, new: DataFrame, slots: list[int]) -> DataFrame:
        """The upload's firsts beside those of the index: old_file_idx and so on are null where a key is new. The index does not move."""
        held = self.spark.table(self.table).where(F.col("slot").isin(slots))
        old = held.select(F.col("key").alias("old_key"), *[F.col(c).alias(f"old_{c}") for c in (*PLACE, "source_file", "loc")])
        # The session's threshold might broadcast a small index, which is a copy of it to all tasks.
        return new.join(old.hint("merge"), F.col("key") == F.col("old_key"), "left")

    def upload(self, locs: DataFrame, exact: bool = False) -> DataFrame:
        """Take in an upload (file_idx, loc_idx, source_file, loc) and tell what it does: change, key, file_idx, loc_idx, source_file, loc.

        kept: a loc that survives now; retracted: one that did until now. The others of the upload are duplicates (see
        duplicates). An upload that is sent again changes nothing. Null locs are left out. The index is not locked:
        one upload at a time.
        """
        # With more shuffle partitions than buckets Spark would rather move both sides; only touched slots are overwritten.
        with _settings(self.spark, {"spark.sql.shuffle.partitions": str(self.buckets), "spark.sql.sources.partitionOverwriteMode": "dynamic"}):
            return self._upload(locs, exact)

    def _upload(self, locs: DataFrame, exact: bool) -> DataFrame:
        new_path = scratch(self.spark, "upload")
        self.incoming(locs, exact).write.parquet(new_path)
        new = self.spark.read.parquet(new_path)
        slots = sorted(r[0] for r in new.select("slot").distinct().collect())  # as many as there are slots at most
        both = self.compared(new, slots)
        earlier = F.col("old_key").isNull() | (F.struct(*PLACE) < F.struct(*[F.col(f"old_{c}").alias(c) for c in PLACE]))
        changed_path = scratch(self.spark, "upload-changes")
        both.where(earlier).write.parquet(changed_path)
        changed = self.spark.read.schema(both.schema).parquet(changed_path)
        touched = sorted(r[0] for r in changed.select("slot").distinct().collect())
        if touched:
            old = self.spark.table(self.table).where(F.col("slot").isin(touched))
            left = old.join(changed.select(F.col("key").alias("gone")).hint("shuffle_merge"), F.col("key") == F.col("gone"), "left_anti")
            columns = ["key", *PLACE, "source_file", "loc", "slot"]
            whole = left.select(*columns).unionByName(changed.select(*columns))
            # A table cannot be written while it is read: the touched slots are made apart, then put in their place.
            apart = f"{self.table}_{uuid.uuid4().hex[:8]}"
            self._write(whole, apart, scratch(self.spark, "slots"))
            self.spark.table(apart).select(*columns).write.insertInto(self.table, overwrite=True)
            self.spark.sql(f"DROP TABLE {apart}")
        kept = changed.select(F.lit("kept").alias("change"), "key", *PLACE, "source_file", "loc")
        retracted = changed.where("old_key IS NOT NULL").select(F.lit("retracted").alias("change"), "key", *[F.col(f"old_{c}").alias(c) for c in (*PLACE, "source_file", "loc")])
        return kept.unionByName(retracted)

    def duplicates(self, locs: DataFrame, exact: bool = False) -> DataFrame:
        """file_idx, loc_idx, source_file, url, kept_in of the locs that the index does not keep, as it is now."""
        key = F.col("loc") if exact else urls.dedup_key(F.col("loc"))
        first = self.rows().select(F.col("key").alias("of"), F.struct(*PLACE).alias("first"), F.col("source_file").alias("kept_in"))
        joined = locs.where("loc IS NOT NULL").withColumn("key", key).join(first, F.col("key") == F.col("of"))
        return joined.where(F.struct(*PLACE) != F.col("first")).select(*PLACE, "source_file", F.col("loc").alias("url"), "kept_in")

    def _write(self, rows: DataFrame, table: str, path: str) -> None:
        dealt = rows.repartition(self.buckets, "key")
        dealt.write.partitionBy("slot").bucketBy(self.buckets, "key").sortBy("key").option("path", path).format("parquet").saveAsTable(table)


def create(spark: SparkSession, table: str, path: str, slots: int = SLOTS, buckets: int = BUCKETS) -> KeptIndex:
    """A new index, or the one that is kept below the path already, as a table of the session's catalog.

    For 100 TB set as many slots as uploads should leave alone, and buckets for what a task holds of a slot. Both are fixed
    once the index exists: another session must name the same ones.
    """
    index = KeptIndex(spark, table, path, slots, buckets)
    if not spark.catalog.tableExists(table):
        spark.sql(
            f"CREATE TABLE {table} (key STRING, file_idx LONG, loc_idx LONG, source_file STRING, loc STRING, slot INT) USING parquet "
            f"PARTITIONED BY (slot) CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place):  # also where it is there already
            spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
    return index
