"""Event-time streams: watermarked windows, first-seen frames, and batches of uploads by their latest attempt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, path: str, schema: str = EVENTS, files: int = 1) -> DataFrame:
    """Events from a folder of Parquet files, with ts as a time that watermarks can be put on."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, window_start, n for windows of a width; rows later than the watermark are left out."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.col("w.start").alias("window_start"), "n")


def sliding(events: DataFrame, width: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select("event_type", F.col("w.start").alias("window_start"), "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    counted = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def disk_store(spark: SparkSession) -> None:
    """State is kept in a store on disk, which holds what is beyond memory; its caches have one bound an executor."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")


def first_frames(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each frame of a run once (run, seq), however often it is replayed. What is known of them is kept on disk."""
    disk_store(frames.sparkSession)
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["run", "seq"])


def run_to_table(stream: DataFrame, path: str, checkpoint: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what there is, write every micro-batch as Parquet of its own below a path, and read the rows back.

    With keys the stream's rows are updates and the last one of each key counts; without, all are rows
    of their own. A batch that is run again replaces what it wrote before. Nothing goes through the driver.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/__batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode("update" if keys else "append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.lastProgress is None and not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("__batch", T.LongType())])).parquet(path)
    if not keys:
        return rows.drop("__batch")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "__batch").alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to a function, over what there is, and wait."""
    query = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
