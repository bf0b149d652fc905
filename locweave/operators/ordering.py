"""Places in a whole order: each row's number when all rows are sorted, without a task that has them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import scratch


def placed(rows: DataFrame, order: list[Column], name: str = "place", first: int = 1) -> DataFrame:
    """The rows with their place in the order as a long.

    Rows are dealt by ranges of the order, each range is numbered by itself, and goes on from where the one before
    ends: what is gathered is a row a range. Rows with equal keys are dealt by where they lay, so that many of
    them are many tasks; among each other their places are any. The ranges are written to the shared folder
    once, so that all that follows sees the same ones.
    """
    spark = rows.sparkSession
    mark = "__"
    while any(c.lower().startswith(mark) for c in rows.columns):
        mark += "_"
    tie, held_in, within, of, size = (mark + n for n in ("tie", "range", "within", "of", "size"))
    dealt = rows.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, F.col(tie)).withColumn(held_in, F.spark_partition_id())
    path = scratch(spark, "placed")
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    sizes = held.groupBy(F.col(held_in).alias(of)).agg(F.count("*").alias(size))
    before = F.coalesce(F.sum(size).over(Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = held.withColumn(within, F.row_number().over(Window.partitionBy(held_in).orderBy(*order, F.col(tie))))
    joined = numbered.join(F.broadcast(sizes.select(of, before.alias(size))), F.col(held_in) == F.col(of))
    return joined.select(*[F.col("`" + c.replace("`", "``") + "`") for c in rows.columns], (F.col(size) + F.col(within) + F.lit(first - 1)).alias(name))
