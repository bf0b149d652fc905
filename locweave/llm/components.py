"""Connected components by contraction, as joins and aggregates over tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import passing_tables, written


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """node, root for every node with an edge: root is one node of its component, the same for all.

    Each round points every node to the least of itself and its neighbours and contracts the edges to
    the nodes pointed to, until none is left. A round is two tables in the shared folder.
    """
    spark = edges.sparkSession
    with passing_tables(spark) as lasting:
        return lasting(_contracted(edges, left, right), "components")


def _contracted(edges: DataFrame, left: str, right: str) -> DataFrame:
    edges = written(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v").distinct(), "edges")
    roots = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("to")), "step")
        if roots is None:
            roots = step.select(F.col("u").alias("node"), F.col("to").alias("root"))
        else:
            roots = roots.join(step, F.col("root") == F.col("u"), "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = written(roots, "roots")
        on_u = edges.join(step.withColumnRenamed("u", "from"), F.col("u") == F.col("from")).select(F.col("to").alias("u"), "v")
        on_v = on_u.join(step.withColumnRenamed("u", "from"), F.col("v") == F.col("from")).select("u", F.col("to").alias("v"))
        edges = written(on_v.where("u <> v").distinct(), "edges")
    if roots is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots
