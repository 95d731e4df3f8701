"""Connected components of a large edge list, by alternating star contraction.

Each round links neighbours to their least, first the larger and then the smaller, and is
written to the shared folder, which cuts the lineage and survives lost executors.
Rounds grow with the logarithm of the components' diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import work_dir


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame as a table in the shared folder."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every node's (larger, or smaller) neighbours to the least of them and itself."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), "a").alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not its component's least, and that least.

    ``edges`` has columns a and b of one ordered type; self-loops and repeats are
    allowed, nulls are not.  No edges give no rows.
    """
    current = written(edges.where("a <> b").distinct(), "links")
    while True:
        step = written(_star(_star(current, True), False), "stars")
        # A forest of stars: no node is both a leaf and a centre, no leaf has two centres.
        leaves = step.select(F.col("a").alias("leaf")).distinct()
        if (step.join(leaves, F.col("b") == F.col("leaf"), "left_semi").isEmpty()
                and step.groupBy("a").count().where("count > 1").isEmpty()):
            return step
        current = step
