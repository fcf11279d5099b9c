"""Connected components over an edge table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every node of ``edges(src, dst)``; the smallest id names it.

    Each round takes the least label among a node's neighbours and then that label's own
    label, so the rounds grow with the logarithm of a path's length. Every round is written
    to the shared folder; no edges and no labels reach the driver. An empty edge table gives
    an empty result; loops and repeated edges change nothing.
    """
    one = edges.select("src", "dst").where("src <> dst")
    both = scratch.save(spark, one.union(one.select("dst", "src")).distinct(), "edges")
    labels = scratch.save(spark, both.groupBy(F.col("src").alias("id")).agg(F.least(F.col("src"), F.min("dst")).alias("component")), "labels0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("near"))
        pulled = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("id").alias("mid"), F.col("component").alias("far"))
        after = scratch.save(spark, pulled.join(jump, "mid").select("id", "was", F.least("mid", "far").alias("component")), f"labels{step}")
        scratch.drop(spark, labels)
        labels = after.select("id", "component")
        if after.where("was <> component").isEmpty():
            scratch.drop(spark, both)
            return labels
