"""Cutting lineage and numbering rows without a single-task sort."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A per-partition table up to this many rows is broadcast; one row is a few dozen bytes.
BROADCAST_ROWS = 100_000


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder; a temporary folder is taken only in local mode, where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="peptrail-")
        spark.sparkContext.setCheckpointDir(where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Settled tables since the last ``dropped_after`` began, of each thread that is inside one.
_inside = threading.local()


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` of files, which the planner will not broadcast of its own accord: it knows their compressed size only, and the
    driver would collect millions of rows for a few MB of repeated text. What is broadcast is named by ``F.broadcast``."""
    return df.hint("merge")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder and read back, so later plans read only their columns; see ``shuffled``."""
    path = shared_path(df.sparkSession, "settled")
    df.write.parquet(path)
    if getattr(_inside, "paths", None) is not None:
        _inside.paths.append(path)
    return shuffled(df.sparkSession.read.schema(df.schema).parquet(path))


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that this thread settles inside the block; results must be written in it."""
    _inside.paths = []
    try:
        yield
    finally:
        paths, _inside.paths = _inside.paths, None
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def running_sum(df: DataFrame, keys: list[str], value: Column, name: str, first: int = 0) -> DataFrame:
    """``df``, whose ``keys`` are distinct, with the sum of ``value`` over the rows before each as ``name``.

    Rows are dealt out by ranges, summed in each range, and each range starts where the ones
    before it end: one sum per partition is all that comes together.
    """
    shards = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(df.withColumn("_value", value).repartitionByRange(shards, *keys).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.sum("_value").alias("_n"))
    before = sizes.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.lit(first)).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1))
    started = dealt.withColumn("_nth", F.coalesce(inside, F.lit(0))).join(F.broadcast(before) if shards <= BROADCAST_ROWS else before, "_part")
    return started.withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before", "_value")


def numbered(df: DataFrame, keys: list[str], name: str, first: int = 0) -> DataFrame:
    """``df``, whose ``keys`` are distinct, with their rank in ascending byte order as ``name``."""
    return running_sum(df, keys, F.lit(1).cast("long"), name, first)


def ordered_lines(df: DataFrame, columns: list[Column], name: str) -> DataFrame:
    """Rows of a file source with their place, from 0, in the order of files and of lines in them."""
    meta = df.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = meta.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_lo"))
    run = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))  # one row a split
    splits = splits.select("_file", "_block", "_lo", F.coalesce(run, F.lit(0)).alias("_before"))
    return meta.join(splits, ["_file", "_block"]).withColumn(name, F.col("_before") + F.col("_id") - F.col("_lo")).drop("_file", "_block", "_id", "_lo", "_before")
