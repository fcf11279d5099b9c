"""Parquet tables in the order of a key, read by the files that hold the keys asked for.

A table is written in files by ranges of its key, a hot key over several of them, and beside it
one row a file: its first and last key. A search first finds the numbers of the files that its
keys meet, in tasks; only those numbers, at most one a file, reach the driver, and the scan
then names just these files. So what is read grows with the keys and not with the table,
whatever their number.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.operators.settle import shuffled

#: Rows of a file; a larger table has more files, not larger ones.
FILE_ROWS = 4_000_000


def write_ordered(df: DataFrame, path: str, key: str, order: list[str], rows: int | None = None) -> None:
    """``df`` under ``path``, in files by ranges of ``order`` (``key`` first), and the first and last ``key`` of each."""
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // FILE_ROWS))
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.mode("errorifexists").parquet(f"{path}/rows")
    written = spark.read.parquet(f"{path}/rows")
    ends = written.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key).alias("first"), F.max(key).alias("last"))
    ends.coalesce(1).write.parquet(f"{path}/files")  # one row a file


class Ordered:
    """A table of ``write_ordered``."""

    def __init__(self, spark: SparkSession, path: str, key: str):
        self.spark, self.path, self.key = spark, path, key
        self.rows = shuffled(spark.read.parquet(f"{path}/rows"))
        ends = sorted((r for r in spark.read.parquet(f"{path}/files").collect()), key=lambda r: (r["first"], r["last"]))  # one row a file
        self.files = [r.file for r in ends]
        self.firsts, self.lasts = ([bytes(x) if isinstance(x, bytearray) else x for x in column] for column in ([r["first"] for r in ends], [r["last"] for r in ends]))

    def met(self, keys: DataFrame) -> list[str]:
        """The files that hold a key of the ranges ``keys(low, high)``, both ends included."""
        firsts, lasts = self.firsts, self.lasts

        def numbers(parts):
            found: set[int] = set()
            for part in parts:
                for low, high in zip(part["low"], part["high"], strict=True):
                    low, high = (bytes(x) if isinstance(x, (bytes, bytearray)) else int(x) for x in (low, high))
                    at = bisect_left(lasts, low)
                    while at < len(firsts) and firsts[at] <= high:
                        found.add(at)
                        at += 1
            yield pd.DataFrame({"number": sorted(found)}, dtype="int64")

        wanted = keys.select("low", "high").where("low is not null").distinct().mapInPandas(numbers, "number long").distinct().collect()
        return [self.files[n] for n in sorted(r.number for r in wanted)]

    def meeting(self, keys: DataFrame) -> DataFrame:
        """The rows of the files that hold a key of the ranges ``keys(low, high)``."""
        files = self.met(keys)
        return shuffled(self.spark.read.schema(self.rows.schema).parquet(*files)) if files else self.rows.where(F.lit(False))
