"""Packing into length buckets whose boundaries minimise padding.

A global histogram of lengths goes through a dynamic program that chooses the bucket
boundaries with the least padding; inside each bucket, batches hold as many documents as the
token budget allows at the bucket's length. The histogram has one row per length up to
``2 ** PRECISION`` and then ``2 ** (PRECISION - 1)`` rows per doubling, so it stays small at
any input size; boundaries are lengths that occur.

``tokenized`` gives the ids of a tokenizer, ``pack`` places documents by their lengths, and
``padded_batches`` builds the batches themselves: ids of equal length and their masks.

A bucket is dealt into shards of about ``SHARD`` documents by a hash of doc_id, and batches
form inside a shard, so a bucket with most of the documents is many small groups.

Edge cases: a null or empty text has length 0 and goes to bucket 0 without a batch; a
document longer than the budget is a batch of its own; a null doc_id sorts first; documents
with equal ids each have their own slot; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.llm import scratch, textscan
from peptrail.llm.token_output import WordEncoder

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 16
BUDGET = 65_536
PRECISION = 9
SHARD = 50_000


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least total padding.

    ``lengths`` ascend. best[j] is the least cost of the first j lengths with the buckets so
    far; a bucket over lengths i..j-1 costs its documents times its longest length.
    """
    n = len(lengths)
    if not n:
        return []
    before = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    choices = []
    for _ in range(min(buckets, n)):
        after, choice = best.copy(), np.full(n + 1, -1)
        for j in range(1, n + 1):
            cost = best[:j] + (before[j] - before[:j]) * lengths[j - 1]
            i = int(cost.argmin())
            if cost[i] < after[j]:
                after[j], choice[j] = cost[i], i
        choices.append(choice)
        best = after
    cuts, j = [], n
    for choice in reversed(choices):
        if choice[j] >= 0:
            cuts.append(int(lengths[j - 1]))
            j = int(choice[j])
    return cuts[::-1]


def _bin(length: Column) -> Column:
    """Lengths rounded up to ``PRECISION`` significant bits; the smaller ones are exact."""
    shift = F.greatest(F.floor(F.log2(length)) - (PRECISION - 1), F.lit(0)).cast("int")
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.when(length < (1 << PRECISION), length).otherwise(F.ceil(length / step) * step)


def _placed(sized: DataFrame, buckets: int, budget: int, shard: int) -> DataFrame:
    """``sized(doc_id, n_tokens, …)`` with bucket, bucket_len, shard, the place ``nth`` in the shard, and ``room``, the rows of a batch."""
    rows = sized.where("n_tokens > 0").groupBy(_bin(F.col("n_tokens")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.max("n_tokens").alias("longest")).collect()  # a histogram of bounded size
    rows.sort(key=lambda r: r.longest)
    tops = boundaries(np.array([r.longest for r in rows], dtype=np.float64), np.array([r.n for r in rows]), buckets)
    n = [sum(r.n for r in rows if low < r.longest <= top) for low, top in zip([0, *tops], tops, strict=False)]
    table = [(0, 1, 1), *((top, max(1, budget // top), 1 + k // shard) for top, k in zip(tops, n, strict=True))]
    lens, room, shards = (F.array(*(F.lit(x[i]).cast("long") for x in table)) for i in range(3))
    bucket = F.when(F.col("n_tokens") > 0, F.lit(len(tops) + 1) - F.size(F.filter(F.array(*(F.lit(t).cast("long") for t in tops)) if tops else F.array().cast("array<long>"), lambda t: t >= F.col("n_tokens")))).otherwise(0)
    at = F.col("bucket") + 1
    placed = sized.withColumn("bucket", bucket.cast("int")).withColumn("bucket_len", F.element_at(lens, at)).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.element_at(shards, at)))
    nth = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    return placed.withColumn("nth", nth).withColumn("room", F.element_at(room, at))


def pack(spark: SparkSession, docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD, length: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, bucket (from 1), bucket_len, batch, slot, padding.

    Lengths are the words of ``text``, or another ``length``, such as that of the ids of ``tokenized``.
    """
    words = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)) if length is None else length
    sized = scratch.save(spark, docs.select(docs["doc_id"].cast("long").alias("doc_id"), words.cast("long").alias("n_tokens")), "lengths")
    batch = F.concat_ws("-", "bucket", "shard", F.floor(F.col("nth") / F.col("room")))
    in_batch = F.col("bucket") > 0
    return _placed(sized, buckets, budget, shard).select(
        "doc_id",
        "n_tokens",
        "bucket",
        "bucket_len",
        F.when(in_batch, batch).alias("batch"),
        F.when(in_batch, F.pmod("nth", "room")).alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


_encoders: dict[str, WordEncoder] = {}


def _encoded(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        if tokenizer not in _encoders:  # Python workers are reused, and so are the words they know
            _encoders[tokenizer] = WordEncoder(tokenizer)
        for batch in batches:
            at = 0
            for block in textscan.blocks(batch.column("text"), 8 * textscan.BLOCK):
                ids, per_row = _encoders[tokenizer].block(block)
                ends = np.cumsum(per_row)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(per_row)), lists], ["doc_id", "ids"])
                at += len(per_row)

    return run


def tokenized(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per row: doc_id, ids (those of the whole text and the end id), written to the shared folder; a null text has the end id alone."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return scratch.save(spark, rows.mapInArrow(_encoded(tokenizer), "doc_id long, ids array<int>"), "ids")


def padded_batches(tokens: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard: int = SHARD, pad: int = 0) -> DataFrame:
    """A row a batch of ``tokens(doc_id, ids)``: batch, bucket, bucket_len, doc_ids, and in their order ids and mask, a list of ``bucket_len`` each.

    Batches hold up to ``budget`` ids with padding, a longer document alone. They are those of
    ``pack`` with ``length=F.size("ids")``; their rows are in its order of slots. Rows without ids
    are in none. Ids are shuffled once: a shard's batches are put together where it was numbered.
    """
    sized = tokens.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")
    placed = _placed(sized, buckets, budget, shard).where("bucket > 0").withColumn("batch", F.floor(F.col("nth") / F.col("room")))
    short = (F.col("bucket_len") - F.col("n_tokens")).cast("int")
    row = F.struct("nth", "doc_id", F.concat("ids", F.array_repeat(F.lit(pad), short)).alias("ids"), F.concat(F.array_repeat(F.lit(True), F.col("n_tokens").cast("int")), F.array_repeat(F.lit(False), short)).alias("mask"))
    rows = placed.groupBy("bucket", "shard", "batch", "bucket_len").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    lists = [F.col(f"rows.{name}").alias(out) for name, out in (("doc_id", "doc_ids"), ("ids", "ids"), ("mask", "mask"))]
    return rows.select(F.concat_ws("-", "bucket", "shard", "batch").alias("batch"), "bucket", "bucket_len", *lists)
