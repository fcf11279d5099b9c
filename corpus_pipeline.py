"""Training-data pipeline: quality, near-duplicates, repeated passages, mixing, packing.

Each stage takes all rows that the stage before kept and writes Parquet to the folder that
the cluster shares. Columns beyond those of documents are carried along, whatever their
names; an empty table passes every stage as an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch
from peptrail.llm.mixing import mixed
from peptrail.llm.near_dedup import near_duplicates
from peptrail.llm.packing import pack
from peptrail.llm.substring_dedup import substring_dedup
from peptrail.llm.quality import keep_good


def _rows(docs: DataFrame) -> DataFrame:
    """``(id, text_key, row)``: what operators name rows by, and all columns in a struct of its own names."""
    row = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    return docs.select(docs["doc_id"].cast("long").alias("id"), F.xxhash64(F.coalesce(docs["text"], F.lit(""))).alias("text_key"), row.alias("row"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["text_key"] == b["text_key"])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model of trusted text does not reject.

    A null text and one without words are kept, and so is everything where no text is trusted;
    equal rows stay or go together.
    """
    return keep_good(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that with the smallest doc_id (null: the largest).

    Null texts and texts without words are in no class; of equal rows of doc_id and text one
    stays; different texts under one doc_id, or none, are documents of their own.
    """
    kept = near_duplicates(spark, docs).where("kept").select(F.col("doc_id").alias("id"), "text_key").distinct()
    rows = _rows(docs)
    one = rows.join(kept, _same(rows, kept), "left_semi").dropDuplicates(["id", "text_key"])
    return one.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that start in an earlier document; ``n_chars`` follows the text.

    Every row stays, with an empty text where all of it is repeated; a text that loses nothing,
    a null one too, stays as it is; rows that share a doc_id remove nothing from each other.
    """
    edits = substring_dedup(spark, docs).where("n_removed > 0").select(F.col("doc_id").alias("id"), "text_key", "kept_text").dropDuplicates(["id", "text_key"])
    rows = _rows(docs)
    joined = rows.join(edits, _same(rows, edits), "left").select("row", "kept_text")
    column = {c: F.col(f"row.c{i}") for i, c in enumerate(docs.columns)}
    column["text"] = F.coalesce("kept_text", column["text"])
    column["n_chars"] = F.when(F.col("kept_text").isNotNull(), F.length("kept_text")).otherwise(column["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return joined.select(*(value.alias(c) for c, value in column.items()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null or empty text has size 0 and is taken by its hash like any other; a null source is a
    source of its own; rows that share a doc_id stand or fall together.
    """
    return mixed(spark, docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bucket, batch and slot of every document.

    A null or empty text is in bucket 0 and in no batch; equal rows have slots of their own.
    """
    return pack(spark, docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("mixing", mixing), ("packing", packing)]

#: Perplexities and consistent weighted samples cannot be expressed in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(spark, stage(spark, docs, sf_dir), name)
    return docs
