"""Proteins, taxonomy and peptides derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.operators.settle import shuffled

PEPTIDES = ("BOLT", "BOIT", "ANVIL", "WIDGET", "LL", "I", "widget\n", "ZZZZ", "BOLT")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows if name in ("region", "nation") else shuffled(rows)


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    fa = F.concat(F.lit("EC:1."), (F.col("p_size") % 7).cast("string"), F.lit(".1.-;GO:"), F.lpad((key % 50).cast("string"), 7, "0"), F.lit(";IPR:IPR"), F.lpad(F.col("p_size").cast("string"), 6, "0"))
    return part.select((key - 1).cast("long").alias("protein_idx"), F.concat(F.lit("P"), F.lpad(key.cast("string"), 6, "0")).alias("uniprot_id"), (100 + key % 25).cast("long").alias("taxon_id"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"), fa.alias("fa"))


def taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda df, i, name, rank, parent, valid=None: df.select(i.cast("long").alias("id"), name.alias("name"), F.lit(rank).alias("rank"), parent.cast("long").alias("parent"), (F.lit(True) if valid is None else valid).alias("valid"))
    c = F.col
    root = row(spark.range(1), F.lit(1), F.lit("root"), "no rank", F.lit(1))
    regions = row(read(spark, sf_dir, "region"), 10 + c("r_regionkey"), c("r_name"), "superkingdom", F.lit(1))
    nations = row(read(spark, sf_dir, "nation"), 100 + c("n_nationkey"), c("n_name"), "genus", 10 + c("n_regionkey"), c("n_nationkey") % 7 != 0)
    suppliers = row(read(spark, sf_dir, "supplier"), 1000 + c("s_suppkey"), c("s_name"), "species", 100 + c("s_nationkey"))
    return root.union(regions).union(nations).union(suppliers)


def peptides(spark: SparkSession, sequences=PEPTIDES) -> DataFrame:
    return spark.createDataFrame(list(enumerate(sequences)), "ord long, sequence string")


def varied_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The proteins without some kinds of annotations, some without any, and some of no known taxon."""
    part = read(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size")
    ec = F.when(key % 3 != 0, F.concat(F.lit("EC:1."), (size % 7).cast("string"), F.lit(".1.-")))
    go = F.when(key % 2 == 0, F.concat(F.lit("GO:"), F.lpad((key % 50).cast("string"), 7, "0")))
    ipr = F.when(size % 5 != 0, F.concat(F.lit("IPR:IPR"), F.lpad(size.cast("string"), 6, "0")))
    taxon = F.when(key % 11 == 0, F.lit(999_999_999)).otherwise(100 + key % 25).cast("long")
    own = part.select((key - 1).cast("long").alias("line"), taxon.alias("taxon_id"), F.concat_ws(";", ec, go, ipr).alias("fa"))
    texts = proteins(spark, sf_dir).select(F.col("protein_idx").alias("line"), "uniprot_id", "sequence")
    return texts.join(own, "line").select("line", "uniprot_id", "taxon_id", "sequence", "fa")


def cut_peptides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(line, sequence)``: a piece of 3 to 12 letters of every protein."""
    key = F.col("protein_idx") + 1
    return proteins(spark, sf_dir).select(F.col("protein_idx").alias("line"), F.substring("sequence", (1 + key % 5).cast("int"), (3 + key % 10).cast("int")).alias("sequence"))


def request_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(value)``: a JSON request for every size of part, with pieces of its proteins; some leave out options, some ask for nothing."""
    size = F.col("p_size")
    parts = read(spark, sf_dir, "part").select((F.col("p_partkey") - 1).cast("long").alias("line"), "p_size")
    pieces = cut_peptides(spark, sf_dir).join(parts, "line").where("p_size is not null")
    wanted = F.transform(F.array_sort(F.collect_list(F.when((F.length("sequence") >= 6) & (size % 7 != 0), F.struct("line", "sequence")))), lambda x: x["sequence"])
    options = [F.when(size % 5 != 0, 1 + size % 3).alias("cutoff"), F.when(size % 2 == 0, True).alias("equalize_I_and_L"), F.when(size % 3 == 0, True).alias("clean_taxa")]
    grouped = pieces.groupBy("p_size").agg(wanted.alias("peptides"))
    return grouped.select(F.to_json(F.struct(F.concat(F.lit("r"), size.cast("string")).alias("id"), "peptides", *options)).alias("value"))
