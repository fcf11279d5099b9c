"""Counts of proteins and annotations per peptide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.functions.annotations import has_category, split


def annotation_counts(rows: DataFrame, group: str) -> DataFrame:
    """``(group, annotation, n)``: occurrences of each annotation over ``rows(group, fa)``."""
    same = rows.groupBy(group, "fa").agg(F.count(F.lit(1)).alias("k"))  # equal strings are split once
    return same.select(group, "k", F.explode(split(F.col("fa"))).alias("annotation")).groupBy(group, "annotation").agg(F.sum("k").alias("n"))


def category_counts(rows: DataFrame, group: str) -> DataFrame:
    """``(group, all, ec, go, ipr)``: occurrences, and distinct proteins with each kind of annotation."""
    marks = {name: has_category(split(F.col("fa")), letter) for name, letter in (("ec", "E"), ("go", "G"), ("ipr", "I"))}
    each = rows.groupBy(group, "uniprot_id", "fa").agg(F.count(F.lit(1)).alias("k"))
    proteins = each.groupBy(group, "uniprot_id").agg(F.sum("k").alias("k"), *(F.max(x.cast("long")).alias(n) for n, x in marks.items()))
    return proteins.groupBy(group).agg(F.sum("k").alias("all"), *(F.sum(n).alias(n) for n in marks))


def functional_summary(rows: DataFrame, group: str) -> DataFrame:
    """``(group, fa)`` with ``fa.counts`` (all, EC, GO, IPR) and ``fa.data`` (annotation to count)."""
    counts = category_counts(rows, group).select(group, F.create_map(F.lit("all"), "all", F.lit("EC"), "ec", F.lit("GO"), "go", F.lit("IPR"), "ipr").alias("counts"))
    data = annotation_counts(rows, group).groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("annotation", "n")))).alias("data"))
    none = F.create_map().cast("map<string,bigint>")
    return counts.join(data, group, "left").select(group, F.struct("counts", F.coalesce("data", none).alias("data")).alias("fa"))
