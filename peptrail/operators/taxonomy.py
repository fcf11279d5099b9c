"""Ancestor paths, snapping, and lowest common ancestors by intervals of taxon numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.operators.settle import numbered, settle

ROOT = 1
DOUBLINGS = 40
#: Taxa whose numbers are broadcast, some 32 bytes each.
BROADCAST_TAXA = 2_000_000


def lineage(taxonomy: DataFrame) -> DataFrame:
    """``(id, rank, valid, path, depth, snapped, first, last, line)`` of ``taxonomy(id, name, rank, parent, valid)``.

    Paths run from the root to the taxon. Each round joins paths end to end, so rounds grow
    with the logarithm of the depth. ``snapped`` is the nearest acceptable taxon on the path:
    the root, or one that is valid and has a rank. A taxon whose parents lead to no root is an error.
    The rest is for intervals: see ``_with_intervals``.
    """
    rows = taxonomy.select("id", "rank", "parent", F.coalesce("valid", F.lit(False)).alias("valid"))
    own = F.struct("id", (F.col("valid") & (F.col("rank") != "no rank") | (F.col("id") == F.col("parent"))).alias("ok"))
    paths = settle(rows.select("id", F.when(F.col("id") != F.col("parent"), F.col("parent")).alias("above"), F.array(own).alias("steps")))
    for _ in range(DOUBLINGS):
        if paths.where("above is not null").isEmpty():
            break
        upper = paths.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("steps").alias("upper"), F.lit(True).alias("there"))
        lost = F.raise_error(F.concat(F.lit("no such parent: "), F.col("above").cast("string")))
        joined = paths.join(upper, "above", "left")
        paths = settle(joined.select("id", F.when(F.col("above").isNotNull() & F.col("there").isNull(), lost.cast("long")).otherwise(F.col("next")).alias("above"), F.concat(F.coalesce("upper", F.array().cast(paths.schema["steps"].dataType)), "steps").alias("steps")))
    else:
        raise ValueError("the taxonomy has a cycle")
    snapped = lambda steps: F.element_at(F.filter(steps, lambda x: x["ok"]), -1)["id"]
    whole = rows.drop("parent").join(paths.select("id", "steps"), "id").select("id", "rank", "valid", F.transform("steps", lambda x: x["id"]).alias("path"), (F.size("steps") - 1).alias("depth"), snapped(F.col("steps")).alias("snapped"))
    return _with_intervals(settle(whole))


def _with_intervals(paths: DataFrame) -> DataFrame:
    """``paths`` with ``first`` and ``last``, the numbers of each taxon and of the last one below it, and ``line``: ``(id, last, snapped)`` of each step of its path.

    Taxa are numbered in the order of their paths, so those below a taxon follow it without gaps.
    """
    below = paths.select(F.explode("path").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_size"))
    order = numbered(paths.select("id", "path"), ["path"], "first").select("id", "first")
    placed = settle(paths.join(order, "id").join(below, "id").withColumn("last", F.col("first") + F.col("_size") - 1).drop("_size"))
    steps = placed.select(F.col("id").alias("taxon"), F.posexplode("path").alias("at", "id"))
    ends = _near(placed.select("id", "last", "snapped"))
    lines = steps.join(ends, "id").groupBy("taxon").agg(F.sort_array(F.collect_list(F.struct("at", "id", "last", "snapped"))).alias("line"))  # as long as the taxonomy is deep
    return settle(placed.join(lines.select(F.col("taxon").alias("id"), F.transform("line", lambda x: F.struct(x["id"].alias("id"), x["last"].alias("last"), x["snapped"].alias("snapped"))).alias("line")), "id"))


def _near(taxa: DataFrame) -> DataFrame:
    """A few numbers a taxon, broadcast where they are few enough; a larger table is joined as it is."""
    return F.broadcast(taxa) if taxa.count() <= BROADCAST_TAXA else taxa


def known(rows: DataFrame, taxonomy: DataFrame, taxon: str = "taxon_id") -> DataFrame:
    """Rows whose taxon exists."""
    return rows.join(taxonomy.select(F.col("id").alias(taxon)), taxon, "left_semi")


def clean(rows: DataFrame, taxonomy: DataFrame, taxon: str = "taxon_id") -> DataFrame:
    """Rows whose taxon exists and is valid."""
    return known(rows, taxonomy.where("valid"), taxon)


def lowest_common_ancestor(rows: DataFrame, paths: DataFrame, group: str, taxon: str = "taxon_id", star: bool = False) -> DataFrame:
    """``(group, ancestor, lca)``: the lowest common ancestor of each group's taxa, and it snapped; unknown taxa do not count.

    The first and the last taxon of a group, by number, have the ancestor that all have. So a group
    is one row of two numbers, put together before it is shuffled, whatever its size and the depth of the taxonomy.
    With ``star``, taxa that are ancestors of other taxa of the group are left out: the first one left
    is the one whose own interval ends first (the deepest of these), and the last one is the same.
    """
    numbers = _near(paths.select(F.col("id").alias("_taxon"), F.col("first").alias("_first"), F.col("last").alias("_last")))
    members = rows.select(group, F.col(taxon).alias("_taxon")).join(numbers, "_taxon")
    start = -F.min(F.struct("_last", (-F.col("_first")).alias("x")))["x"] if star else F.min("_first")
    ends = members.groupBy(group).agg(start.alias("least"), F.max("_first").alias("greatest"))
    return ancestor_of_interval(ends, paths).where("ancestor is not null").select(group, "ancestor", "lca")


def ancestor_of_interval(rows: DataFrame, paths: DataFrame) -> DataFrame:
    """``rows(least, greatest, …)`` of taxon numbers with their lowest common ``ancestor`` and it snapped, ``lca``, instead; null where there is none.

    It is the lowest one of ``least`` whose interval holds ``greatest``.
    """
    steps = paths.select(F.col("first").alias("least"), F.col("line").alias("_line"))
    found = F.element_at(F.filter("_line", lambda x: x["last"] >= F.col("greatest")), -1)
    return rows.join(steps, "least", "left").withColumn("_found", found).select(*(c for c in rows.columns if c not in ("least", "greatest")), F.col("_found.id").alias("ancestor"), F.col("_found.snapped").alias("lca"))
