"""Every repeated prefix of the suffixes in proteins, with the lowest common ancestor of its taxa.

A prefix is listed where each longer one has fewer occurrences. Its suffixes are neighbours in the
suffix array, so ``(length, first_rank, n)`` names it: an interval whose neighbours share ``length``
letters or more, while fewer are shared at both of its ends. Taxa are summed up per interval
by their least and greatest number, not by listing prefixes or occurrences.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peptrail.operators.array_search import StoredArray
from peptrail.operators.index import HEAD, protein_at, ranked_suffixes
from peptrail.operators.settle import settle
from peptrail.operators.taxonomy import ancestor_of_interval

#: Ranks of a task in the first round, and ranges that are put together in one in each later round.
RANGE, FAN = 1 << 18, 16
NO_TAXON = (1 << 62, -1)
_ITEMS = "part long, shared int, first_rank long, n long, least long, greatest long, whole boolean"


def shared_letters(prepared: DataFrame) -> DataFrame:
    """``(rank, pos, protein_idx, shared)``: how many letters a suffix shares with the one before it, up to the ends of their proteins.

    Up to ``HEAD`` letters are compared as they are. Neighbours that share those are moved on by the ranks of
    the doubling rounds, longest first: equal ranks are equal letters, and a pair moves at most once a round.
    """
    array, heads, rounds = ranked_suffixes(prepared)
    first = settle(array.join(heads.drop("protein_idx"), "pos"))
    before = first.select((F.col("rank") + 1).alias("rank"), *(F.col(c).alias(c + "2") for c in ("pos", "head", "rest", "r")))
    pairs = settle(first.join(before, "rank", "left"))
    same = F.expr(f"size(filter(sequence(1, {HEAD}), i -> substring(head, 1, i) = substring(head2, 1, i)))")
    alike = F.coalesce(F.least(same, "rest", "rest2"), F.lit(0))
    tied = F.coalesce(F.col("r") == F.col("r2"), F.lit(False))
    out = ("rank", "pos", "protein_idx")
    near = pairs.where(~tied).select(*out, alike.cast("int").alias("shared"))
    far = pairs.where(tied).select(*out, F.col("pos").alias("a"), F.col("pos2").alias("b"), F.lit(0).alias("moved"))
    for step, ranks in reversed(rounds):
        met = far.join(ranks.toDF("a", "ra"), "a").join(ranks.toDF("b", "rb"), "b")
        move = F.when(F.col("ra") == F.col("rb"), step).otherwise(0)
        far = settle(met.select(*out, (F.col("a") + move).alias("a"), (F.col("b") + move).alias("b"), (F.col("moved") + move).alias("moved")))
    texts = heads.select("pos", "head", "rest")
    met = far.join(texts.toDF("a", "head", "rest"), "a").join(texts.toDF("b", "head2", "rest2"), "b")
    return near.union(met.select(*out, (F.col("moved") + alike).cast("int").alias("shared")))


def _fold(items: pd.DataFrame) -> pd.DataFrame:
    return _folded(items, False)


def _last_fold(items: pd.DataFrame) -> pd.DataFrame:
    return _folded(items, True)


def _folded(items: pd.DataFrame, last: bool) -> pd.DataFrame:
    """The intervals (``whole``) that end inside one range of items, and the items that are left of it.

    An item is a run of ranks, with the letters shared with what is before it. Left are those that an interval
    from the ranges before may reach (fewer letters each), and then those that may go on behind (more letters
    each), so at most three for each number of letters that is shared.
    """
    whole, reached, open_ = [], [], []
    names = ["shared", "first_rank", "n", "least", "greatest"]
    rows = list(items.sort_values("first_rank")[names].itertuples(index=False, name=None))
    for item in [*rows, (0, None, 0, *NO_TAXON)] if last else rows:
        while open_ and open_[-1][0] > item[0]:
            top = open_.pop()
            if not open_:
                reached.append(top)
                continue
            open_[-1] = _joined(open_[-1], top)
            if open_[-1][0] < top[0]:
                whole.append((top[0], *open_[-1][1:]))
        if len(open_) > 1 and open_[-2][0] == open_[-1][0] == item[0]:  # only the last one may still be part of a longer prefix
            last_one = open_.pop()
            open_[-1] = _joined(open_[-1], last_one)
        open_.append(item)
    found = pd.DataFrame(whole + ([] if last else reached + open_), columns=names)
    found["whole"] = [True] * len(whole) + [False] * (len(found) - len(whole))
    found["part"] = items["part"].iloc[0]
    return found


def _joined(a: tuple, b: tuple) -> tuple:
    return a[0], a[1], a[2] + b[2], min(a[3], b[3]), max(a[4], b[4])


def prefix_intervals(prepared: DataFrame, paths: DataFrame, size: int = RANGE, fan: int = FAN) -> DataFrame:
    """``(length, first_rank, n, lca)`` of every repeated prefix, in folded letters, by ranks of the array of all suffixes.

    ``lca`` is the plain one, snapped; null where no protein has a known taxon. Ranges of ``size`` ranks
    are folded in tasks, then what is left of ``fan`` neighbours at a time.
    """
    numbers = paths.select(F.col("id").alias("taxon_id"), F.col("first").alias("number"))
    taxa = prepared.select("protein_idx", "taxon_id").join(numbers, "taxon_id", "left").select("protein_idx", "number")
    suffixes = shared_letters(prepared).where("protein_idx is not null").join(taxa, "protein_idx")
    least, greatest = (F.coalesce("number", F.lit(x)) for x in NO_TAXON)
    items = suffixes.select(F.floor(F.col("rank") / size).alias("part"), "shared", F.col("rank").alias("first_rank"), F.lit(1).cast("long").alias("n"), least.alias("least"), greatest.alias("greatest"))
    letters = prepared.agg(F.sum(F.length("closed"))).first()[0] or 0
    parts, found = -(-letters // size), None
    while True:
        last = parts <= 1
        folded = settle(items.groupBy("part").applyInPandas(_last_fold if last else _fold, _ITEMS))
        done = folded.where("whole")
        found = done if found is None else found.union(done)
        if last:
            break
        items = folded.where("not whole").drop("whole").withColumn("part", F.floor(F.col("part") / fan))
        parts = -(-parts // fan)
    return ancestor_of_interval(found.select(F.col("shared").cast("long").alias("length"), "first_rank", "n", "least", "greatest"), paths).select("length", "first_rank", "n", "lca")


def taxa_of_bounds(bounds: DataFrame, intervals: DataFrame, array: StoredArray, paths: DataFrame) -> DataFrame:
    """``bounds(…, lo, hi)`` in an array of all suffixes with ``lca``: a row of ``prefix_intervals`` for each, or the taxon of its only suffix; no occurrences are listed."""
    if array.sparseness != 1:
        raise ValueError("intervals are those of an array of all suffixes")
    rest = [c for c in bounds.columns if c not in ("lo", "hi")]
    named = intervals.select(F.col("first_rank").alias("lo"), (F.col("first_rank") + F.col("n")).alias("hi"), "lca")
    many = bounds.where("hi - lo > 1").join(named, ["lo", "hi"], "left")
    owner = protein_at(array.within(bounds.where("hi - lo = 1").withColumns({"_lo": F.col("lo"), "_hi": F.col("hi")})), array.prepared)
    taxon = array.prepared.select("protein_idx", F.col("taxon_id").alias("_taxon"))
    one = owner.join(taxon, "protein_idx").join(paths.select(F.col("id").alias("_taxon"), F.col("snapped").alias("lca")), "_taxon", "left")
    return many.select(*rest, "lo", "hi", "lca").union(one.select(*rest, F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), "lca"))
