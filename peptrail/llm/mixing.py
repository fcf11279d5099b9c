"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 60-bit hash of its doc_id. Words are summed by source and hash bucket;
a running sum over a source's buckets finds the bucket in which its budget ends, and only
that bucket is summed again at the next, finer level. The last level tells single hashes
apart, so the budget is met to within half a document; documents below the threshold are
taken by a filter, and no documents are sorted.

Built-in functions only. Edge cases: a null or empty text has size 0 and takes 0; a null
source is a source of its own, last in order; a null doc_id hashes as the empty string;
documents with equal ids stand or fall together; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash that each level tells apart.
LEVELS = (12, 16, 32)
BITS = sum(LEVELS)
#: A source table up to this many rows (some tens of bytes each) is broadcast; a larger one is joined by shuffles.
BROADCAST_SOURCES = 50_000


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``totals(source, source_size)`` with ``target``: weighted shares, cut at ``most`` sizes.

    The excess of cut sources goes to the others by weight until none is above its limit.
    In closed form: in order of limit / weight, the first sources are cut, the rest share
    what remains. One row per source is ordered here, never a document.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double")
    ranked = totals.withColumn("weight", weight).withColumn("top", F.col("source_size") * F.lit(float(most)))
    steps = Window.orderBy(F.col("top") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("top").over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ahead = F.sum("weight").over(steps.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = ranked.withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before) / ahead)
    cut = level.withColumn("cut", F.col("top") <= F.col("level") * F.col("weight"))
    free = F.max(F.when(~F.col("cut"), F.col("level"))).over(everything)
    return cut.select(*totals.columns, F.when(F.col("cut"), F.col("top")).otherwise(F.col("weight") * free).alias("target"))


def _near(df: DataFrame, small: DataFrame, rows: int) -> DataFrame:
    """Join on a source that may be null; both sides hold ``sid``, the source made non-null."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_SOURCES else small, "sid")


def _marks(docs: DataFrame) -> tuple[Column, Column]:
    """The source made non-null, and 60 bits of the doc_id's digest."""
    hashed = F.conv(F.substring(F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    source = docs["source"]
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string"))), hashed


def thresholds(spark: SparkSession, sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """``(plan, rows)``: one row per source of ``sized(source, sid, size, hash)``.

    plan: sid, source_size, target, whole (times that every document is taken), bound (documents
    with a smaller hash are taken once more).
    """
    totals = scratch.save(spark, sized.groupBy("source", "sid").agg(F.sum("size").alias("source_size")), "totals")
    rows = totals.count()
    goal = targets(totals, weights, share, most).drop("source")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    goal = scratch.save(spark, goal.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goal")

    state = goal.select("sid", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    left = BITS
    for bits in LEVELS:
        inside = _near(sized.select("sid", "size", "hash"), state, rows).where(F.shiftright("hash", left) == F.col("prefix"))
        left -= bits
        bins = inside.groupBy("sid", "rest", "before", F.shiftright("hash", left).alias("bin")).agg(F.sum("size").alias("words"))
        run = F.col("before") + F.sum("words").over(Window.partitionBy("sid").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = bins.withColumn("run", run).where(F.col("run") > F.col("rest"))
        first = ends.groupBy("sid").agg(F.min(F.struct("bin", "run", "words", "rest")).alias("x"))
        state = scratch.save(spark, first.select("sid", F.col("x.rest").alias("rest"), F.col("x.bin").alias("prefix"), (F.col("x.run") - F.col("x.words")).alias("before"), F.col("x.words").alias("words")), f"bound{left}")
    # The document in which the budget ends is taken if that brings the sum nearer.
    bound = state.select("sid", F.when(F.col("before") + F.col("words") / 2 > F.col("rest"), F.col("prefix")).otherwise(F.col("prefix") + 1).alias("bound"))
    return goal.join(bound, "sid", "left").select("sid", "source_size", "target", "whole", F.coalesce("bound", F.lit(1 << BITS)).alias("bound")), rows


def _sized(spark: SparkSession, docs: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long")
    sid, hashed = _marks(docs)
    return scratch.save(spark, docs.select(docs["doc_id"], docs["source"].cast("string").alias("source"), sid.alias("sid"), size.alias("size"), hashed.alias("hash")), "sized")


def mix_sources(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, times, taken.

    ``times`` is how often the document is taken and ``taken`` its words counted so often.
    A source whose target is its size or more takes every document once (or twice) whole,
    and the hash threshold deals out the rest.
    """
    sized = _sized(spark, docs)
    plan, rows = thresholds(spark, sized, weights, share, most)
    times = F.col("whole") + F.when((F.col("hash") < F.col("bound")) & (F.col("whole") < most), 1).otherwise(0)
    return _near(sized, plan, rows).select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; no text is shuffled."""
    plan, rows = thresholds(spark, _sized(spark, docs), weights, share, most)
    sid, hashed = _marks(docs)
    # The columns of docs travel in one struct under names of their own, so that none clashes.
    row = F.struct(*(docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)))
    taken = _near(docs.select(row.alias("row"), sid.alias("sid"), hashed.alias("hash")), plan.select("sid", "whole", "bound"), rows)
    times = F.col("whole") + F.when((F.col("hash") < F.col("bound")) & (F.col("whole") < most), 1).otherwise(0)
    kept = taken.withColumn("times", times.cast("int")).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return kept.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))
