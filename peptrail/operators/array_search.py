"""Search in a stored suffix array through fences.

Every ``STEP``-th suffix of the array is a fence: its rank and first ``HEAD`` letters, in a table in
the order of these letters. The suffixes that start with a peptide begin and end between two
fences each, so their bounds need the files with these fences and ``STEP`` ranks of the array
an end, however many occurrences lie between. The array itself is read from its file, in
ranges of ranks. Folded letters are compared; peptides hold no separators.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.functions.peptides import folded
from peptrail.operators.index import protein_at
from peptrail.operators.settle import settle
from peptrail.operators.stored import Ordered, write_ordered
from peptrail.sources.files import read_suffix_array, write_suffix_array

STEP, HEAD = 256, 64
#: Up to so many ranges of ranks are named to a scan of the array; more are merged to so many.
RANGES = 10_000
#: Ranks that meet bounds at once, and those that a bound is first cut into.
BLOCK, STRETCH = 1 << 12, 1 << 22


def _placed(rows: DataFrame, prepared: DataFrame, marks: bool = True) -> DataFrame:
    """``rows(pos, …)`` with ``protein_idx``, ``off`` and the ``closed`` text and ``exact`` sequence there as bytes; without rows outside proteins."""
    owner = protein_at(rows, prepared, marks=marks)
    texts = prepared.select("protein_idx", "start_pos", F.col("closed").cast("binary").alias("closed"), F.col("sequence").cast("binary").alias("exact"))
    return owner.join(texts, "protein_idx").withColumn("off", (F.col("pos") - F.col("start_pos")).cast("int")).drop("start_pos")


def write_array(array: DataFrame, prepared: DataFrame, path: str, sparseness: int, step: int = STEP) -> None:
    """``array(rank, pos)`` as parts of an index file under ``path/array``, and its fences under ``path/fences``."""
    write_suffix_array(array, f"{path}/array", sparseness, joined=False)
    heads = _placed(array.where(F.col("rank") % step == 0).select("rank", "pos"), prepared).select(F.expr(f"substring(closed, off + 1, {HEAD})").alias("head"), "rank")
    write_ordered(heads, f"{path}/fences", "head", ["head", "rank"])
    array.sparkSession.createDataFrame([(sparseness, step)], "sparseness int, step int").write.parquet(f"{path}/settings")


class StoredArray:
    """An array of ``write_array`` over the text of ``prepared`` proteins."""

    def __init__(self, spark: SparkSession, path: str, prepared: DataFrame):
        self.spark, self.path, self.prepared = spark, path, prepared
        self.sparseness, self.step = spark.read.parquet(f"{path}/settings").first()
        self.fences = Ordered(spark, f"{path}/fences", "head")

    def ranks(self, ranges: DataFrame) -> DataFrame:
        """``(rank, pos)`` of at least the ``ranges(first, last)`` of ranks, both included: of the file only these are read."""
        ordered = ranges.select("first", "last").distinct()
        n = ordered.count()
        if n > RANGES:  # neighbours in the order of ranks together; the gaps between them are read, too
            top = ordered.agg(F.max("last")).first()[0]
            ordered = ordered.groupBy(F.floor(F.col("first") / (top // RANGES + 1))).agg(F.min("first").alias("first"), F.max("last").alias("last"))
        spans: list[list[int]] = []
        for first, last in sorted((r.first_, r.last_) for r in ordered.select(F.col("first").alias("first_"), F.col("last").alias("last_")).collect()):
            if spans and first <= spans[-1][1] + 1:
                spans[-1][1] = max(spans[-1][1], last)
            else:
                spans.append([first, last])
        return read_suffix_array(self.spark, f"{self.path}/array", spans).select("rank", "pos")

    def _edges(self, peptides: DataFrame) -> DataFrame:
        """``(key, above)``: for each end of each peptide's interval the last fence before it (null: none)."""
        firsts, files = self.fences.firsts, self.fences.files

        def numbers(parts):
            for part in parts:
                yield part.assign(number=[bisect_left(firsts, bytes(k)) - 1 for k in part["key"]])

        start = F.substring("pep_il", 1, HEAD - 1)
        keys = peptides.select(F.explode(F.array(start, F.concat(start, F.unhex(F.lit("FF"))))).alias("key")).distinct()
        edges = settle(keys.mapInPandas(numbers, "key binary, number int"))
        met = sorted(r.number for r in edges.select("number").where("number >= 0").distinct().collect())  # at most one a file
        if not met:
            return edges.select("key", F.lit(None).cast("long").alias("above"))
        names = self.spark.createDataFrame([(files[n], n) for n in met], "file string, number int")
        rows = self.spark.read.parquet(*(files[n] for n in met)).select("head", "rank", F.col("_metadata.file_path").alias("file")).join(F.broadcast(names), "file")
        both = rows.select("number", F.col("head").alias("key"), F.lit(1).alias("kind"), "rank").union(edges.select("number", "key", F.lit(0), F.lit(None).cast("long")))
        before = F.last("rank", True).over(Window.partitionBy("number").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn("above", before).where("kind = 0").select("key", "above")

    def bounds(self, peptides: DataFrame) -> DataFrame:
        """``(pep_il, lo, hi)``: the half-open interval of ranks whose suffixes start with the distinct ``peptides(pep_il)``, bytes without separators; none without a suffix."""
        asked = peptides.select("pep_il").where(F.length("pep_il") > 0).distinct()
        edges = settle(self._edges(asked))
        step = self.step
        inside = edges.where("above is not null").select((F.col("above") + 1).alias("first"), (F.col("above") + step - 1).alias("last"))
        block = F.floor(F.col("rank") / step) * step
        near = self.ranks(inside).where(F.col("rank") % step != 0).withColumn("above", block).join(edges.select("above").distinct(), "above", "left_semi")
        heads = _placed(near, self.prepared).select("above", F.expr(f"substring(closed, off + 1, {HEAD})").alias("head"))
        less = edges.join(heads, "above", "left").groupBy("key", "above").agg(F.count(F.when(F.col("head") < F.col("key"), 1)).alias("n"))
        at = settle(less.select("key", F.coalesce(F.col("above") + 1 + F.col("n"), F.lit(0).cast("long")).alias("at")))
        start = F.substring("pep_il", 1, HEAD - 1)
        lows = at.select(F.col("key").alias("low"), F.col("at").alias("lo"))
        highs = at.select(F.col("key").alias("high"), F.col("at").alias("hi"))
        found = asked.withColumns({"low": start, "high": F.concat(start, F.unhex(F.lit("FF")))}).join(lows, "low").join(highs, "high").where("lo < hi").select("pep_il", "lo", "hi")
        long = settle(found.where(F.length("pep_il") >= HEAD))
        if long.isEmpty():
            return found
        # Longer ones share the interval of their first letters; the suffixes in it are compared whole.
        whole = _placed(self.within(long), self.prepared).where(F.expr("substring(closed, off + 1, length(pep_il)) = pep_il"))
        exact = whole.groupBy("pep_il").agg(F.min("rank").alias("lo"), (F.max("rank") + 1).alias("hi"))
        return found.where(F.length("pep_il") < HEAD).union(exact)

    def within(self, bounds: DataFrame) -> DataFrame:
        """``(…, rank, pos)``: every rank of ``bounds(lo, hi, …)``; no array spans an interval."""
        long = bounds.withColumn("_s", F.explode(F.expr(f"sequence(lo div {STRETCH}, (hi - 1) div {STRETCH})")))
        low, high = f"greatest(lo, _s * {STRETCH})", f"least(hi, (_s + 1) * {STRETCH}) - 1"
        cut = long.withColumn("_block", F.explode(F.expr(f"sequence({low} div {BLOCK}, ({high}) div {BLOCK})"))).drop("_s")
        rows = self.ranks(bounds.select(F.col("lo").alias("first"), (F.col("hi") - 1).alias("last"))).withColumn("_block", F.expr(f"rank div {BLOCK}"))
        return cut.join(rows, "_block").where("rank >= lo and rank < hi").drop("_block", "lo", "hi")

    def occurrences(self, peptides: DataFrame, equalize: bool = False) -> DataFrame:
        """``(pep, protein_idx, off, skip, rank)``: every occurrence of ``peptides(pep)``, in normal form, of ``sparseness`` letters or more without separators.

        A peptide is looked for from each of its first ``sparseness`` letters on, and the letters before
        are compared; a search orders its hits by ``skip`` and then by ``rank``.
        """
        asked = peptides.select("pep").where((F.octet_length("pep") >= self.sparseness) & ~F.col("pep").rlike("[-$]") & (F.col("pep") != "")).distinct()
        bytes_ = asked.select("pep", folded(F.col("pep")).cast("binary").alias("whole"), F.col("pep").cast("binary").alias("letters"))
        parts = settle(bytes_.withColumn("skip", F.explode(F.sequence(F.lit(0), F.lit(self.sparseness - 1)))).withColumn("pep_il", F.expr("substring(whole, skip + 1)")))
        hits = self.within(parts.join(self.bounds(parts), "pep_il").drop("pep_il"))
        placed = _placed(hits.withColumn("pos", F.col("pos") - F.col("skip")), self.prepared, marks=False)
        same = "substring(closed, off + 1, length(whole)) = whole" if equalize else "substring(exact, off + 1, length(letters)) = letters"
        return placed.where(same).select("pep", "protein_idx", "off", "skip", "rank")
