"""Substring deduplication by level-wise doubling.

Windows of ``length / 2`` words are the first level; only windows repeated in different
documents are extended to ``length``, those repeated there to ``2 * length``, and so on
until no candidate survives. No level needs a row per window: every ``length``-window names
as its anchor the half-length window with the smallest hash inside it, equal windows name
equal anchors, and the windows of all levels start at anchors, about one word in thirteen.

The levels carry the answer. A long window that a smaller document holds removes all its
words, so only ``length``-windows that lie in no such window and whose anchor is repeated are
dealt out one by one at the end. The smallest document with a window always deals it out,
since a window of a still smaller one would else cover it, so nothing is lost; a passage with
many copies costs its words once and a few windows at the ends of each copy.

Edge cases: a null text has no words and nothing removed; documents shorter than a window
keep everything; a null doc_id counts as larger than any other and stays null; rows that
share a doc_id are one document for the comparison (they never remove each other's words)
and each returns its own row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch, textscan

LAST = 2**63 - 1
SEEDS = (0x51ED270B, 0x2545F491)


def _anchors(short: np.ndarray, span: int) -> np.ndarray:
    """For each start the position of the leftmost smallest hash among ``span`` starts."""
    at, width = np.arange(len(short)), 1
    while width * 2 <= span:
        a, b = at[:-width], at[width:]
        at, width = np.where(short[b] < short[a], b, a), width * 2
    if span > width and len(at) > span - width:
        a, b = at[: len(at) - (span - width)], at[span - width :]
        at = np.where(short[b] < short[a], b, a)
    return at


def _anchored(block: textscan.Block, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of whole windows, the anchor of each, and the short windows' hashes."""
    half = length // 2
    starts = np.flatnonzero(block.left >= length)
    if not len(starts):
        return starts, starts, np.empty(0, textscan.U)
    short = textscan.windows(hashes, half, SEEDS[0])
    return starts, _anchors(short, length - half + 1)[starts], short


def _units(length: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("whole_sha256", pa.string()), ("anchors", pa.list_(pa.struct([("a", pa.int64()), ("at", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textscan.blocks(batch.column("text")):
                starts, named, short = _anchored(block, block.hashes(), length)
                named = np.unique(named)
                rows = np.searchsorted(block.first, named, "right") - 1
                values = pa.StructArray.from_arrays([textscan.signed(short[named]), pa.array((named - block.first[rows]).astype(np.int32))], ["a", "at"])
                whole = [hashlib.sha256(b" ".join(block.text(i).split())).hexdigest() for i in range(block.rows)]
                part = batch.slice(block.row0, block.rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(np.diff(block.first), pa.int64()), pa.array(whole, pa.string()), textscan.lists(np.bincount(rows, minlength=block.rows), values)], schema=schema)

    return run


def _marks(own: pa.Array, *fields: str) -> tuple[np.ndarray, ...]:
    """The row of each element of a list column, and the elements or their fields."""
    lengths = pc.fill_null(own.value_lengths(), 0).to_numpy(zero_copy_only=False)
    flat = own.flatten()
    columns = flat.flatten() if fields else [flat]
    return np.repeat(np.arange(len(own)), lengths), *(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)


def _levels(length: int):
    """``(id, key, at, keys)``: for each anchor ``at`` the hashes of the windows of ``length``, ``2 * length``, … words from it."""
    pair = pa.struct([("h", pa.int64()), ("g", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("keys", pa.list_(pair))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textscan.blocks(batch.column("text")):
                part, hashes = batch.slice(block.row0, block.rows), block.hashes()
                rows, at = _marks(part.column("at"))
                starts = block.first[rows] + at
                room = block.first[rows + 1] - starts
                some = room >= length
                rows, at, starts, room = rows[some], at[some], starts[some], room[some]
                depth = np.floor(np.log2(room / length)).astype(np.int64) + 1
                each = np.repeat(starts, depth)
                n = length << (np.arange(len(each)) - np.repeat(np.cumsum(depth) - depth, depth))
                h, g = (textscan.Rolling(hashes, seed).at(each, n) for seed in SEEDS)
                keys = textscan.lists(depth, pa.StructArray.from_arrays([textscan.signed(h), textscan.signed(g)], ["h", "g"]))
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), part.column("key").take(pa.array(rows)), pa.array(at.astype(np.int32)), keys], schema=schema)

    return run


def _open_windows(length: int):
    """``(id, key, at, h, g)``: the windows whose anchor survived and that lie in no cover."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("g", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in textscan.blocks(batch.column("text")):
                part, hashes = batch.slice(block.row0, block.rows), block.hashes()
                held = np.zeros(len(hashes) + 1, dtype=bool)
                rows, at = _marks(part.column("at"))
                held[block.first[rows] + at] = True
                covers = np.zeros(len(hashes) + 2, dtype=np.int64)
                rows, at, n = _marks(part.column("covers"), "at", "n")
                np.add.at(covers, block.first[rows] + at, 1)
                np.add.at(covers, block.first[rows] + at + n - length + 1, -1)
                starts, named, _ = _anchored(block, hashes, length)
                starts = starts[held[named] & (np.cumsum(covers)[starts] == 0)]
                h, g = (textscan.Rolling(hashes, seed).at(starts, np.full(len(starts), length)) for seed in SEEDS)
                rows = np.searchsorted(block.first, starts, "right") - 1
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), part.column("key").take(pa.array(rows)), pa.array((starts - block.first[rows]).astype(np.int32)), textscan.signed(h), textscan.signed(g)], schema=schema)

    return run


def _cut(length: int):
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                _, starts = _marks(batch.column("later").slice(i, 1))
                _, at, n = _marks(batch.column("covers").slice(i, 1), "at", "n")
                np.add.at(edge, np.concatenate([starts, at]), 1)
                np.add.at(edge, np.concatenate([starts + length, at + n]), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = b" ".join([w for w, x in zip(words, gone, strict=True) if not x])
                out.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), *(pa.array([x[i] for x in out], schema.field(i + 2).type) for i in range(3))], schema=schema)

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))


def repeated_spans(spark: SparkSession, docs: DataFrame, length: int = 50) -> tuple[DataFrame, DataFrame]:
    """``(units, edits)``: one row per input row, and the rows that lose words.

    units: id, key, n_words, whole_sha256, copy_of (smallest id with the same words, where
    that is another document). edits: id, key, n_removed, kept_sha256, kept_text,
    longest_repeat (the longest level, in words, at which a window of it that starts at an
    anchor is repeated, ``length`` at least).
    """
    if length < 2 or length % 2:
        raise ValueError("length must be even")
    keyed = _keyed(docs)
    units = scratch.save(spark, keyed.mapInArrow(_units(length), "id long, key long, n_words long, whole_sha256 string, anchors array<struct<a:long,at:int>>"), "units")

    copies = units.groupBy("whole_sha256").agg(F.min("id").alias("copy_of"), F.max("id").alias("last")).where("copy_of < last").drop("last")
    units_of = units.drop("anchors").join(copies, "whole_sha256", "left").withColumn("copy_of", F.when(F.col("copy_of") < F.col("id"), F.col("copy_of")))
    originals = units.where(F.size("anchors") > 0).join(units_of.where("copy_of is not null").select("id", "key").distinct(), ["id", "key"], "left_anti")

    # Level one: anchors that several different documents share.
    anchors = originals.select("id", "key", F.explode("anchors").alias("x")).select("id", "key", "x.a", "x.at")
    shared = scratch.save(spark, anchors.groupBy("a").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("a"), "anchors")
    alive = anchors.join(shared, "a", "left_semi").groupBy("id", "key").agg(F.collect_set("at").alias("at"))
    # Merge joins with texts at every size: the other sides grow with the documents.
    texts = scratch.save(spark, keyed.join(alive.hint("merge"), ["id", "key"]).dropDuplicates(["id", "key"]), "texts")
    scratch.drop(spark, shared)

    def repeated(windows: DataFrame, name: str) -> DataFrame:
        """``windows(id, h, g, …)`` that several documents hold, with ``later``: whether a smaller one does.

        The keys are counted in partial groups and written first, so that a window with many
        copies is one row on that side and the join may split the other.
        """
        keys = scratch.save(spark, windows.groupBy("h", "g").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "g", "lo"), f"{name}_keys")
        held.append(keys)
        return windows.join(keys, ["h", "g"]).withColumn("later", F.col("id") > F.col("lo")).drop("h", "g", "lo")

    level, first = length, scratch.save(spark, texts.mapInArrow(_levels(length), "id long, key long, at int, keys array<struct<h:long,g:long>>"), "windows")
    windows, held = first, [first]
    spans = windows.select("id", "key", "at", F.lit(0).alias("n"), F.lit(False).alias("later")).limit(0)
    while not windows.isEmpty():
        each = windows.select("id", "key", "at", F.col("keys")[0]["h"].alias("h"), F.col("keys")[0]["g"].alias("g"), F.slice("keys", 2, F.size("keys")).alias("keys"))
        found = scratch.save(spark, repeated(each, f"level{level}"), f"level{level}")
        held.append(found)
        spans = spans.union(found.select("id", "key", "at", F.lit(level).alias("n"), "later"))
        windows = found.where(F.size("keys") > 0).drop("later")
        level *= 2
    cover = F.collect_list(F.when(F.col("later"), F.struct("at", "n")))
    spans = scratch.save(spark, spans.groupBy("id", "key").agg(cover.alias("covers"), F.max("n").alias("longest")), "spans")

    covered = texts.join(spans.where(F.size("covers") > 0).drop("longest").hint("merge"), ["id", "key"], "left")
    ends = scratch.save(spark, covered.mapInArrow(_open_windows(length), "id long, key long, at int, h long, g long"), "open_windows")
    later = repeated(ends, "ends").where("later").groupBy("id", "key").agg(F.collect_list("at").alias("later"))
    losing = spans.where(F.size("covers") > 0).join(scratch.save(spark, later, "later"), ["id", "key"], "full")
    cut = texts.drop("at").join(losing.select("id", "key", "covers", "later").hint("merge"), ["id", "key"]).mapInArrow(_cut(length), "id long, key long, n_removed long, kept_sha256 string, kept_text string")
    edits = cut.join(spans.select("id", "key", "longest"), ["id", "key"], "left").withColumn("longest_repeat", F.coalesce("longest", F.lit(length))).drop("longest")
    edits = scratch.save(spark, edits, "edits")
    scratch.drop(spark, texts, ends, *held)
    return units_of, edits


def substring_dedup(spark: SparkSession, docs: DataFrame, length: int = 50) -> DataFrame:
    """Per input row: doc_id, n_words, n_removed, kept_sha256, kept_text, longest_repeat.

    ``kept_text`` is null where nothing is removed. A document equal to one with a smaller
    doc_id loses all its words if it holds a whole window, and keeps all of them otherwise.
    """
    units, edits = repeated_spans(spark, docs, length)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = F.col("copy_of").isNotNull() & (F.col("n_words") >= length)
    return units.join(edits, ["id", "key"], "left").select(
        F.when(F.col("id") != LAST, F.col("id")).alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
        F.when(whole, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.coalesce("longest_repeat", F.lit(0)).alias("longest_repeat"),
        F.col("key").alias("text_key"),
    )
