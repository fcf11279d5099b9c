"""Canonical exact fingerprints of documents.

A text is normalised (NFKC), case-folded and its white space folded to single spaces; the
fingerprint is the 128-bit xxHash of that canonical text in hexadecimal. Within buckets of
equal hashes the canonical bytes themselves are compared, and a second, different text in a
bucket gets ``-2`` appended, a third ``-3``, so equal fingerprints mean equal canonical texts.
Edited texts are in the same buckets; as they are nowhere stored, a SHA-256 of their bytes is compared.

Edge cases: a null text counts as empty; equal texts, however many, share a fingerprint;
rows with equal doc_ids are ordered by text; a null doc_id is the smallest; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.llm import scratch

#: Hexadecimal digits of the hash; fewer make texts share buckets, as tests do.
WIDTH = 32
#: Bits of the map that names hashes held by two or more documents: eight for each such hash, within these powers of 2.
#: A hash that shares its bit with another only costs a comparison; the largest map is 64 MB.
MAP_BITS = (16, 29)
BITMAP_BITS = 32768  # fixed value: bits in one bitmap of Spark's bitmap functions


def canonical(text: str | None) -> str:
    text = text or ""
    folded = text.lower() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def digest(plain: str, width: int = WIDTH) -> tuple[str, str]:
    """The bucket of a canonical text, and the SHA-256 that tells texts of a bucket apart."""
    data = plain.encode()
    return xxhash.xxh3_128_hexdigest(data)[:width], hashlib.sha256(data).hexdigest()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _shared_map(spark: SparkSession, digests: DataFrame) -> np.ndarray:
    """A bit for every hash that two or more rows hold, built in bitmaps of fixed size."""
    shared = scratch.save(spark, digests.groupBy("digest").count().where("count > 1").select(F.expr("cast(conv(substr(digest, 1, 8), 16, 10) as bigint)").alias("head")), "shared")
    bits = min(max((8 * shared.count()).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    slots = shared.select(F.expr(f"head & {(1 << bits) - 1}").alias("slot"))
    # The bitmap functions number buckets from 1 for positions from 1 on.
    maps = slots.groupBy(F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bits"))
    held = np.zeros((1 << bits) // 8, dtype=np.uint8)
    step = BITMAP_BITS // 8
    for row in maps.toLocalIterator():
        held[(row.bucket - 1) * step : row.bucket * step] = np.frombuffer(bytes(row.bits), dtype=np.uint8)
    return held


def _suspects(held: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                plain = canonical(text)
                name = xxhash.xxh3_128_hexdigest(plain.encode())[:width]
                slot = int(name[:8], 16) & (8 * len(held) - 1)
                if held[slot >> 3] >> (slot & 7) & 1:
                    found.append((name, plain))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["digest", "plain"])

    return run


def _crowded(spark: SparkSession, docs: DataFrame, digests: DataFrame, width: int) -> DataFrame:
    """``digest`` of the buckets in which two documents' canonical bytes differ.

    Grouping by hash and canonical text compares bytes inside equal buckets; copies meet in
    map-side partial groups, so a large group of copies is one row from each task.
    """
    same = docs.select(docs["text"].alias("text")).mapInArrow(_suspects(_shared_map(spark, digests), width), "digest string, plain string")
    return same.groupBy("digest", "plain").agg(F.count(F.lit(1)).alias("n")).groupBy("digest").count().where("count > 1").select("digest")


def _names(spark: SparkSession, docs: DataFrame, rows: DataFrame, width: int) -> DataFrame | None:
    """``(digest, check, fingerprint)`` of every text in the buckets that hold several; None where no bucket does.

    ``rows(doc_id, digest, check, made)``; ``made`` ones are edited texts, of which a bucket's are
    compared by the SHA-256 of their canonical bytes, and named after those of documents.
    """
    several = rows.select("digest", "check").distinct().groupBy("digest").count().where("count > 1").select("digest")
    several = scratch.save(spark, several.union(_crowded(spark, docs, rows.where("not made").select("digest"), width)).distinct(), "several")
    if several.isEmpty():
        return None
    texts = rows.join(several, "digest").groupBy("digest", "check").agg(F.min(F.struct("made", "doc_id")).alias("first"))
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("first", "check"))
    name = F.when(F.col("nth") == 1, F.col("digest")).otherwise(F.concat("digest", F.lit("-"), F.col("nth").cast("string")))
    return scratch.save(spark, texts.withColumn("nth", nth).select("digest", "check", name.alias("fingerprint")), "names")


def _named(rows: DataFrame, names: DataFrame | None, which: str, name: str) -> DataFrame:
    """``rows`` with the fingerprint of the text of ``{which}digest`` and ``{which}check`` as ``name``."""
    if names is None:
        return rows.withColumn(name, F.col(f"{which}digest"))
    other = names.select(F.col("digest").alias(f"{which}digest"), F.col("check").alias(f"{which}check"), F.col("fingerprint").alias(name))
    return rows.join(other, [f"{which}digest", f"{which}check"], "left").withColumn(name, F.coalesce(name, f"{which}digest"))


def _digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest(canonical(x), width) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([x[i] for x in found], pa.string()) for i in (0, 1))], ["doc_id", "digest", "check"])

    return run


def fingerprints(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row: doc_id, fingerprint, copies (rows with the same one), first (their smallest doc_id)."""
    rows = scratch.save(spark, docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_digests(width), "doc_id long, digest string, check string"), "digests")
    named = _named(rows, _names(spark, docs, rows.withColumn("made", F.lit(False)), width), "", "fingerprint")
    groups = named.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"))
    return named.join(groups, "fingerprint").select("doc_id", "fingerprint", "copies", "first")


HASHES = ["digest", "check", "edited_digest", "edited_check", "next_digest", "next_check"]
FIELDS = [("doc_id", pa.int64()), ("part", pa.int32()), ("place", pa.string()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), *((x, pa.string()) for x in HASHES), ("text", pa.string())]
SCHEMA = "doc_id long, part int, place string, n_chars long, edited_sha256 string, " + "".join(f"{x} string, " for x in HASHES) + "text string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, (_, t) in enumerate(FIELDS)], schema=pa.schema(FIELDS))


def _compared(text: str, own: tuple, following: str, theirs: tuple, width: int) -> tuple:
    other = edited(text, following)
    return len(text), hashlib.sha256(other.encode()).hexdigest(), *own, *digest(canonical(other), width), *theirs


def _in_order(width: int):
    """Compare each row with the one after it; a partition's first and last keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        waiting = None  # the row before: doc_id, text, digest, whether it is the first
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                now = (doc_id, text or "", digest(canonical(text), width), waiting is None)
                if waiting:
                    d, t, own, first = waiting
                    out.append((d, part, "first" if first else None, *_compared(t, own, now[1], now[2], width), t if first else None))
                waiting = now
            yield _batch(out)
        if waiting:
            d, t, own, first = waiting
            yield _batch([(d, part, "only" if first else "last", len(t), None, *own, None, None, None, None, t)])

    return run


def _at_edges(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(r["doc_id"], r["part"], r["place"], *_compared(r["text"], (r["digest"], r["check"]), r["next_text"], (r["next_digest"], r["next_check"]), width), None) for r in batch.to_pylist()])

    return run


def edit_stability(spark: SparkSession, docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Fingerprints beside those of half-replaced texts and of the next document.

    The next document is that with the next smaller doc_id, after the smallest the largest.
    Texts are dealt out by ranges of doc_id and read in order; only the first and last text
    of each range meet across ranges. Likeness is 1.0 for equal fingerprints, else 0.0.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(ranges, "doc_id").sortWithinPartitions(F.col("doc_id").desc(), "text")
    done = scratch.save(spark, ordered.mapInArrow(_in_order(width), SCHEMA), "compared")
    parts = sorted((r.part for r in done.where("place in ('last', 'only')").select("part").distinct().collect()), reverse=True)  # one number a range
    follow = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, following int")
    heads = done.where("place in ('first', 'only')").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("digest").alias("next_digest"), F.col("check").alias("next_check"))
    edges = done.where("place in ('last', 'only')").drop("next_digest", "next_check").join(follow, "part").join(heads, "following")
    met = edges.select("doc_id", "part", "place", "text", "digest", "check", "next_text", "next_digest", "next_check").mapInArrow(_at_edges(width), SCHEMA)
    whole = done.where("place is null or place = 'first'").union(scratch.save(spark, met, "edges"))
    texts = whole.select("doc_id", "digest", "check", F.lit(False).alias("made")).union(whole.select("doc_id", "edited_digest", "edited_check", F.lit(True)))
    names = _names(spark, docs, texts, width)
    named = whole
    for which, name in (("", "fingerprint"), ("edited_", "edited_fingerprint"), ("next_", "next_fingerprint")):
        named = _named(named, names, which, name)
    likeness = [(F.col("fingerprint") == F.col(f"{x}_fingerprint")).cast("double").alias(f"near_{x}") for x in ("edited", "next")]
    return named.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *likeness)
