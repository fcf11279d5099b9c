"""Reversible removal of lines that many documents share.

A line's key is the line without white space at its ends, A to Z in small letters, as 128
bits of xxHash. The exact side is a table of references, one signed row per key and document
(+1 inserted, -1 deleted), and one of counts per key: documents that hold it, and the largest
doc_id of them. Keys in force (of at least ``least`` characters, held by at least
``documents`` documents) are also in cuckoo filters, one chain of them for each shard of keys.
A line whose shard's filter knows nothing stays; of the others the counts decide, so a false
positive costs a look-up and changes nothing. Inserting and deleting documents adds keys to
the filters and takes keys out of them as their counts cross the limit, so the index after
``insert(a); insert(b); delete(b)`` is that after ``insert(a)``.

An operation reads the references once and writes those and the counts of the keys it
touches; references of a key that everything holds are dealt out by key and document, and
counted in part before they meet. Keys that one in ``HOT`` references names, at most ``HOT``
of them, are broadcast when lines meet counts.

Edge cases: a null or empty text is one empty line; a null doc_id is one document, smaller than
all others; rows that share a doc_id are one document for counts, and each loses its own lines;
repeated rows are repeated in the result; an empty table gives an empty one; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch

LEAST, DOCUMENTS = 20, 3
WHITE = " \t\n\v\f\r"
#: Keys in force per shard: bounds the rows of one task that builds filters, and a filter's size (4 MB).
SHARD_KEYS = 1 << 20
#: Keys held by one in so many references meet lines by a broadcast.
HOT = 1000
SLOTS, FINGERPRINT, KICKS = 4, (1 << 16) - 1, 500


class Cuckoo:
    """A chain of cuckoo filters of 16-bit fingerprints over 64-bit hashes; it grows by a filter of twice the size."""

    def __init__(self, tables: Iterable[bytes] = (), buckets: int = 64):
        self.tables = [array("H", t) for t in tables] or [array("H", bytes(2 * SLOTS * buckets))]

    @staticmethod
    def _places(key: int, buckets: int) -> tuple[int, int, int]:
        mark = (key & FINGERPRINT) or 1
        at = (key >> 16) % buckets
        return mark, at, at ^ (mark * 0x5BD1E995 % buckets)

    def _put(self, table: array, key: int) -> bool:
        buckets = len(table) // SLOTS
        mark, at, other = self._places(key, buckets)
        moved = []
        for kick in range(KICKS):
            for b in (at, other):
                for i in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not table[i]:
                        table[i] = mark
                        return True
            i = other * SLOTS + kick % SLOTS  # its fingerprint goes on to its other bucket
            moved.append((i, table[i]))
            table[i], mark = mark, table[i]
            at = other ^ (mark * 0x5BD1E995 % buckets)
            other = at
        for i, was in reversed(moved):
            table[i] = was
        return False

    def add(self, key: int) -> None:
        if not self._put(self.tables[-1], key):
            self.tables.append(array("H", bytes(4 * len(self.tables[-1]))))
            self.add(key)

    def remove(self, key: int) -> None:
        """Take out one copy of a key that was added."""
        for table in self.tables:
            mark, at, other = self._places(key, len(table) // SLOTS)
            for b in (at, other):
                for i in range(b * SLOTS, b * SLOTS + SLOTS):
                    if table[i] == mark:
                        table[i] = 0
                        return
        raise KeyError(key)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        found = np.zeros(len(keys), dtype=bool)
        mark = np.maximum(keys & np.uint64(FINGERPRINT), np.uint64(1))
        for table in self.tables:
            cells = np.frombuffer(table, dtype=np.uint16).reshape(-1, SLOTS)
            at = ((keys >> np.uint64(16)) % np.uint64(len(cells))).astype(np.int64)
            other = at ^ (mark * np.uint64(0x5BD1E995) % np.uint64(len(cells))).astype(np.int64)
            for b in (at, other):
                found |= (cells[b] == mark[:, None]).any(axis=1)
        return found


def line_key(line: str, least: int = LEAST) -> bytes | None:
    """The key of a line; None for one that is too short to be dropped."""
    plain = line.strip(WHITE)
    return xxhash.xxh3_128_digest(plain.encode().lower()) if len(plain) >= least else None  # bytes: A to Z only


def _references(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = {key for line in (text.as_py() or "").split("\n") if (key := line_key(line, least))}
                ids += [doc_id] * len(own)
                found += own
            pairs = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["doc_id", "hi", "lo"])

    return run


def _without(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, dropped = [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                lines = (text.as_py() or "").split("\n")
                drop = {pack("<qq", p["hi"], p["lo"]) for p in gone.as_py() or ()}
                kept = [x for x in lines if line_key(x, least) not in drop] if drop else lines
                texts.append("\n".join(kept))
                sizes.append(len(lines))
                dropped.append(len(lines) - len(kept))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return run


def _changed(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A shard's filters (``right``) after its ``left`` keys came into force (change 1) or went out of it (-1)."""
    chain = Cuckoo(right.sort_values("nth")["slots"]) if len(right) else Cuckoo(buckets=1 << max(int(len(left) * 1.2 / SLOTS).bit_length(), 4))
    for lo in left.loc[left["change"] < 0, "lo"]:
        chain.remove(int(lo) & (1 << 64) - 1)
    for lo in left.loc[left["change"] > 0, "lo"]:
        chain.add(int(lo) & (1 << 64) - 1)
    shard = (left if len(left) else right)["shard"].iloc[0]
    return pd.DataFrame({"shard": shard, "nth": range(len(chain.tables)), "slots": [t.tobytes() for t in chain.tables]})


def _probe(path: str):
    """Rows whose key's shard has a filter that may hold it; a task holds the filters of the shards it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[int, Cuckoo | None] = {}

        def chain(shard: int) -> Cuckoo | None:
            if shard not in chains:
                if len(chains) == 16:  # rows come in order of shards
                    chains.clear()
                fs, folder = scratch.open_fs(path)
                rows = pq.read_table(folder, filesystem=fs, filters=[("shard", "=", shard)]).sort_by("nth")
                chains[shard] = Cuckoo(rows["slots"].to_pylist()) if rows.num_rows else None
            return chains[shard]

        for batch in batches:
            shards, keys = batch.column("shard").to_numpy(), batch.column("lo").to_numpy().view(np.uint64)
            maybe = np.zeros(len(keys), dtype=bool)
            for shard in np.unique(shards):
                held = chain(int(shard))
                if held is not None:
                    own = np.flatnonzero(shards == shard)
                    maybe[own] = held.holds(keys[own])
            yield batch.filter(pa.array(maybe))

    return run


class LineIndex:
    """Lines of a changing set of documents, in tables of the shared folder; see the module."""

    def __init__(self, spark: SparkSession, least: int = LEAST, documents: int = DOCUMENTS):
        self.spark, self.least, self.documents = spark, least, documents
        self.references: DataFrame | None = None
        self.counts: DataFrame | None = None
        self.filters: DataFrame | None = None
        self.shards = 1

    def _lines(self, docs: DataFrame) -> DataFrame:
        return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_references(self.least), "doc_id long, hi long, lo long")

    def insert(self, docs: DataFrame) -> None:
        """Add documents; a doc_id that is there already gets the new lines besides its own."""
        self._apply(self._lines(docs).select("doc_id", "hi", "lo", F.lit(1).cast("byte").alias("sign")))

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents ``(doc_id)`` out with all their lines; unknown ones change nothing."""
        if self.references is not None:
            gone = doc_ids.select(F.col("doc_id").cast("long").alias("gone")).distinct()
            self._apply(self.references.join(gone, F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").withColumn("sign", (-F.col("sign")).cast("byte")))

    def _apply(self, signed: DataFrame) -> None:
        fresh = scratch.save(self.spark, signed, "references")
        everything = fresh if self.references is None else self.references.union(fresh)
        touched = None if self.counts is None else fresh.select("hi", "lo").distinct()
        some = everything if touched is None else everything.join(touched, ["hi", "lo"], "left_semi")
        # By key and document first: a key that every document holds is dealt over all tasks.
        each = some.groupBy("hi", "lo", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0")
        now = each.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last"))
        if touched is None:
            counts, before = scratch.save(self.spark, now, "counts"), None
            changes = counts.where(F.col("docs") >= self.documents).select("hi", "lo", F.lit(1).alias("change"))
        else:
            before = self.counts.join(touched, ["hi", "lo"], "left_semi").where(F.col("docs") >= self.documents).select("hi", "lo", F.lit(-1).alias("change"))
            counts = scratch.save(self.spark, self.counts.join(touched, ["hi", "lo"], "left_anti").union(now), "counts")
            after = counts.join(touched, ["hi", "lo"], "left_semi").where(F.col("docs") >= self.documents).select("hi", "lo", F.lit(1).alias("change"))
            changes = before.union(after).groupBy("hi", "lo").agg(F.sum("change").alias("change")).where("change <> 0")
        n = counts.where(F.col("docs") >= self.documents).count()
        if n > self.shards * SHARD_KEYS:  # more shards: all keys in force are dealt out anew
            self.shards = 1 << (n // SHARD_KEYS).bit_length()
            self.filters = None
            changes = counts.where(F.col("docs") >= self.documents).select("hi", "lo", F.lit(1).alias("change"))
        dealt = changes.select(self._shard(), "lo", "change")
        old = self.filters if self.filters is not None else self.spark.createDataFrame([], "shard int, nth int, slots binary")
        built = dealt.groupBy("shard").cogroup(old.groupBy("shard")).applyInPandas(_changed, "shard int, nth int, slots binary")
        self.filters = scratch.save(self.spark, built, "filters")
        self.references, self.counts = everything, counts

    def _shard(self):
        return F.pmod("hi", F.lit(self.shards)).cast("int").alias("shard")

    def _in_force(self, lines: DataFrame) -> DataFrame:
        """``lines(doc_id, hi, lo)`` of keys in force that another, larger document keeps."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        # A shard's rows are dealt over many tasks, so a hot key is, too.
        salt = F.pmod(F.xxhash64("doc_id", "lo"), F.lit(tasks))
        dealt = lines.select("doc_id", "hi", "lo", self._shard()).repartition(tasks, "shard", salt).sortWithinPartitions("shard")
        path = {f.rsplit("/", 1)[0] for f in self.filters.inputFiles()}
        maybe = dealt.mapInArrow(_probe(path.pop()), "doc_id long, hi long, lo long, shard int").drop("shard") if path else dealt.drop("shard").where("false")
        force = self.counts.where(F.col("docs") >= self.documents)
        total = self.counts.agg(F.sum("docs")).first()[0] or 0
        often = force.where(F.col("docs") * HOT >= total)  # not more than HOT keys
        met = maybe.join(F.broadcast(often.select("hi", "lo", F.col("last").alias("top"), F.lit(True).alias("hot"))), ["hi", "lo"], "left")
        rare = met.where("hot is null").select("hi", "lo", "doc_id").join(force.where(F.col("docs") * HOT < total).select("hi", "lo", F.col("last").alias("top")), ["hi", "lo"])
        return met.where("hot").select("doc_id", "hi", "lo", "top").union(rare.select("doc_id", "hi", "lo", "top")).where(~F.col("doc_id").eqNullSafe(F.col("top"))).drop("top")

    def kept(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, n_lines, n_dropped, kept_text)`` of documents that were inserted."""
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
        if self.references is None:
            return rows.withColumn("gone", F.lit(None).cast("array<struct<hi:bigint,lo:bigint>>")).mapInArrow(_without(self.least), "doc_id long, n_lines long, n_dropped long, kept_text string")
        dropped = self._in_force(self.references.where("sign > 0").select("doc_id", "hi", "lo"))
        gone = dropped.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set(F.struct("hi", "lo")).alias("gone"))
        joined = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", "text", "gone")
        return joined.mapInArrow(_without(self.least), "doc_id long, n_lines long, n_dropped long, kept_text string")


def dedup_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, kept_text)`` of a table of documents, inserted as one."""
    index = LineIndex(spark)
    index.insert(docs)
    return index.kept(docs)
