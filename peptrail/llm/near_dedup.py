"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Shingles of five words are weighted by their count in the document times their inverse
document frequency. Each of ``bands * rows`` sampling functions picks one shingle and weight
step per document, such that two documents pick the same with a probability equal to their
weighted Jaccard similarity; bands of ``rows`` picks are hashed to buckets, and documents
that share a bucket are compared exactly.

Rows of one text are one candidate from the start, and document frequencies count distinct
texts, so a group of copies does not make its own shingles common. They are counted over all
of them in ``2 ** DF_BITS`` hash bins, a table of fixed size: a shingle's frequency includes
that of the shingles that share its bin, which is about one text in a thousand at any input size.

In a bucket every document is compared with one pivot, at first the one that meets the most
documents in all its buckets, so work is linear in the bucket; buckets whose members are by
then of one class are settled, the others take another pivot. Documents of different classes
that still share a bucket meet once more on their rarest shingles (a prefix filter). Let W be a
document's weight and R its weight from a shingle on, rarest first. Two documents of similarity
t have t / (1 + t) of their joint weight in common, so the first shingle they share lies where
R >= 2t / (1 + t) W in the lighter and R >= t W in the heavier, and no candidate pair that
reaches the threshold is lost, whatever the bucket's size. Edits that few documents share fill
these prefixes, so copies that resemble each other only through their original do not meet.

Edge cases: a null text or one without words is in no class but its own; documents of one to
four words are one shingle of all their words; copies of any number are one class; rows that
share a doc_id and a text are one document, different texts under one doc_id are documents of
their own; a null doc_id counts as the largest; an empty table gives an empty result; other
columns are ignored, whatever their names. Texts are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch, textscan
from peptrail.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3  # a pair at the threshold shares a bucket with probability 1 - (1 - 0.8**3)**10 = 0.9992
DF_BITS = 18
ID_BITS = 44  # of a shingle's hash
TABLE_BITS = 16
PIVOT_ROUNDS = 2
BLOCK = 1 << 18
EPS = 1e-6
LAST = 2**63 - 1


def shingles(block: textscan.Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle ids of each row in ascending order, their counts, and where rows begin."""
    hashes = block.hashes()
    full = np.flatnonzero(block.left >= size)
    rows, ids = [block.row[full]], [textscan.windows(hashes, size)[full]]
    counts = np.diff(block.first)
    for n in range(1, size):
        short = np.flatnonzero(counts == n)
        if len(short):
            rows.append(short)
            ids.append(textscan.windows(hashes, n)[block.first[short]])
    rows, ids = np.concatenate(rows).astype(textscan.U), np.concatenate(ids)
    both, tf = np.unique((rows << textscan.U(ID_BITS)) | (ids >> textscan.U(64 - ID_BITS)), return_counts=True)
    first = np.searchsorted(both, np.arange(block.rows + 1, dtype=textscan.U) << textscan.U(ID_BITS))
    return both & textscan.U((1 << ID_BITS) - 1), tf, first


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << DF_BITS, dtype=np.int64)
        for batch in batches:
            for block in textscan.blocks(batch.column("text"), BLOCK):
                ids, _, _ = shingles(block, size)
                counts += np.bincount((ids >> textscan.U(ID_BITS - DF_BITS)).astype(np.int64), minlength=len(counts))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bin", "n"])

    return run


class Sampler:
    """Consistent weighted samples; the random variates of an element come from a fixed table."""

    def __init__(self, functions: int, idf: np.ndarray):
        random = np.random.Generator(np.random.PCG64(20100))
        size = 1 << TABLE_BITS
        r, c, beta = random.gamma(2, 1, size), random.gamma(2, 1, size), random.random(size)
        self.inverse, self.beta, self.r = ((1 / r).astype(np.float32), beta.astype(np.float32), r.astype(np.float32))
        self.offset = (np.log(c) - r + r * beta).astype(np.float32)
        self.odd = random.integers(0, 1 << 63, functions, dtype=np.uint64) * textscan.U(2) + textscan.U(1)
        self.idf = idf

    def weights(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return tf.astype(np.float32) * self.idf[(ids >> textscan.U(ID_BITS - DF_BITS)).astype(np.int64)]

    def samples(self, ids: np.ndarray, tf: np.ndarray, first: np.ndarray) -> np.ndarray:
        """``[functions, rows]`` picks; rows without shingles are 0."""
        n = np.diff(first)
        some = np.flatnonzero(n)
        out = np.zeros((len(self.odd), len(n)), dtype=textscan.U)
        if not len(some):
            return out
        log = np.log(self.weights(ids, tf))
        mixed, begin, n = textscan.mix(ids), first[:-1][some], n[some]
        for k, odd in enumerate(self.odd):
            at = ((mixed * odd) >> textscan.U(64 - TABLE_BITS)).astype(np.int64)
            step = np.floor(log * self.inverse[at] + self.beta[at])
            rank = self.offset[at] - self.r[at] * step
            least = np.minimum.reduceat(rank, begin)
            hits = np.flatnonzero(rank == np.repeat(least, n))
            pick = hits[np.searchsorted(hits, begin)]
            out[k, some] = textscan.mix(ids[pick] ^ textscan.mix(step[pick].astype(np.int64).view(textscan.U) + textscan.U(k + 1)))
        return out


def _signatures(size: int, bands: int, rows: int, idf: np.ndarray):
    schema = pa.schema([("id", pa.int64()), ("doc", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(bands * rows, idf)
        for batch in batches:
            for block in textscan.blocks(batch.column("text"), BLOCK):
                ids, tf, first = shingles(block, size)
                picks = sampler.samples(ids, tf, first).reshape(bands, rows, block.rows)
                keys = np.zeros((bands, block.rows), dtype=textscan.U)
                for i in range(rows):
                    keys = textscan.mix(keys * textscan.U(textscan.MULTIPLIER) + picks[:, i])
                keys = textscan.mix(keys + np.arange(bands, dtype=textscan.U)[:, None])
                some = np.diff(first) > 0
                lists = textscan.lists(np.where(some, bands, 0), textscan.signed(np.ascontiguousarray(keys.T[some]).ravel()))
                part = batch.slice(block.row0, block.rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("doc"), lists], schema=schema)

    return run


def _similar(size: int, idf: np.ndarray):
    """Weighted Jaccard similarity of ``text_a`` and ``text_b``."""

    def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sampler = Sampler(0, idf)
        for block in textscan.blocks(column, BLOCK):
            ids, tf, first = shingles(block, size)
            w = sampler.weights(ids, tf).astype(np.float64)
            for i in range(block.rows):
                yield ids[first[i] : first[i + 1]], w[first[i] : first[i + 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for (x, u), (y, v) in zip(features(batch.column("text_a")), features(batch.column("text_b")), strict=True):
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = x[at] == y if len(x) else np.zeros(len(y), dtype=bool)
                common = np.minimum(u[at[both]], v[both]).sum()
                total = u.sum() + v.sum() - common
                out.append(common / total if total else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], ["a", "b", "similarity"])

    return run


def _weighted(size: int, idf: np.ndarray):
    """``(id, total, found)``: a text's weight and its shingles with theirs."""
    schema = pa.schema([("id", pa.int64()), ("total", pa.float64()), ("found", pa.list_(pa.struct([("s", pa.int64()), ("w", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(0, idf)
        for batch in batches:
            for block in textscan.blocks(batch.column("text"), BLOCK):
                ids, tf, first = shingles(block, size)
                w = sampler.weights(ids, tf).astype(np.float64)
                sums = np.concatenate([[0.0], np.cumsum(w)])
                values = pa.StructArray.from_arrays([textscan.signed(ids), pa.array(w)], ["s", "w"])
                part = batch.slice(block.row0, block.rows)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(sums[first])), textscan.lists(np.diff(first), values)], schema=schema)

    return run


def _prefix_pairs(spark: SparkSession, texts: DataFrame, open_: DataFrame, similarity: float, size: int, idf: np.ndarray) -> DataFrame:
    """``(a, b)``: the pairs of different classes of ``open_(id, class)`` that can reach the similarity."""
    found = scratch.save(spark, texts.join(open_, "id").select("id", "text").mapInArrow(_weighted(size, idf), "id long, total double, found array<struct<s:long,w:double>>"), "weighted")
    each = found.select("id", F.explode("found").alias("x")).select("id", "x.s", "x.w")
    common = scratch.save(spark, each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "common")
    held = each.join(common, "s").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "s", "w"))).alias("held"))
    # The weight from each shared shingle on, rarest first; what no other document has lies before them all.
    shared = F.aggregate("held", F.lit(0.0), lambda a, x: a + x["w"])
    start = F.struct(shared.alias("rest"), F.array().cast("array<struct<s:bigint,rest:double>>").alias("out"))
    most = similarity * F.col("total") - EPS
    step = lambda a, x: F.struct((a["rest"] - x["w"]).alias("rest"), F.when(a["rest"] >= most, F.concat(a["out"], F.array(F.struct(x["s"].alias("s"), a["rest"].alias("rest"))))).otherwise(a["out"]).alias("out"))
    prefix = held.join(found.select("id", "total"), "id").select("id", "total", F.explode(F.aggregate("held", start, step)["out"]).alias("x")).select("id", "total", "x.s", "x.rest")
    prefix = scratch.save(spark, prefix.join(open_, "id"), "prefixes")
    light, heavy = prefix.where(F.col("rest") >= 2 * similarity / (1 + similarity) * F.col("total") - EPS).alias("x"), prefix.alias("y")
    order = (F.col("x.total") < F.col("y.total")) | ((F.col("x.total") == F.col("y.total")) & (F.col("x.id") < F.col("y.id")))
    reach = F.least("x.rest", "y.rest", "x.total") >= similarity / (1 + similarity) * (F.col("x.total") + F.col("y.total")) - EPS
    met = light.join(heavy, (F.col("x.s") == F.col("y.s")) & (F.col("x.class") != F.col("y.class")) & order & reach)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))


def _classed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """``members`` with the class of each document, and only buckets of several classes."""
    known = members.drop("class").join(classes.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id"))
    open_ = known.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("bucket")
    return known.join(open_, "bucket", "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per input row: doc_id, class_id (smallest doc_id of its class), kept, text_key.

    In buckets, pairs and classes ``id`` is a text's key, as a doc_id may name several texts.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("id"), text.alias("text"))
    distinct = scratch.save(spark, keyed.groupBy("id").agg(F.min("doc").alias("doc"), F.first("text").alias("text")), "distinct")
    df = distinct.select("text").mapInArrow(_frequencies(size), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()  # 2 ** DF_BITS rows at most
    total = distinct.count()
    counts = np.zeros(1 << DF_BITS)
    counts[df["bin"].to_numpy()] = df["n"].to_numpy()
    idf = (1 + np.log((1 + total) / (1 + np.minimum(counts, total)))).astype(np.float32)

    signed = scratch.save(spark, distinct.mapInArrow(_signatures(size, bands, rows, idf), "id long, doc long, bands array<long>"), "signatures")
    each = signed.select("id", F.explode("bands").alias("bucket"))
    shared = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = scratch.save(spark, each.join(shared, "bucket"), "met")
    # How many documents a document meets in its buckets: the original of a group of copies
    # meets more of them than its copies do, which differ from each other twice as much.
    members = scratch.save(spark, met.join(met.groupBy("id").agg(F.sum("n").alias("degree")), "id").drop("n"), "members")
    # A merge join at every size: the members grow with the documents.
    texts = scratch.save(spark, distinct.select("id", "text").join(members.select("id").distinct().hint("merge"), "id", "left_semi"), "texts")

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        a, b = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
        return scratch.save(spark, pairs.join(b, "b").join(a, "a").mapInArrow(_similar(size, idf), "a long, b long, similarity double"), name)

    done = links = None
    classes = spark.createDataFrame([], "id long, component long")
    unsettled = members.withColumn("class", F.col("id"))
    for step in range(PIVOT_ROUNDS + 1):
        if step < PIVOT_ROUNDS:
            pivot = F.min(F.struct((-F.col("degree") if step == 0 else F.xxhash64("id", F.lit(step))).alias("turn"), "id", "class"))
            pivots = unsettled.groupBy("bucket").agg(pivot.alias("p")).select("bucket", F.col("p.id").alias("pivot"), F.col("p.class").alias("of"))
            pairs = unsettled.join(pivots, "bucket").where("class <> of").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))
        else:
            pairs = _prefix_pairs(spark, texts, scratch.save(spark, unsettled.select("id", "class").distinct(), "open"), similarity, size, idf)
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        found = verify(pairs, f"verified{step}")
        done = found.select("a", "b") if done is None else done.union(found.select("a", "b"))
        near = found.where(F.col("similarity") >= similarity).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        if not near.isEmpty():
            links = near if links is None else links.union(near)
            classes = components(spark, links)
        if step < PIVOT_ROUNDS:
            unsettled = scratch.save(spark, _classed(unsettled, classes), f"unsettled{step}")
            if step == 0:  # a bucket of two has been compared whole
                several = unsettled.groupBy("bucket").count().where("count > 2").select("bucket")
                unsettled = scratch.save(spark, unsettled.join(several, "bucket", "left_semi"), "several")
            if unsettled.isEmpty():
                break
    scratch.drop(spark, distinct, texts, met, members)
    docs_of = signed.where(F.size("bands") > 0).select("id", "doc")
    names = docs_of.join(classes, "id").groupBy("component").agg(F.min(F.struct("doc", "id")).alias("least"))
    of = classes.join(names, "component").select("id", F.col("least.doc").alias("class"), F.col("least.id").alias("class_key"))
    first = docs_of.join(of, "id", "left").select("id", F.coalesce("class", "doc").alias("class"), F.coalesce("class_key", "id").alias("class_key"))
    out = keyed.select("doc", "id").join(first, "id", "left").withColumns({"class": F.coalesce("class", "doc"), "class_key": F.coalesce("class_key", "id")})
    kept = (F.col("doc") == F.col("class")) & (F.col("id") == F.col("class_key"))
    return out.select(F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), F.when(F.col("class") != LAST, F.col("class")).alias("class_id"), kept.alias("kept"), F.col("id").alias("text_key"))
