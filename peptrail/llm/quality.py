"""Quality classifier: an interpolated modified Kneser-Ney model of characters, scored on held-out folds.

N-grams of ``ORDER`` characters are counted over every trusted text (label quality 1), with
interpolated modified Kneser-Ney discounts at every order. A text belongs to one of ``FOLDS``
folds by its hash; each fold's model is counted on the trusted texts of the other folds, and
every document, trusted or not, is scored by the model of its own fold, which has not seen its
text. A document is rejected if its perplexity per character exceeds its language's quantile of
the trusted documents' held-out perplexities. Nothing is sampled: all trusted texts train and
all set thresholds.

Counts, contexts and probabilities are tables of n-grams joined by shuffles. The model is then
written to the shared folder in shards of about ``SHARD`` rows by key. A task looks up the
distinct n-grams of ``GROUP`` blocks of text at once, in the order of shards, so each shard is
read once for them and a bounded number is held: memory does not grow with the model. Quantiles
are found by counts of ever narrower ranges of the perplexity's bits, with no group of all rows.

Edge cases: a null or empty text has no perplexity and is kept, and so is one whose fold has no
model, for want of trusted text in the others; a null or untrusted language takes the quantile
over all trusted documents; rows that share a doc_id share its label; repeated labels count
once and any quality of 1 makes a document trusted; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.llm import scratch, textscan

ORDER = 5
FOLDS = 2
START = 0x10FFFF  # no character; stands before a text
GONE = 0xFFFD  # stands for a NUL, at which arrays of strings end
SHARD = 250_000
SHARDS_HELD = 16
#: Blocks of text whose n-grams are looked up together.
GROUP = 8
BLOCK = 1 << 19
#: Rows of counts that a task holds before it passes them on.
COUNTS_HELD = 400_000
QUANTILE = 0.995
#: Without any discount nothing would be left for what was never seen.
LEAST_DISCOUNT = 0.05
#: Bits by which the levels of the quantile search tell perplexities apart.
BITS = (44, 22, 0)
EVERY = "*"  # the group of all languages
FACTORS = textscan.mix(np.arange(1, ORDER + 1, dtype=textscan.U)) | textscan.U(1)


def _salt(kind: int, order: int, fold: np.ndarray) -> np.ndarray:
    """What tells the keys of n-grams (0) and contexts (1), of orders and of folds apart."""
    return textscan.mix(((np.asarray(fold, dtype=textscan.U) << textscan.U(8)) + textscan.U(order * 2 + kind)))


def _sum(chars: np.ndarray, size: int) -> np.ndarray:
    """The key, before its salt, of the last ``size`` columns of characters."""
    total = np.zeros(len(chars), textscan.U)
    for k in range(size):
        total += (chars[:, chars.shape[1] - 1 - k].astype(textscan.U) + textscan.U(1)) * FACTORS[k]
    return total


class Grams:
    """The n-grams of the highest order that end at each character of a block."""

    def __init__(self, block: textscan.Block, folds: np.ndarray):
        chars = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        self.begins = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])[block.offsets]
        row = np.repeat(np.arange(block.rows, dtype=np.int32), np.diff(self.begins))
        padded = np.insert(np.where(chars == 0, np.uint32(GONE), chars), np.repeat(self.begins[:-1], ORDER - 1), np.uint32(START))
        windows = np.lib.stride_tricks.sliding_window_view(padded, ORDER) if len(padded) >= ORDER else np.empty((0, ORDER), np.uint32)
        at = np.arange(len(chars)) + (ORDER - 1) * row
        fold = folds[block.row0 + row].astype(np.int32)
        total = np.zeros(len(windows), textscan.U)
        for k in range(ORDER):
            total += (windows[:, ORDER - 1 - k].astype(textscan.U) + textscan.U(1)) * FACTORS[k]
        keys = textscan.mix(total[at] ^ _salt(0, ORDER, np.arange(FOLDS))[fold])
        self.keys, first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.inverse, self.chars, self.folds = self.inverse.astype(np.int32), windows[at[first]].copy(), fold[first]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(gram, n0, n1, …)`` of ``(fold, text)``: the n-grams of the highest order and their counts by fold."""
    keys, counts, chars = np.empty(0, textscan.U), np.empty((0, FOLDS), np.int64), np.empty((0, ORDER), np.uint32)

    def out() -> pa.RecordBatch:
        # Neighbours that begin alike take a quarter less room in a shuffle (39 MB against 53 for 0.1 GB).
        order = np.argsort(sum((chars[:, k].astype(textscan.U) & textscan.U(0xFFF)) << textscan.U(12 * (ORDER - 1 - k)) for k in range(ORDER)), kind="stable")
        names = np.ascontiguousarray(chars[order]).view(f"<U{ORDER}").ravel() if len(chars) else np.empty(0, "<U1")
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array(counts[order, f]) for f in range(FOLDS))], ["gram", *(f"n{f}" for f in range(FOLDS))])

    for batch in batches:
        fold = batch.column("fold").to_numpy()
        for block in textscan.blocks(batch.column("text"), BLOCK):
            found = Grams(block, np.zeros(len(fold), np.int32))
            own = np.repeat(fold[block.row0 : block.row0 + block.rows], np.diff(found.begins))
            mine = np.stack([np.bincount(found.inverse[own == f], minlength=len(found.keys)) for f in range(FOLDS)], axis=1)
            both, first, inverse = np.unique(np.concatenate([keys, found.keys]), return_index=True, return_inverse=True)
            sums = np.zeros((len(both), FOLDS), np.int64)
            np.add.at(sums, inverse, np.concatenate([counts, mine]))
            counts, chars, keys = sums, np.concatenate([chars, found.chars])[first], both
            if len(keys) > COUNTS_HELD:
                yield out()
                keys, counts, chars = keys[:0], counts[:0], chars[:0]
    yield out()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(key, value)`` of ``(kind, fold, gram, value)``."""
    for batch in batches:
        if not batch.num_rows:
            continue
        chars = np.array(batch.column("gram").to_pylist(), dtype=f"<U{ORDER}").view(np.uint32).reshape(-1, ORDER)
        size = (chars != 0).sum(axis=1)
        total = np.zeros(len(size), textscan.U)
        for k in range(ORDER):
            there = size > k
            total[there] += (chars[there, size[there] - 1 - k].astype(textscan.U) + textscan.U(1)) * FACTORS[k]
        kind, fold = batch.column("kind").to_numpy(), batch.column("fold").to_numpy()
        salt = np.zeros(len(size), textscan.U)
        for k in (0, 1):
            for order in range(1, ORDER + 1):
                some = (kind == k) & (size == order)
                salt[some] = _salt(k, order, fold[some])
        yield pa.RecordBatch.from_arrays([textscan.signed(textscan.mix(total ^ salt)), batch.column("value")], ["key", "value"])


def fold_of(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(FOLDS)).cast("int")


def _discounts(counts: DataFrame) -> Column:
    """The discount of a row by its fold and count; 0.5, 1 and 1.5 where the counts of counts are too thin."""
    found = counts.groupBy("fold").agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5))).collect()  # one row a fold
    out = F.lit(None).cast("double")
    for row in found:
        some = [row[f"n{k}"] for k in range(1, 5)]
        d = [0.5, 1.0, 1.5]
        if all(some):
            y = some[0] / (some[0] + 2 * some[1])
            d = [min(max(k - (k + 1) * y * some[k] / some[k - 1], LEAST_DISCOUNT), float(k)) for k in (1, 2, 3)]
        mine = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        out = F.when(F.col("fold") == row["fold"], mine).otherwise(out)
    return out


def train(spark: SparkSession, trusted: DataFrame) -> tuple[str, int, dict[int, float]]:
    """Write the models of ``trusted(fold, text)``; returns their folder, the number of shards
    and, by fold, the probability of a character never seen (none: no model)."""
    names = [f"n{f}" for f in range(FOLDS)]
    counted = trusted.select("fold", "text").mapInArrow(_counts, "gram string, " + ", ".join(f"{n} long" for n in names)).groupBy("gram").agg(*(F.sum(n).alias(n) for n in names))
    # A fold's model holds what the other folds count.
    others = [F.struct(F.lit(f).alias("fold"), sum((F.col(n) for g, n in enumerate(names) if g != f), F.lit(0)).cast("long").alias("n")) for f in range(FOLDS)]
    grams = scratch.save(spark, counted.select("gram", F.explode(F.array(*others)).alias("x")).select("x.fold", "gram", "x.n").where("n > 0"), f"grams{ORDER}")
    levels = [grams]
    for k in range(ORDER - 1, 0, -1):  # how many characters stand before each shorter n-gram
        levels.insert(0, scratch.save(spark, levels[0].groupBy("fold", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"grams{k}"))
    unigrams, d = levels[0], _discounts(levels[0])
    sums = unigrams.groupBy("fold").agg(F.sum("n").alias("total"), F.sum(d).alias("mass"), F.count(F.lit(1)).alias("kinds")).collect()  # one row a fold
    if not sums:
        return "", 0, {}
    floors = {r.fold: r.mass / r.total / (r.kinds + 1) for r in sums}  # the one more is any unseen character
    of_fold = lambda values: reduce(lambda out, f: F.when(F.col("fold") == f, F.lit(values[f])).otherwise(out), values, F.lit(None).cast("double"))
    totals = of_fold({r.fold: float(r.total) for r in sums})
    lower = scratch.save(spark, unigrams.select("fold", "gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / totals + of_fold(floors)).alias("value")), "p1")
    tables = [lower.withColumn("kind", F.lit(0))]
    for k, counts in enumerate(levels[1:], 2):
        d = _discounts(counts)
        context = F.substring("gram", 1, k - 1)
        contexts = counts.groupBy("fold", context.alias("context")).agg(F.sum("n").alias("total"), F.sum(d).alias("mass"))
        contexts = scratch.save(spark, contexts.select("fold", "context", "total", (F.col("mass") / F.col("total")).alias("rest")), f"contexts{k}")
        below = lower.select("fold", F.col("gram").alias("suffix"), F.col("value").alias("below"))
        seen = counts.withColumns({"context": context, "suffix": F.substring("gram", 2, k - 1)}).join(contexts, ["fold", "context"]).join(below, ["fold", "suffix"])
        lower = scratch.save(spark, seen.select("fold", "gram", (F.greatest(F.col("n") - d, F.lit(0.0)) / F.col("total") + F.col("rest") * F.col("below")).alias("value")), f"p{k}")
        tables += [lower.withColumn("kind", F.lit(0)), contexts.select("fold", F.col("context").alias("gram"), F.col("rest").alias("value"), F.lit(1).alias("kind"))]
    shards = 1 + sum(t.count() for t in tables) // SHARD
    rows = reduce(DataFrame.union, (t.select("kind", "fold", "gram", "value") for t in tables)).mapInArrow(_keys, "key long, value double")
    folder = scratch.new_path(spark, "model")
    rows.withColumn("shard", F.pmod("key", F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "key").write.partitionBy("shard").parquet(folder)
    scratch.drop(spark, *levels, *tables)
    return folder, shards, floors


class Model:
    """Lookups in the shards of the models."""

    def __init__(self, folder: str, shards: int, floors: dict[int, float]):
        self.folder, self.shards, self.held = folder, shards, OrderedDict()
        self.floors = np.array([floors.get(f, np.nan) for f in range(FOLDS)])

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.held:
            from pyarrow import fs

            store, path = scratch.open_fs(f"{self.folder}/shard={k}")
            files = [x.path for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if x.path.endswith(".parquet")]
            key, value = np.empty(0, np.int64), np.empty(0)
            if files:
                table = pa.concat_tables([pq.read_table(f, filesystem=store, partitioning=None) for f in files])
                key, value = table.column("key").to_numpy(), table.column("value").to_numpy()
            order = np.argsort(key, kind="stable")
            self.held[k] = key[order], value[order]
            if len(self.held) > SHARDS_HELD:
                self.held.popitem(last=False)
        self.held.move_to_end(k)
        return self.held[k]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, NaN where there is none."""
        keys, out = keys.view(np.int64), np.full(len(keys), np.nan)
        of = keys % self.shards
        order = np.argsort(of, kind="stable")
        cuts = np.searchsorted(of[order], np.arange(self.shards + 1))
        for k in range(self.shards):
            rows = order[cuts[k] : cuts[k + 1]]
            if len(rows):
                known, values = self.shard(k)
                at = np.searchsorted(known, keys[rows])
                at[at == len(known)] = 0
                hit = known[at] == keys[rows] if len(known) else np.zeros(len(rows), dtype=bool)
                out[rows[hit]] = values[at[hit]]
        return out

    def probability(self, fold: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Of each n-gram's last character after those before it."""
        out, rest, left = np.full(len(fold), np.nan), np.ones(len(fold)), np.arange(len(fold))
        for k in range(ORDER, 0, -1):
            found = self.get(textscan.mix(_sum(chars[left], k) ^ _salt(0, k, fold[left])))
            hit = ~np.isnan(found)
            out[left[hit]] = rest[left[hit]] * found[hit]
            left = left[~hit]
            if k > 1 and len(left):
                more = self.get(textscan.mix(_sum(chars[left, :-1], k - 1) ^ _salt(1, k - 1, fold[left])))
                rest[left] *= np.where(np.isnan(more), 1.0, more)
        out[left] = rest[left] * self.floors[fold[left]]
        return out


_models: dict[str, Model] = {}


def _perplexities(model: Model, folds: np.ndarray, group: list[textscan.Block]) -> list[np.ndarray]:
    """Of the rows of each block of a group, whose distinct n-grams are looked up together."""
    grams = [Grams(block, folds) for block in group]
    _, where, back = np.unique(np.concatenate([g.keys for g in grams]), return_index=True, return_inverse=True)
    logs = np.log(model.probability(np.concatenate([g.folds for g in grams])[where], np.concatenate([g.chars for g in grams])[where]))
    out, used = [], 0
    for g in grams:
        each = logs[back[used : used + len(g.keys)]][g.inverse]
        used += len(g.keys)
        total = np.concatenate([[0.0], np.cumsum(each)])
        with np.errstate(invalid="ignore", divide="ignore"):
            out.append(np.exp(-np.diff(total[g.begins]) / np.diff(g.begins)))
    return out


def _score(folder: str, shards: int, floors: dict[int, float]):
    """``(doc_id, lang, text_key, perplexity, bits)``; bits are in the order of perplexities."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text_key", pa.int64()), ("perplexity", pa.float64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if folder not in _models:
            _models.clear()
            _models[folder] = Model(folder, shards, floors)
        for batch in batches:
            folds, waiting, out = batch.column("fold").to_numpy(), [], []
            for block in textscan.blocks(batch.column("text"), BLOCK):
                waiting.append(block)
                if len(waiting) == GROUP:
                    out += _perplexities(_models[folder], folds, waiting)
                    waiting = []
            if waiting:
                out += _perplexities(_models[folder], folds, waiting)
            worth = np.concatenate(out) if out else np.empty(0)
            none = ~np.isfinite(worth)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "text_key")), pa.array(worth, pa.float64(), mask=none), pa.array(worth.view(np.int64), pa.int64(), mask=none)], schema=schema)

    return run


def thresholds(spark: SparkSession, scores: DataFrame, quantile: float) -> DataFrame:
    """``(lang, most)`` for every language of ``scores(lang, perplexity, bits)`` and for ``EVERY``.

    The least perplexity that at least the quantile of the scores do not exceed. Scores are
    counted by the leading bits, and only the range in which the rank falls is counted further.
    """
    own = scores.where("bits is not null and lang is not null").select("lang", "perplexity", "bits")
    each = scratch.save(spark, own.union(scores.where("bits is not null").select(F.lit(EVERY), "perplexity", "bits")), "trusted_scores")
    ranks = each.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) * F.lit(quantile)).alias("rank"))
    state = ranks.select("lang", F.greatest("rank", F.lit(1)).alias("rank"), F.lit(None).cast("long").alias("within"), F.lit(0).cast("long").alias("before"))
    width = 64
    for bits in BITS:
        inside = each.join(state, "lang").where(F.col("within").isNull() | (F.shiftright("bits", width % 64) == F.col("within")))
        bins = inside.groupBy("lang", "rank", "before", F.shiftright("bits", bits).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("perplexity").alias("most"))
        run = F.col("before") + F.sum("n").over(Window.partitionBy("lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        first = bins.withColumn("run", run).where("run >= rank").groupBy("lang").agg(F.min(F.struct("bin", "run", "n", "rank", "most")).alias("x"))
        state = scratch.save(spark, first.select("lang", F.col("x.rank").alias("rank"), F.col("x.bin").alias("within"), (F.col("x.run") - F.col("x.n")).alias("before"), F.col("x.most").alias("most")), f"quantile{bits}")
        width = bits
        each_state = state.select("lang", "most")
        state = state.drop("most")
    return each_state


def _trusted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    good = labels.where(labels["quality"] == 1).select(labels["doc_id"].cast("long").alias("doc_id")).distinct()
    # A merge join at every size: labels grow with the documents.
    return rows.join(good.hint("merge"), "doc_id", "left_semi")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per row: doc_id, lang, perplexity, most (the threshold), kept, text_key."""
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), F.xxhash64(text).alias("text_key"), fold_of(text).alias("fold"), text.alias("text"))
    folder, shards, floors = train(spark, _trusted(rows.select("doc_id", "fold", "text"), labels))
    if not floors:
        return rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("most"), F.lit(True).alias("kept"), "text_key")
    scored = scratch.save(spark, rows.mapInArrow(_score(folder, shards, floors), "doc_id long, lang string, text_key long, perplexity double, bits long"), "scores")
    limits = thresholds(spark, _trusted(scored, labels), quantile)
    overall = limits.where(F.col("lang") == EVERY).select(F.col("most").alias("overall"))  # one row, or none
    own = limits.where(F.col("lang") != EVERY).select(F.col("lang").alias("of"), F.col("most").alias("own"))
    limited = scored.join(own, F.col("lang") == F.col("of"), "left").join(F.broadcast(overall), F.lit(True), "left").withColumn("most", F.coalesce("own", "overall"))
    return limited.select("doc_id", "lang", "perplexity", "most", F.coalesce(F.col("perplexity") <= F.col("most"), F.lit(True)).alias("kept"), "text_key")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that are not rejected."""
    bad = classify(spark, docs, labels, quantile).where("not kept").select("text_key", F.col("lang").alias("bad_lang")).distinct()
    bad = scratch.save(spark, bad, "rejected")
    same = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["text_key"]) & docs["lang"].cast("string").eqNullSafe(bad["bad_lang"])
    return docs.join(bad, same, "left_anti")
