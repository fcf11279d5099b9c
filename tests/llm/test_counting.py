"""Clustering, collocations and line dedup against brute force, on rows with nulls, ties, copies and clashing columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from peptrail.llm import clustering, collocations, line_dedup
from peptrail.llm.clustering import cluster_vectors
from peptrail.llm.line_dedup import Cuckoo, LineIndex, dedup_lines

draw = random.Random(11)
CLASH = "cluster string, slot string, shard string, n string, hi string, lo string, a string, key string, stream string, gone string, id string"
X = ("x",) * 11


# -- lines -------------------------------------------------------------------------------------

SHARED = ["A line that many documents hold", "\t a LINE that many documents hold  ", "exactly twenty chars", "nineteen characters", "İstanbul is a line of its own", "Another shared line, of some length"]


def line_documents():
    rows = [(None, "\n".join(SHARED)), (None, SHARED[0]), (1, None), (2, ""), (3, "\n\n"), (4, SHARED[0] + "\r\n" + SHARED[0]), (5, SHARED[1]), (9, "x\n" + "\n".join(SHARED)), (9, SHARED[0] + "\nmore"), (6, SHARED[4].lower()), (7, "z" * 300_000 + "\n" + SHARED[5])]
    for i in range(20, 60):
        rows.append((i, "\n".join(draw.choice(SHARED + [f"line number {i} of a document", "", "short"]) for _ in range(draw.randrange(1, 9)))))
    rows.append(rows[-1])
    return rows


def line_key(line):
    plain = line.strip(" \t\v\f\r")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in plain) if len(plain) >= 20 else None


def lines_kept(rows, held=None):
    own = collections.defaultdict(set)
    for i, text in held or rows:
        for key in {line_key(x) for x in (text or "").split("\n")} - {None}:
            own[key].add(i)
    last = {k: max(v, key=lambda i: (i is not None, i or 0)) for k, v in own.items() if len(v) >= 3}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if line_key(x) not in last or last[line_key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def line_table(spark, rows):
    return spark.createDataFrame([(*r, *X) for r in rows], "doc_id int, text string, " + CLASH).repartition(3)


def same_lines(df, want):
    assert sorted((tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()), key=repr) == want


def test_lines(spark):
    rows = line_documents()
    same_lines(dedup_lines(spark, line_table(spark, rows)), lines_kept(rows))
    assert dedup_lines(spark, line_table(spark, rows).where("false")).count() == 0


def test_lines_with_crowded_filters_and_many_shards(spark, monkeypatch):
    """False positives everywhere, keys that are never hot, and more keys in force than a shard takes."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(line_dedup, "HOT", 1)
    monkeypatch.setattr(Cuckoo, "holds", lambda self, keys: np.ones(len(keys), dtype=bool))
    rows = line_documents()
    same_lines(dedup_lines(spark, line_table(spark, rows)), lines_kept(rows))


def test_lines_are_reversible(spark):
    rows = [r for r in line_documents() if r[0] is not None]
    first, second = [r for r in rows if r[0] % 2], [r for r in rows if not r[0] % 2]
    index = LineIndex(spark)
    index.delete(spark.createDataFrame([(1,)], "doc_id int"))
    index.insert(line_table(spark, first))
    before = index.filters.collect(), sorted(index.counts.collect())
    index.insert(line_table(spark, second))
    same_lines(index.kept(line_table(spark, rows)), lines_kept(rows))
    index.delete(spark.createDataFrame([(r[0],) for r in second] + [(-5,)], "doc_id int"))
    same_lines(index.kept(line_table(spark, first)), lines_kept(first))
    assert sorted(index.counts.collect()) == before[1]
    assert sum(np.count_nonzero(np.frombuffer(r.slots, np.uint16)) for r in index.filters.collect()) == sum(np.count_nonzero(np.frombuffer(r.slots, np.uint16)) for r in before[0])
    index.delete(spark.createDataFrame([(max(r[0] for r in first),)], "doc_id int"))  # the document that kept the lines
    less = [r for r in first if r[0] != max(r[0] for r in first)]
    same_lines(index.kept(line_table(spark, less)), lines_kept(less))


def test_cuckoo_filter():
    keys = [draw.getrandbits(64) for _ in range(3000)]
    chain = Cuckoo(buckets=16)
    for k in keys:
        chain.add(k)
    assert len(chain.tables) > 1 and chain.holds(np.array(keys, np.uint64)).all()
    again = Cuckoo([t.tobytes() for t in chain.tables])
    for k in keys[:1500]:
        again.remove(k)
    assert again.holds(np.array(keys[1500:], np.uint64)).all()
    others = np.array([draw.getrandbits(64) for _ in range(20000)], np.uint64)
    assert again.holds(others).mean() < 0.02
    for k in keys[1500:]:
        again.remove(k)
    assert not any(np.frombuffer(t, np.uint16).any() for t in again.tables)
    with pytest.raises(KeyError):
        again.remove(5)


# -- clusters ----------------------------------------------------------------------------------


def vectors(n, dims=64):
    rows = [(None, [0.5] * dims), (1, None), (2, []), (3, [0.1] * (dims - 1)), (4, [None] + [0.1] * (dims - 1)), (5, [math.nan] + [0.1] * (dims - 1)), (6, [math.inf] + [0.1] * (dims - 1)), (7, [3e6] + [0.1] * (dims - 1))]
    spots = [[draw.gauss(0, 1) for _ in range(dims)] for _ in range(9)]
    for i in range(10, 10 + n):
        rows.append((i, [x + draw.gauss(0, 0.05) for x in draw.choice(spots)] if i % 5 else [float(i % 3)] * dims))
    return rows + rows[12:16] + [(10, [0.0] * dims)]


def clusters(rows, k=16):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) and abs(x) < 1 << 21 for x in v)]
    ranked = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in ranked[:k]]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for step in range(4):
        where = [min(range(len(centroids)), key=lambda c: (square(x, centroids[c]), c)) for _, x in kept]  # noqa: B023
        if step < 3:
            for c in range(len(centroids)):
                own = [x for (_, x), w in zip(kept, where, strict=True) if w == c]
                centroids[c] = [sum(v) // len(own) for v in zip(*own, strict=True)] if own else centroids[c]
    out = [(i, c, square(x, centroids[c]), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (i, x), c in zip(kept, where, strict=True)]
    return sorted(((i, c, d, sum(r[2] for r in out if r[1] == c), sum(r[2] for r in out), s) for i, c, d, s in out), key=repr)


def vector_table(spark, rows):
    return spark.createDataFrame([(*r, *X) for r in rows], "vec_id long, embedding array<float>, " + CLASH).repartition(3)


@pytest.mark.parametrize("leaf", [1, 24])
def test_clusters(spark, monkeypatch, leaf):
    monkeypatch.setattr(clustering, "LEAF", leaf)
    rows = vectors(300)
    assert sorted((tuple(r) for r in cluster_vectors(spark, vector_table(spark, rows)).collect()), key=repr) == clusters(rows)


def test_few_vectors(spark):
    rows = vectors(0)[:1] + vectors(3)[8:11]
    assert sorted((tuple(r) for r in cluster_vectors(spark, vector_table(spark, rows)).collect()), key=repr) == clusters(rows)
    assert cluster_vectors(spark, vector_table(spark, vectors(0)[1:8])).count() == 0


def test_balls_are_assigned_whole():
    """Well separated clusters: few points are compared one by one, and all sums are exact."""
    spots = np.random.default_rng(1).integers(-5000, 5000, (16, 64))
    points = np.repeat(spots, 200, axis=0) + np.random.default_rng(2).integers(-20, 20, (3200, 64))
    order, balls = clustering._balls(points)
    points = points[order].astype(np.int32)
    sums = np.array([points[a:b].sum(axis=0, dtype=np.int64) for a, b, _, _ in balls])
    radii = np.array([np.sqrt(((points[a:b] - s / (b - a)) ** 2).sum(axis=1).max()) for (a, b, _, _), s in zip(balls, sums, strict=True)])
    cluster, counts, totals, compared = clustering.assign(points, balls, sums, radii, spots)
    want = ((points[:, None, :].astype(np.int64) - spots[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert (cluster == want).all() and counts.sum() == 3200 and compared < 400
    assert all((totals[c] == points[want == c].sum(axis=0)).all() for c in range(16))


# -- phrases -----------------------------------------------------------------------------------


def phrase_documents():
    words = ["the", "of", "New", "york", "city", "hall", "µm", "naïve", "rare" + "x" * 40]
    rows = [(None, None, None), (1, "", "en"), (2, " \t,;", "en"), (3, "one", None), (3, "und is a lang", "und")]
    for i in range(60):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", "\t", "  ", ", ", ".\n", "\v"]) for _ in range(draw.randrange(1, 30)))
        rows.append((i if i % 7 else None, text + draw.choice(["", " New York city hall", " new york."]), draw.choice(["en", "de", None])))
    rows += rows[-3:] + [(99, "the new york city " * 3000, "en"), (98, "y" * 200_000 + " the the", "en")]
    return rows


def best_phrases(rows, least, longest, top, share=100):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\v\f\r]", low):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    long = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = {(lang, p[i:j]) for (lang, p), a in long.items() for i in range(len(p)) for j in range(i + 1, len(p) + 1) if j - i < len(p) and 100 * a >= share * f[lang, p[i:j]]}
    out = []
    for (lang, p), a in long.items():
        if (lang, p) not in inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    ranked = collections.defaultdict(list)
    for lang, score, a, p, left, right in sorted(out):
        ranked[lang].append((lang, len(ranked[lang]) + 1, p.decode(), -a, left, right, n[lang], -score))
    return sorted(x for rows in ranked.values() for x in rows[:top])


def phrase_table(spark, rows):
    return spark.createDataFrame([(*r, *X) for r in rows], "doc_id long, text string, lang string, " + CLASH).repartition(3)


@pytest.mark.parametrize(("least", "longest", "top", "share"), [(3, 5, 2000, 100), (20, 3, 4, 60)])
def test_phrases(spark, monkeypatch, least, longest, top, share):
    monkeypatch.setattr(collocations, "SHARD", 50)  # many shards, blocks, levels of the tree of sums
    monkeypatch.setattr(collocations, "BLOCK", 16)
    monkeypatch.setattr(collocations, "FAN", 2)
    monkeypatch.setattr(collocations, "ELEMENTS", 500)
    monkeypatch.setattr(collocations, "CACHE", 4000)
    rows = phrase_documents()
    got = collocations.collocations(spark, phrase_table(spark, rows), least, longest, top, share)
    want = best_phrases(rows, least, longest, top, share)
    assert len(want) >= 4 and sorted(tuple(r) for r in got.collect()) == want


def test_no_phrases(spark):
    assert collocations.collocations(spark, phrase_table(spark, phrase_documents()).where("false")).count() == 0
    assert collocations.collocations(spark, phrase_table(spark, [(1, "a b c", "en")])).count() == 0
    assert collocations.collocations(spark, phrase_table(spark, [(1, "a, a, b. b", "en")]), 2).count() == 0
    assert [tuple(r) for r in collocations.collocations(spark, phrase_table(spark, [(1, "a b, a b", "en")]), 2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 2000)]


def test_scores_pass_64_bits(spark):
    a, n, left, right = 10**13 + 7, 10**15 + 1, 3 * 10**13, 10**13 + 9
    got = spark.range(1).select(collocations._score(*(F.lit(x).cast("long") for x in (a, n, left, right))).alias("x")).first().x
    assert got == 1000 * a * n // (left * right)


def test_minimal_perfect_hash():
    rng = np.random.default_rng(3)
    a, b = rng.integers(-(1 << 62), 1 << 62, 5000), rng.integers(0, 50, 5000)
    made = collocations.Hash.of(a, b)
    assert sorted(made.slots(a, b)) == list(range(5000))
    assert (made.slots(a, b + 50) == -1).all() and (made.slots(b, a) == -1).all()
    assert (made.words.nbytes + made.ranks.nbytes) * 8 / 5000 < 8  # bits a key, without the stored keys
    assert len(collocations.Hash.of(a[:0], b[:0]).slots(a, b)) == 5000
