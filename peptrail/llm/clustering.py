"""Centroid clustering by filtering balls of partition-local metric trees.

Vectors become integers; batches of up to ``TREE`` of them become ball trees where they lie,
one row a tree: its points in the order of its leaves and, for every ball, centre, radius,
count and integer sum of the points. A round walks each tree from its root with the centroids
that may be nearest. By the triangle inequality a ball of centre p and radius r has all its
points nearer to centroid a than to b where d(p, a) + r < d(p, b) - r: then b is left out, and
a ball with one centroid left adds its count and sum to it as a whole. Other balls are
descended into; leaves compare exactly, in integers, ties to the smaller number. A margin wider
than rounding keeps every doubtful ball for the leaves. Only sums and counts per centroid leave
a task.

Edge cases: vectors that are null, of another length or with null or non-finite components are
left out, as are those with a component of 2 ** 21 or more either way, whose squared distances
might not fit in 64 bits; rows that share a vec_id are vectors of their own; a null vec_id hashes as
an empty one; equal hashes are ordered by components; fewer vectors than clusters make as many
centroids as there are vectors; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peptrail.llm import scratch

SIZE, CLUSTERS, ROUNDS, SCALE = 64, 16, 3, 64
#: Points of a tree and of a leaf: a task holds one tree at a time.
TREE, LEAF = 4096, 24
#: Larger components either way have no 64-bit distance.
LIMIT = 1 << 27
#: Relative width of the margin in which a ball counts as doubtful.
MARGIN = 1e-9


def _integers(vectors: DataFrame, size: int, scale: int) -> DataFrame:
    """``(vec_id, x)`` of usable vectors, ``x`` their components as integers."""
    x = F.transform("e", lambda v: F.floor(F.lit(float(scale)) * v.cast("double")))
    bound = float(LIMIT) / scale
    usable = (F.size("e") == size) & F.forall("e", lambda v: F.coalesce((v.cast("double") < bound) & (v.cast("double") > -bound), F.lit(False)))
    return vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("e")).where(usable).select("vec_id", x.alias("x"))


def _balls(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of a tree's points and its balls ``(first, end, left, right)`` in it; a leaf has no children (-1)."""
    order, balls, todo = np.arange(len(points)), [(0, len(points), -1, -1)], [0]
    while todo:
        at = todo.pop()
        first, end, _, _ = balls[at]
        own = points[order[first:end]]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        if end - first <= LEAF or own[:, axis].min() == own[:, axis].max():
            continue
        half = (end - first) // 2
        order[first:end] = order[first:end][np.argpartition(own[:, axis], half)]
        balls[at] = (first, end, len(balls), len(balls) + 1)
        todo += [len(balls), len(balls) + 1]
        balls += [(first, first + half, -1, -1), (first + half, end, -1, -1)]
    return order, np.array(balls, dtype=np.int32)


TREES = pa.schema([("vec_ids", pa.list_(pa.int64())), ("points", pa.binary()), ("balls", pa.binary()), ("sums", pa.binary()), ("radii", pa.binary())])


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, TREE):
            part = batch.slice(first, TREE)
            points = part.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(part.num_rows, -1)
            order, balls = _balls(points)
            points = points[order]
            total = np.zeros((len(points) + 1, points.shape[1]), dtype=np.int64)
            np.cumsum(points, axis=0, dtype=np.int64, out=total[1:])
            sums = total[balls[:, 1]] - total[balls[:, 0]]
            centres = sums / (balls[:, 1] - balls[:, 0])[:, None]
            radii = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) for (a, b, _, _), c in zip(balls, centres, strict=True)])
            row = [[part.column("vec_id").take(pa.array(order)).to_pylist()], [points.tobytes()], [balls.tobytes()], [sums.tobytes()], [radii.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, TREES.types, strict=True)], schema=TREES)


def _nearest(points: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact nearest of the centroids ``numbers`` (ascending) and its squared distance."""
    d = np.stack([((points - centroids[c]) ** 2).sum(axis=1) for c in numbers])
    best = d.argmin(axis=0)
    return numbers[best], d[best, np.arange(len(points))]


def assign(points: np.ndarray, balls: np.ndarray, sums: np.ndarray, radii: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Per point its cluster, per cluster count and sum, and the number of points that leaves compared."""
    cluster = np.empty(len(points), dtype=np.int64)
    counts, totals, compared = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64), 0
    todo = [(0, np.arange(len(centroids)))]
    while todo:
        at, near = todo.pop()
        first, end, left, right = balls[at]
        d = np.sqrt(((sums[at] / (end - first) - centroids[near]) ** 2).sum(axis=1))
        least, reach = d.min(), 2 * radii[at]
        near = near[d <= least + reach + MARGIN * (least + reach + 1)]
        if len(near) == 1:
            cluster[first:end] = near[0]
            counts[near[0]] += end - first
            totals[near[0]] += sums[at]
        elif left >= 0:
            todo += [(left, near), (right, near)]
        else:
            own = points[first:end].astype(np.int64)
            best, _ = _nearest(own, centroids, near)
            cluster[first:end] = best
            counts += np.bincount(best, minlength=len(centroids))
            np.add.at(totals, best, own)
            compared += end - first
    return cluster, counts, totals, compared


def _opened(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple]:
    for batch in batches:
        for row in batch.to_pylist():
            read = lambda name, kind, width: np.frombuffer(row[name], dtype=kind).reshape(-1, width)  # noqa: B023, E731
            yield row["vec_ids"], read("points", np.int32, size), read("balls", np.int32, 4), read("sums", np.int64, size), np.frombuffer(row["radii"])


def _summed(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, *tree in _opened(batches, centroids.shape[1]):
            _, n, s, _ = assign(*tree, centroids)
            counts, totals = counts + n, totals + s
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(range(len(centroids)), pa.int32()), "n": pa.array(counts), "total": pa.array(totals.tolist(), pa.list_(pa.int64()))})

    return run


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, *tree in _opened(batches, centroids.shape[1]):
            cluster, *_ = assign(*tree, centroids)
            distance = ((tree[0].astype(np.int64) - centroids[cluster]) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(distance)})

    return run


def cluster_vectors(spark: SparkSession, vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256; see the module.

    Between rounds the driver holds ``clusters`` centroids and reads as many sums.
    """
    rows = _integers(vectors, size, scale)
    rank = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = rows.select(rank.alias("rank"), "x").orderBy("rank", "x").limit(clusters).collect()  # at most ``clusters`` rows
    if not seeds:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r.x for r in seeds], dtype=np.int64)
    trees = scratch.save(spark, rows.mapInArrow(_grow, "vec_ids array<bigint>, points binary, balls binary, sums binary, radii binary"), "trees")
    for _ in range(rounds):
        parts = trees.mapInArrow(_summed(centroids), "cluster int, n long, total array<bigint>")
        each = F.array(*(F.sum(F.col("total")[i].cast("decimal(38,0)")) for i in range(size)))
        centroids = centroids.copy()
        for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), each.alias("total")).where("n > 0").collect():
            centroids[r.cluster] = [int(t) // r.n for t in r.total]
    out = scratch.save(spark, trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # at most ``clusters`` rows
    whole = inertia.agg(F.sum("cluster_inertia").alias("inertia"))
    named = spark.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    known = inertia.join(F.broadcast(named), "cluster").join(F.broadcast(whole))
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
