"""Exact embedding near-duplicates by dual traversal of cover trees.

Equal vectors of a label are one point with a weight. The upper levels of the tree are laid
out by Spark: a node of more than ``PART`` points gets up to ``FAN`` pivots of its own, and its
points go to their nearest pivot and, around it, to the shell whose outer radius is the
smallest of 2, 1, 1/2, … that holds them. From level to level a join meets the children of
the node pairs left over: pairs that the covering radii keep apart are dropped, pairs in which
everything links are counted whole, and only nodes of the others are split again. Each
surviving pair of nodes is one group of a task, which builds a cover tree over either node
(nested levels, radii halved from level to level) and walks both trees together, dropping
pairs of nodes by the same bound and testing the cosine of what is left. A node that cannot
be split (its points differ by rounding only, or ``LEVELS`` is reached) is dealt into parts.

A task returns at most one count and one edge for each of its points, never its pairs.
Distances are between unit vectors, cos >= t being d <= sqrt(2 - 2t); bounds have a margin
and the last test is the cosine in double precision, so the links are exact.

Edge cases: a null label, a null, zero, empty or non-finite vector, or one with a null
component links with nothing and keeps its row; vectors of different lengths do not link; a
null vec_id counts as the largest id; rows that share a vec_id, or have none, are vectors of
their own; an empty table gives an empty result; other columns are ignored, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peptrail.llm import scratch
from peptrail.llm.components import components

THRESHOLD = 0.98
#: Points of a node that one task holds.
PART = 2048
#: Pivots of a node at most, and levels laid out by Spark at most (2048 * 16 ** 12 points).
FAN, LEVELS = 16, 12
SHELLS = 12
#: A node of this radius is not split: its points differ by rounding.
POINT = 1e-6
#: Rows of equal vectors find their point through so many copies of its name.
SALTS = 8
#: Candidates for centers that a node's members are compared with at once, and children of a pair of nodes from which on
#: and by how many at a time their distances are a product of matrices.
BATCH, DENSE, BLOCK = 64, 256, 1 << 20
#: More than a distance between unit vectors errs by rounding.
EPS = 1e-7
LAST = 2**63 - 1


def _unit(raw: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    return v / np.linalg.norm(v, axis=1)[:, None]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row, with a null ``vec`` where its vector links with nothing."""
    for batch in batches:
        raw, dims = [], []
        for label, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist(), strict=True):
            raw.append(None)
            dims.append(None)
            if label is not None and v and None not in v:
                a = np.array(v, dtype=np.float64)
                largest = np.abs(a).max()
                if np.isfinite(a).all() and largest > 0:
                    raw[-1], dims[-1] = (a / largest).tobytes(), len(a)  # lengths neither overflow nor vanish
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "vec"])


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest pivot of each point's node, its distance and its shell."""
    names = ["key", "label", "dim", "vec", "weight", "path"]
    for batch in batches:
        vecs, pivots = batch.column("vec").to_pylist(), batch.column("pivots")
        best, far = np.zeros(len(vecs), np.int32), np.zeros(len(vecs))
        groups: dict[tuple, list[int]] = {}
        for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in ("label", "dim", "path")), strict=True)):
            groups.setdefault(k, []).append(i)
        for rows in groups.values():
            a, p = _unit([vecs[i] for i in rows]), _unit(pivots[rows[0]].as_py())
            d = np.sqrt(np.maximum(0, 2 - 2 * (a @ p.T)))
            best[rows] = d.argmin(axis=1)
            far[rows] = d.min(axis=1)
        shell = np.clip(np.floor(1 - np.log2(np.maximum(far, 1e-12))), 0, SHELLS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(best), pa.array(shell), pa.array(far)], [*names, "pivot", "shell", "far"])


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pivot tables with their unit vectors beside the stored ones."""
    kind = pa.list_(pa.list_(pa.float64()))
    for batch in batches:
        units = pa.array([[list(u) for u in _unit(x)] for x in batch.column("pivots").to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([*batch.columns, units], [*batch.schema.names, "units"])


class CoverTree:
    """Levels of nodes; a level's nodes cover their members within half the radius of the last.

    Level i holds ``center`` (a member of the node), ``radius`` (the farthest member's
    distance), and ``child``: where the node's children begin in the next level.
    """

    def __init__(self, v: np.ndarray, finest: float):
        self.v, self.levels = v, []
        members = [np.arange(len(v))]
        centers, radius = [0], 2.0
        while True:
            reach = [self.far(c, m) if len(m) > 1 else None for c, m in zip(centers, members, strict=True)]
            level = {"center": np.array(centers), "radius": np.array([0.0 if x is None else x.max() for x in reach]), "members": members}
            self.levels.append(level)
            if radius < finest or level["radius"].max() <= finest:
                level["size"] = np.array([len(m) for m in members])
                break
            radius /= 2
            next_centers, next_members, child = [], [], [0]
            for c, m, d in zip(centers, members, reach, strict=True):
                next_centers.append(c)
                if d is None:
                    next_members.append(m)
                    child.append(len(next_centers))
                    continue
                near = d <= radius
                next_members.append(m[near])
                left = m[~near]
                while len(left):  # the first that is left is a center, until all are within the radius of one
                    within = 2 - 2 * (self.v[left] @ self.v[left[:BATCH]].T) <= radius * radius
                    free = np.ones(len(left), bool)
                    for k in range(within.shape[1]):
                        if free[k]:
                            own = within[:, k] & free
                            own[k] = True
                            next_centers.append(left[k])
                            next_members.append(left[own])
                            free &= ~own
                    left = left[free]
                child.append(len(next_centers))
            level["child"], level["members"] = np.array(child), None
            centers, members = next_centers, next_members

    def far(self, c: int, m: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(0, 2 - 2 * (self.v[m] @ self.v[c])))
        d[m == c] = 0
        return d


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i] .. starts[i]+counts[i]-1`` one after another."""
    total = np.cumsum(counts)
    return np.repeat(starts - (total - counts), counts) + np.arange(total[-1] if len(total) else 0)


def _near(a: np.ndarray, x: dict, i: slice, b: np.ndarray, y: dict, j: slice, tau: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the nodes ``i`` of one level and ``j`` of another, the pairs that their radii do not keep apart."""
    rows = max(1, BLOCK // (j.stop - j.start))
    centers, reach = b[y["center"][j]].T, y["radius"][j] + tau + EPS
    for at in range(i.start, i.stop, rows):
        part = slice(at, min(at + rows, i.stop))
        g, h = np.nonzero(2 - 2 * (a[x["center"][part]] @ centers) <= np.square(x["radius"][part][:, None] + reach))
        if len(g):
            yield g + at, h + j.start


def links(a: np.ndarray, b: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs ``(i, j)`` with cosine >= threshold, of rows of ``a`` and ``b``, or i < j within ``a``."""
    tau = np.sqrt(2 - 2 * threshold)
    one = CoverTree(a, tau / 4)
    two = one if b is None else CoverTree(b, tau / 4)
    same = b is None
    b = a if same else b
    work = [(0, 0, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while work:
        la, lb, i, j = work.pop()
        x, y = one.levels[la], two.levels[lb]
        out_a, out_b = "child" not in x, "child" not in y
        for at in range(0, len(i), 1 << 15):
            p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", a[x["center"][p]], b[y["center"][q]])))
            keep = d - x["radius"][p] - y["radius"][q] <= tau + EPS
            p, q = p[keep], q[keep]
            if not len(p):
                continue
            if out_a and out_b:
                alone = (x["size"][p] == 1) & (y["size"][q] == 1)
                r, s = (z[alone & (p != q)] if same else z[alone] for z in (p, q))
                r, s = x["center"][r], y["center"][s]
                good = np.einsum("ij,ij->i", a[r], b[s]) >= threshold
                if good.any():
                    yield r[good], s[good]
                for m, n in zip(p[~alone], q[~alone], strict=True):
                    r, s = x["members"][m], y["members"][n]
                    g, h = np.nonzero(a[r] @ b[s].T >= threshold)
                    if same and m == n:
                        g, h = g[g < h], h[g < h]
                    yield r[g], s[h]
                continue
            # Both sides go one level down together where they can.
            down = (la + (not out_a), lb + (not out_b))
            ca = x["child"] if not out_a else None
            cb = y["child"] if not out_b else None
            na = ca[p + 1] - ca[p] if ca is not None else np.ones(len(p), np.int64)
            nb = cb[q + 1] - cb[q] if cb is not None else np.ones(len(q), np.int64)
            pa_, qa_ = ca[p] if ca is not None else p, cb[q] if cb is not None else q
            size = na * nb
            many = size >= DENSE
            for k in np.flatnonzero(many):
                for left, right in _near(a, one.levels[down[0]], slice(pa_[k], pa_[k] + na[k]), b, two.levels[down[1]], slice(qa_[k], qa_[k] + nb[k]), tau):
                    if same:
                        half = left <= right
                        left, right = left[half], right[half]
                    work.append((*down, left, right))
            if many.all():
                continue
            na, nb, pa_, qa_, size = (n[~many] for n in (na, nb, pa_, qa_, size))
            cuts = np.searchsorted(np.cumsum(size), np.arange(1 << 20, size.sum() + (1 << 20), 1 << 20)) + 1
            for f, t in zip(np.concatenate([[0], cuts[:-1]]), cuts, strict=True):
                if f >= min(t, len(size)):
                    continue
                part = slice(f, t)
                rows = _ranges(pa_[part], na[part])
                owner = np.repeat(np.arange(len(na[part])), na[part])
                left = np.repeat(rows, nb[part][owner])
                right = _ranges(qa_[part][owner], nb[part][owner])
                if same:
                    half = left <= right
                    left, right = left[half], right[half]
                if len(left):
                    work.append((*down, left, right))


def _settle(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row that each row reaches by the pairs."""
    label = np.arange(n)
    i = np.concatenate([x for x, _ in pairs]) if pairs else np.empty(0, np.int64)
    j = np.concatenate([x for _, x in pairs]) if pairs else np.empty(0, np.int64)
    while len(i):
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label[i] == label[j]).all():
            break
    return label


def _pair(threshold: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("key", "ascending")])
        side, keys, weight, v = table.column("side").to_numpy(), table.column("key").to_numpy(), table.column("weight").to_numpy(), _unit(table.column("vec").to_pylist())
        n, k = len(keys), int((side == 0).sum())
        counts, settled, pending, held = np.zeros(n, np.int64), np.arange(n), [], 0
        for i, j in links(v[:k], None if k == n else v[k:], threshold):
            if k < n:
                j = j + k
            np.add.at(counts, i, weight[j])
            np.add.at(counts, j, weight[i])
            pending.append((i, j))
            held += len(i)
            if held > 1 << 22:
                pending = [(np.arange(n), _settle(n, pending))]
                held = n
        settled = _settle(n, pending)
        # name each group by its smallest key
        least = np.full(n, LAST)
        np.minimum.at(least, settled, keys)
        on = counts > 0
        return pa.table({"key": keys[on], "links": counts[on], "least": least[settled][on]})

    return run


AT = ["label", "dim", "path"]


def _split(spark: SparkSession, moving: DataFrame, sizes: DataFrame, part: int, level: int) -> tuple[DataFrame, DataFrame]:
    """The points of ``moving`` under the paths of their new nodes, and those nodes with their parents."""
    nth = F.row_number().over(Window.partitionBy(*AT).orderBy(F.xxhash64("key", F.lit(level)), "key"))
    some = moving.select(*AT, "key", "vec").withColumn("nth", nth).where(F.col("nth") <= FAN).join(sizes, AT).where(F.col("nth") <= F.ceil(F.col("m") / part))
    pivots = some.groupBy(*AT).agg(F.sort_array(F.collect_list(F.struct("nth", "vec"))).alias("x")).select(*AT, F.col("x.vec").alias("pivots"))  # FAN at most
    pivots = scratch.save(spark, pivots.mapInArrow(_units, "label string, dim int, path string, pivots array<binary>, units array<array<double>>"), "pivots")
    placed = moving.join(pivots.drop("units"), AT).mapInArrow(_place, "key long, label string, dim int, vec binary, weight long, path string, pivot int, shell int, far double")
    placed = scratch.save(spark, placed.withColumn("parent", F.col("path")).withColumn("path", F.concat_ws("/", "path", F.concat_ws(":", "pivot", "shell"))), "placed")
    nodes = placed.groupBy("label", "dim", "parent", "path", "pivot").agg(F.count(F.lit(1)).alias("m"), F.sum("weight").alias("weight"), F.min("key").alias("least"), F.min("far").alias("lo"), F.max("far").alias("hi"))
    centers = pivots.select("label", "dim", F.col("path").alias("parent"), "units")
    nodes = nodes.join(centers, ["label", "dim", "parent"]).select("label", "dim", "parent", "path", "m", "weight", "least", "lo", "hi", F.element_at("units", F.col("pivot") + 1).alias("center"))
    return placed.select("key", "label", "dim", "vec", "weight", "path"), scratch.save(spark, nodes, "nodes")


def _meet(pairs: DataFrame, cover: DataFrame, threshold: float) -> DataFrame:
    """Pairs of the children of ``pairs(label, dim, x, y)`` that their covering radii leave together."""
    a, b = cover.alias("a"), cover.alias("b")
    d = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.aggregate(F.zip_with("a.center", "b.center", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)))
    tau = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    apart = (d - F.col("a.hi") - F.col("b.hi") > tau) | (F.col("a.lo") - d - F.col("b.hi") > tau) | (F.col("b.lo") - d - F.col("a.hi") > tau)
    within = d + F.col("a.hi") + F.col("b.hi") <= tau - 2e-6  # every point of one links with every one of the other
    here = lambda side, end: (F.col(f"p.{end}") == F.col(f"{side}.parent")) & (F.col("p.label") == F.col(f"{side}.label")) & (F.col("p.dim") == F.col(f"{side}.dim"))
    once = (F.col("p.x") != F.col("p.y")) | (F.col("a.path") <= F.col("b.path"))
    node = lambda side: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in ("path", "m", "weight", "least", "open")))
    return pairs.alias("p").join(a, here("a", "x")).join(b, here("b", "y") & once & ~apart).select("p.label", "p.dim", node("a").alias("a"), node("b").alias("b"), within.alias("within"))


def lay_out(spark: SparkSession, points: DataFrame, threshold: float, part: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Upper levels over ``points(key, label, dim, vec, weight)``.

    Returns the points with the path of their last node, those nodes ``(label, dim, path, m)``,
    the node pairs ``(label, dim, x, y)`` to walk, and the pairs ``(label, dim, a, b)`` that link whole.
    """
    rooted = points.select("key", "label", "dim", "vec", "weight", F.lit("").alias("path"))
    roots = scratch.save(spark, rooted.groupBy(*AT).agg(F.count(F.lit(1)).alias("m")), "roots")
    sizes = roots.where(F.col("m") > part)
    moving, last = rooted.join(sizes.select(*AT), AT, "left_semi"), rooted.join(sizes.select(*AT), AT, "left_anti")
    ends, walks = roots.where(F.col("m") <= part), roots.where(F.col("m") <= part).select("label", "dim", F.col("path").alias("x"), F.col("path").alias("y"))
    pairs, still, whole, level = sizes.select("label", "dim", F.col("path").alias("x"), F.col("path").alias("y")), None, None, 0
    while not pairs.isEmpty():
        level += 1
        placed, nodes = _split(spark, moving, sizes, part, level)
        nodes = nodes.withColumn("open", (F.col("m") > part) & (F.col("hi") > POINT) & F.lit(level < LEVELS))
        cover = nodes if still is None else nodes.unionByName(still.withColumn("parent", F.col("path")))
        met = scratch.save(spark, _meet(pairs, cover, threshold), "node_pairs")
        whole = met.where("within") if whole is None else whole.union(met.where("within"))
        left = met.where("not within").select("label", "dim", F.col("a.path").alias("x"), F.col("b.path").alias("y"), F.col("a.open").alias("xo"), F.col("b.open").alias("yo"))
        walks = walks.union(left.where("not xo and not yo").select("label", "dim", "x", "y"))
        pairs = left.where("xo or yo").select("label", "dim", "x", "y")
        again = left.where("xo").select("label", "dim", F.col("x").alias("path")).union(left.where("yo").select("label", "dim", F.col("y").alias("path"))).distinct()
        again = scratch.save(spark, again, "again")
        sizes = nodes.join(again, AT).select(*AT, "m")
        moving, last = placed.join(again, AT, "left_semi").select(*moving.columns), last.unionByName(placed.join(again, AT, "left_anti"))
        rest = nodes.join(again, AT, "left_anti").withColumn("open", F.lit(False)).select(*nodes.columns)
        still, ends = rest if still is None else still.union(rest), ends.union(rest.select(*AT, "m"))
    if whole is None:
        node = "struct<path:string,m:bigint,weight:bigint,least:bigint,open:boolean>"
        whole = spark.createDataFrame([], f"label string, dim int, a {node}, b {node}, within boolean")
    return last, ends, walks, whole


def node_pairs(walks: DataFrame, ends: DataFrame, part: int) -> DataFrame:
    """Groups ``(label, dim, x, y, xp, yp)`` to walk: nodes above ``part`` points, which cannot be split, in parts."""
    parts = ends.select("label", "dim", F.col("path").alias("x"), F.ceil(F.col("m") / part).cast("int").alias("l"))
    both = walks.join(parts, ["label", "dim", "x"]).join(parts.withColumnsRenamed({"x": "y", "l": "k"}), ["label", "dim", "y"])
    both = both.withColumn("xp", F.explode(F.sequence(F.lit(0), F.col("l") - 1)))
    return both.withColumn("yp", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).where("x <> y or xp <= yp").select("label", "dim", "x", "y", "xp", "yp")


def _bulk(last: DataFrame, ends: DataFrame, whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, links, least)`` by the pairs that link whole, and the edges between those nodes' least keys."""
    same = F.col("a.path") == F.col("b.path")
    ours = whole.select("label", "dim", F.col("a.path").alias("up"), F.col("b.weight").alias("n"), F.col("b.least").alias("least"), same.cast("int").alias("self"))
    ours = ours.union(whole.where(~same).select("label", "dim", "b.path", "a.weight", "a.least", F.lit(0)))
    per = ours.groupBy("label", "dim", "up").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("self").alias("self"))
    above = F.expr("transform(sequence(1, size(split(path, '/'))), i -> substring_index(path, '/', i))")
    nodes = ends.where("path <> ''").select(*AT, F.explode(above).alias("up")).join(per, ["label", "dim", "up"])
    nodes = nodes.groupBy(*AT).agg(F.sum("n").alias("n"), F.min("least").alias("to"), F.sum("self").alias("self"), F.array_distinct(F.collect_list("least")).alias("x"))  # LEVELS at most
    counted = last.join(nodes, AT).select("key", (F.col("n") - F.col("self") * F.col("weight")).alias("links"), F.explode("x").alias("least"), (F.col("to") == F.col("least")).alias("first"))
    counted = counted.select("key", F.when(F.col("first"), F.col("links")).otherwise(0).alias("links"), "least")
    return counted, whole.select(F.col("a.least").alias("src"), F.col("b.least").alias("dst"))


def near_vectors(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, part: int = PART) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    rid = F.coalesce(vectors["vec_id"].cast("long"), F.lit(LAST))
    rows = vectors.select(rid.alias("id"), vectors["label"].cast("string").alias("label"), vectors["embedding"].cast("array<double>").alias("embedding"))
    parsed = scratch.save(spark, rows.mapInArrow(_parse, "id long, label string, dim int, vec binary"), "vectors")
    valid = parsed.where("vec is not null")
    points = valid.groupBy("label", "dim", "vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    points = scratch.save(spark, points.withColumn("key", F.monotonically_increasing_id()), "points")

    last, ends, walks, whole = lay_out(spark, points, threshold, part)
    pairs = scratch.save(spark, node_pairs(walks, ends, part).withColumn("pair", F.monotonically_increasing_id()), "pairs")
    dealt = last.join(ends, AT).select("key", "vec", "weight", *AT, F.pmod(F.xxhash64("key"), F.ceil(F.col("m") / part)).cast("int").alias("part"))
    sides = pairs.select("pair", "label", "dim", F.lit(0).alias("side"), F.col("x").alias("path"), F.col("xp").alias("part"))
    sides = sides.union(pairs.where("not (x = y and xp = yp)").select("pair", "label", "dim", F.lit(1).alias("side"), F.col("y").alias("path"), F.col("yp").alias("part")))
    groups = dealt.join(sides, [*AT, "part"]).select("pair", "side", "key", "weight", "vec")
    walked = groups.groupBy("pair").applyInArrow(_pair(threshold), "key long, links long, least long")
    bulk, between = _bulk(last, ends, whole)
    found = scratch.save(spark, walked.union(bulk), "links")

    classes = components(spark, found.select(F.col("key").alias("src"), F.col("least").alias("dst")).union(between)).withColumnRenamed("id", "key")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    group = F.coalesce("component", "key")
    named = points.select("key", "id", "label", "weight", F.sha2("vec", 256).alias("digest")).join(counts, "key", "left").join(classes, "key", "left").withColumn("group", group)
    named = scratch.save(spark, named.select("id", "label", "digest", "group", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "named")
    named = named.join(named.groupBy("group").agg(F.min("id").alias("component")), "group")
    # A vector may have a third of all rows, so they meet its point by salted digests.
    salted = named.select("label", "digest", "n_links", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = valid.select("id", "label", F.sha2("vec", 256).alias("digest"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("salt"))
    out = out.join(salted, ["label", "digest", "salt"]).select("id", "n_links", "component")
    out = out.union(parsed.where("vec is null").select("id", F.lit(0).cast("long"), "id"))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(known("id").alias("vec_id"), "n_links", known("component").alias("component_id"), (F.col("component") == F.col("id")).alias("kept"))
