"""Lloyd's centroid clustering with two trees, exact in integers.

Vectors are made integers by floor(SCALE x component) and dealt to blocks; each block gets a cover tree once: a node is a vector with all
vectors within its radius; its children are the node's own vector and others of the node, each farther than radius / BASE from the
children before it, and every vector of the node goes to a child within that distance. A node's vectors stand
side by side. The blocks with their trees are a stored table. Each round makes a tree of the same kind over the centroids (k of
them: the driver's part) and broadcasts it; every task meets it with the trees of its blocks: of the pairs (vector node,
centroid node) those go whose least possible distance exceeds the largest possible distance to another centroid. A node with one
centroid left is assigned whole, its sum taken from prefix sums; pairs of leaves are compared exactly. Bounds are doubles with a
margin, so they never decide a tie. Tasks hand on a sum and a count by cluster; Spark adds them.

Cases: vectors of another size than `size`, null ones and those with a null or non-finite component take no part; components beyond
+-RANGE (after scaling) count as +-RANGE, so that distances fit 64 bits; repeated rows are vectors of their own; null ids count as
the empty text where starts are drawn; fewer than k vectors give fewer centroids; equal distances go to the smaller number; an
empty centroid stays where it is; an empty table gives none. Only id and vector are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SCALE, RANGE = 1024, 1 << 27
#: Vectors of a block, vectors of a leaf, shrinking of radii from level to level, pairs measured at once.
BLOCK, LEAF, BASE, PAIRS = 2048, 8, 1.3, 1 << 14
_BLOCKS = "id array<long>, v array<int>, node array<int>, radius array<double>, lo array<int>, hi array<int>, child array<int>, n_child array<int>"
_MOVES = "cluster int, n long, total array<long>"


def usable(vectors: DataFrame, size: int, id_col: str, vector_col: str) -> DataFrame:
    """id (long) and v (array of int): the rows that take part."""
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")), F.lit(False)))
    whole = F.transform(x, lambda e: F.floor(F.least(F.greatest(e.cast("double") * SCALE, F.lit(float(-RANGE))), F.lit(float(RANGE)))).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) == size) & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


@dataclass
class Tree:
    """A cover tree over rows of x, which are put in the order of the tree: node i is about row node[i] and holds rows lo[i] up to hi[i]; its children stand together."""

    x: np.ndarray
    order: np.ndarray
    node: np.ndarray
    radius: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    n_child: np.ndarray


def cover_tree(x: np.ndarray, leaf: int) -> Tree:
    """Nodes of up to `leaf` rows, or of equal rows, are leaves."""
    real, order = x.astype(np.float64), np.empty(len(x), np.int64)
    node, radius, lo, hi, child, n_child = [], [], [], [], [], []

    def add(rows: np.ndarray, far: np.ndarray, at: int) -> None:
        """rows with their distances from the first of them."""
        node.append(at)
        radius.append(float(far.max()) * (1 + 1e-12))
        lo.append(at)
        hi.append(at + len(rows))
        child.append(0)
        n_child.append(0)
        order[at : at + len(rows)] = rows

    if len(x):
        add(np.arange(len(x)), np.sqrt(((real - real[0]) ** 2).sum(1)), 0)
    todo = 0
    while todo < len(node):
        rows, reach = order[lo[todo] : hi[todo]].copy(), radius[todo] / BASE
        if len(rows) > leaf and radius[todo] > 0:
            at = lo[todo]
            child[todo] = len(node)
            while len(rows):
                far = np.sqrt(((real[rows] - real[rows[0]]) ** 2).sum(1))
                near = far <= reach
                add(rows[near], far[near], at)
                at += int(near.sum())
                rows = rows[~near]
            n_child[todo] = len(node) - child[todo]
        todo += 1
    ints = (np.array(a, np.int64) for a in (node, lo, hi, child, n_child))
    node, lo, hi, child, n_child = ints
    return Tree(x[order], order, node, np.array(radius), lo, hi, child, n_child)


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    at = np.cumsum(size) - size
    return np.arange(size.sum()) + np.repeat(start - at, size)


def _apart(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a from rows j of b."""
    parts = [np.sqrt(((a[i[p : p + PAIRS]].astype(np.float64) - b[j[p : p + PAIRS]]) ** 2).sum(1)) for p in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


def meet(t: Tree, c: Tree, number: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]], int]:
    """Nearest centroid of every row of t.x, the parts assigned whole as (lo, hi, cluster), and how many exact comparisons it took. number: the centroid of each row of c.x."""
    best = np.full(len(t.x), -1, np.int64)
    whole, compared = [], 0
    pn, pc = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while len(pn):
        d = _apart(t.x, t.node[pn], c.x, c.node[pc])
        # the vector that a centroid node is about is a centroid itself
        most = np.full(len(t.node), np.inf)
        np.minimum.at(most, pn, d + t.radius[pn])
        margin = 1e-9 * (1 + d + t.radius[pn] + c.radius[pc])
        keep = d - t.radius[pn] - c.radius[pc] <= most[pn] + margin
        pn, pc = pn[keep], pc[keep]
        left = np.bincount(pn, minlength=len(t.node))
        alone = (left[pn] == 1) & (c.hi[pc] - c.lo[pc] == 1)
        if alone.any():
            n, to = pn[alone], number[c.lo[pc[alone]]]
            best[_spans(t.lo[n], t.hi[n] - t.lo[n])] = np.repeat(to, t.hi[n] - t.lo[n])
            whole.append((t.lo[n], t.hi[n], to))
            pn, pc = pn[~alone], pc[~alone]
        grow_c = (c.n_child[pc] > 0) & ((c.radius[pc] >= t.radius[pn]) | (t.n_child[pn] == 0))
        waits = np.zeros(len(t.node), bool)
        waits[pn[grow_c]] = True
        grow_n = ~waits[pn] & (t.n_child[pn] > 0)
        exact = ~waits[pn] & ~grow_n
        if exact.any():
            compared += _compare(t, c, number, pn[exact], pc[exact], best)
        stay = waits[pn] & ~grow_c
        more_c, more_n = c.n_child[pc[grow_c]], t.n_child[pn[grow_n]]
        pn, pc = (
            np.concatenate([pn[stay], np.repeat(pn[grow_c], more_c), _spans(t.child[pn[grow_n]], more_n)]),
            np.concatenate([pc[stay], _spans(c.child[pc[grow_c]], more_c), np.repeat(pc[grow_n], more_n)]),
        )
    return best, whole, compared


def _compare(t: Tree, c: Tree, number: np.ndarray, pn: np.ndarray, pc: np.ndarray, best: np.ndarray) -> int:
    """Every row of the leaves pn against every centroid of the leaves pc, in integers."""
    rows, cents = t.hi[pn] - t.lo[pn], c.hi[pc] - c.lo[pc]
    near = np.full(len(best), np.iinfo(np.int64).max)
    # pairs of (row, centroid leaf), then of (row, centroid)
    row, leaf = _spans(t.lo[pn], rows), np.repeat(pc, rows)
    row, cent = np.repeat(row, np.repeat(cents, rows)), _spans(c.lo[leaf], np.repeat(cents, rows))
    for p in range(0, len(row), PAIRS):
        r, k = row[p : p + PAIRS], cent[p : p + PAIRS]
        d = ((t.x[r] - c.x[k]) ** 2).sum(1)
        order = np.lexsort((number[k], d, r))
        r, k, d = r[order], number[k[order]], d[order]
        first = np.r_[True, r[1:] != r[:-1]]
        r, k, d = r[first], k[first], d[first]
        better = (d < near[r]) | ((d == near[r]) & (k < best[r]))
        near[r[better]], best[r[better]] = d[better], k[better]
    return len(row)


def _plant(size: int):
    """Rows to blocks with their trees."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in range(0, batch.num_rows, BLOCK):
                part = batch.slice(p, BLOCK)
                t = cover_tree(part.column("v").flatten().to_numpy().reshape(-1, size).astype(np.int64), LEAF)
                ids = part.column("id").take(pa.array(t.order)).to_pylist()
                lists = [ids, t.x.ravel(), t.node, t.radius, t.lo, t.hi, t.child, t.n_child]
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.int32()] * 4]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), pa.array(a, k)) for a, k in zip(lists, kinds)]
                yield pa.record_batch(arrays, names=["id", "v", "node", "radius", "lo", "hi", "child", "n_child"])

    return plant


def _trees(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.Array, Tree]]:
    for i in range(batch.num_rows):
        get = lambda name: batch.column(name).slice(i, 1).flatten()  # noqa: B023, E731
        x = get("v").to_numpy().astype(np.int64).reshape(-1, size)
        node, lo, hi, child, n_child = (get(n).to_numpy().astype(np.int64) for n in ("node", "lo", "hi", "child", "n_child"))
        yield get("id"), Tree(x, np.arange(len(x)), node, get("radius").to_numpy(), lo, hi, child, n_child)


def _moves(held, size: int):
    """Sum and count of each cluster over a task's blocks."""

    def moves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        n, total = np.zeros(len(c.order), np.int64), np.zeros((len(c.order), size), np.int64)
        for batch in batches:
            for _, t in _trees(batch, size):
                best, whole, _ = meet(t, c, c.order)
                upto = np.concatenate([np.zeros((1, size), np.int64), np.cumsum(t.x, axis=0)])
                rest = np.ones(len(best), bool)
                for lo, hi, to in whole:
                    np.add.at(n, to, hi - lo)
                    np.add.at(total, to, upto[hi] - upto[lo])
                    rest[_spans(lo, hi - lo)] = False
                np.add.at(n, best[rest], 1)
                np.add.at(total, best[rest], t.x[rest])
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(total[some]), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    return moves


def _assigned(held, size: int):
    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        centroids = np.empty_like(c.x)
        centroids[c.order] = c.x
        for batch in batches:
            for ids, t in _trees(batch, size):
                best, _, _ = meet(t, c, c.order)
                distance = ((t.x - centroids[best]) ** 2).sum(1)
                yield pa.record_batch([ids, pa.array(best, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return assigned


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 for every vector that takes part."""
    spark = vectors.sparkSession
    rows = usable(vectors, size, id_col, vector_col)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [[int(x) for x in r["v"]] for r in rows.orderBy(drawn, "v").limit(k).collect()]
    if not centroids:
        kinds = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], f"{id_col} long, {kinds}")
    blocks = stored(rows.mapInArrow(_plant(size), _BLOCKS), "cover-trees")
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(cover_tree(np.array(centroids, np.int64), 1))
        sums = blocks.mapInArrow(_moves(held, size), _MOVES).select("cluster", "n", F.posexplode("total"))
        got = sums.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("total")).collect()  # k x size rows
        held.destroy()
        was, centroids = centroids, [list(c) for c in centroids]
        for r in got:
            centroids[r["cluster"]][r["pos"]] = r["total"] // r["n"]
        if centroids == was:
            break
    held = spark.sparkContext.broadcast(cover_tree(np.array(centroids, np.int64), 1))
    out = stored(blocks.mapInArrow(_assigned(held, size), "id long, cluster int, distance long"), "clusters")
    held.destroy()
    by = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    most = (1 << 63) - 1
    facts = [(c, min(s, most), min(sum(by.values()), most), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in by.items()]
    facts = F.broadcast(spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))  # k rows
    return out.join(facts, "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
