"""Centroid clustering by exact integer k-means, with Yinyang filters.

Vectors of `dim` components, none of them null or non-finite, become integers floor(SCALE * x); the others are left out.
Centroids 0, 1, ... start as the vectors with the k smallest hashes of their ids. A round assigns every vector to the
nearest centroid (ties: the smaller number) and moves each centroid that has vectors to their floored mean; after `rounds`
rounds vectors are assigned once more.

Yinyang: the starting centroids are themselves clustered into `groups` groups, once. A vector carries an upper bound of its
distance to its own centroid and, for each group, a lower bound of its distance to the group's other centroids. Bounds move
with the centroids. A vector whose upper bound, if need be made exact, is below all its lower bounds stays where it is
(the global filter); of the others, only groups whose bound is not above the upper bound are scanned (the group filter), and
in those every centroid's distance is computed exactly. Bounds are doubles that err to the safe side by SLACK, and skip on
strict inequality only, so that ties are always scanned: the result is that of the plain method, to the last integer.

A round is one pass over the vectors, which carry their bounds, written to the shared folder; the table of the round before
is dropped then. Sums of clusters change only by the vectors that move, so only those are summed, by block of rows first.
Only k centroids, and at most 2 k (dim + 1) sums a round, reach the driver.

Components must be at most LIMIT in size, so that a squared distance fits a long; a larger one ends the query with an error.
Rows that share a vec_id are vectors of their own; where such rows start centroids, the smaller vector comes first. Null
vec_ids start a centroid only where there are fewer than k others. If there are fewer than k vectors there are as many
centroids. Repeated vectors cost a row each, and no group of them is ever gathered. An empty table gives an empty one.
Columns other than vec_id and embedding, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.llm.common import drop_path, written_at

SCALE, LIMIT = 1024, 1 << 27
K, DIM, ROUNDS, SEED = 8, 64, 10, 3
SLACK = 1e-9
#: Vectors that are compared with a centroid at once.
BLOCK = 8192


def integral(vectors: DataFrame, dim: int = DIM) -> DataFrame:
    """vec_id and x, the vector as integers, of the vectors (vec_id, embedding) that are kept."""
    e = F.col("embedding").cast("array<double>")
    usable = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    too_large = F.raise_error(F.lit(f"a component is over {LIMIT} after scaling: squared distances would not fit a long"))
    whole = lambda c: F.when(F.abs(c * SCALE) <= LIMIT, F.floor(c * SCALE).cast("int")).otherwise(too_large.cast("int"))
    return vectors.filter((F.size("embedding") == dim) & usable).select("vec_id", F.transform(e, whole).alias("x"))


def first_centroids(points: DataFrame, k: int = K, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest sha256 of `seed:vec_id`, as rows of longs."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(name.asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r.x for r in rows], np.int64).reshape(len(rows), dim)


def group_centroids(centroids: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by plain k-means over the few centroids; every group has a centroid."""
    x = centroids.astype(float)
    mid = x[np.linspace(0, len(x) - 1, groups).astype(int)].copy() if groups else x[:0]
    own = np.zeros(len(x), int)
    for _ in range(rounds if groups else 0):
        own = ((x[:, None, :] - mid[None]) ** 2).sum(axis=2).argmin(axis=1)
        for g in range(groups):
            if (own == g).any():
                mid[g] = x[own == g].mean(axis=0)
    return np.unique(own, return_inverse=True)[1]


def _squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


class Yinyang:
    """One round: centroids, their groups, and how far each moved since the round before."""

    def __init__(self, centroids: np.ndarray, group: np.ndarray, before: np.ndarray | None = None) -> None:
        self.centroids, self.group = centroids, group
        self.groups = int(group.max()) + 1 if len(group) else 0
        moved = np.zeros(len(group)) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        self.moved, self.most = moved, np.array([moved[group == g].max() for g in range(self.groups)])

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(cluster, upper, lower, distances computed) of the rows x (longs) with their state after the round before;
        own is -1 in the first round."""
        own, computed, n = own.copy(), 0, len(x)
        known = own >= 0
        upper = np.where(known, upper + self.moved[np.maximum(own, 0)], np.inf)
        lower = np.maximum((lower - self.most) * (1 - SLACK), 0) if n else lower
        nearest = lower.min(axis=1)
        # Global filter: by the bound, then by the exact distance to the own centroid.
        exact = np.full(n, -1, np.int64)
        doubtful = np.flatnonzero(known & (upper >= nearest))
        for c in np.unique(own[doubtful]).tolist():
            rows = doubtful[own[doubtful] == c]
            exact[rows] = _squared(x[rows], self.centroids[c])
            computed += len(rows)
        upper[doubtful] = np.sqrt(exact[doubtful]) * (1 + SLACK)
        open_rows = np.flatnonzero(~known | (upper >= nearest))
        # Group filter, then exact scans of the groups that are left.
        scan = ~known[open_rows, None] | (lower[open_rows] <= upper[open_rows, None])
        was = own[open_rows].copy()
        best, best_d = was.copy(), np.where(was >= 0, exact[open_rows], np.iinfo(np.int64).max)
        seen = []
        for g in range(self.groups):
            at = np.flatnonzero(scan[:, g])
            members = np.flatnonzero(self.group == g)
            d = np.stack([_squared(x[open_rows[at]], self.centroids[c]) for c in members], axis=1)
            computed += d.size
            seen.append((at, members, d))
            for j, c in enumerate(members.tolist()):
                better = (d[:, j] < best_d[at]) | ((d[:, j] == best_d[at]) & ((c < best[at]) | (best[at] < 0)))
                best[at[better]], best_d[at[better]] = c, d[better, j]
        new_lower = lower[open_rows]
        for g, (at, members, d) in enumerate(seen):
            others = np.where(members[None, :] == best[at][:, None], np.iinfo(np.int64).max, d)
            new_lower[at, g] = np.sqrt(others.min(axis=1)) * (1 - SLACK)
        # A centroid that a vector has left is one of the others of its group, if that group was not scanned.
        left = np.flatnonzero((was >= 0) & (best != was))
        at_group = self.group[np.maximum(was[left], 0)]
        distance = np.sqrt(np.maximum(exact[open_rows][left], 0)) * (1 - SLACK)
        new_lower[left, at_group] = np.minimum(new_lower[left, at_group], distance)
        own[open_rows], upper[open_rows], lower[open_rows] = best, np.sqrt(best_d) * (1 + SLACK), new_lower
        return own, upper, lower, computed


def _state(points: DataFrame) -> T.StructType:
    types = [("cluster", T.IntegerType()), ("was", T.IntegerType()), ("upper", T.DoubleType()), ("lower", T.ArrayType(T.DoubleType()))]
    return T.StructType([points.schema["vec_id"], T.StructField("x", T.ArrayType(T.IntegerType())), *[T.StructField(n, t) for n, t in types]])


def _rows(column: pa.ListArray, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


def assign_round(points: DataFrame, step: Yinyang) -> DataFrame:
    """points (vec_id, x, and from the second round on cluster, was, upper, lower) with their state after this round."""
    names = ["vec_id", "x", "cluster", "was", "upper", "lower"]
    first = "cluster" not in points.columns
    shared = points.sparkSession.sparkContext.broadcast(step)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                n, x = batch.num_rows, _rows(batch.column(1), np.int64)
                own = np.full(n, -1) if first else batch.column(2).to_numpy().astype(np.int64)
                upper = np.zeros(n) if first else batch.column(3).to_numpy()
                lower = np.zeros((n, step.groups)) if first else _rows(batch.column(4), float)
                cluster, upper, lower, _ = step.assign(x, own, upper, lower)
                state = [pa.array(cluster.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(upper), _lists(lower)]
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(x.astype(np.int32)), *state], names=names)

    columns = ["vec_id", "x"] if first else ["vec_id", "x", "cluster", "upper", "lower"]
    return points.select(*columns).mapInArrow(run, _state(points))


def moved_sums(points: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums) that the vectors which changed their cluster add to each, or take off: k, and k by dim, as Python's
    integers. Blocks of rows are summed where they lie, then Spark sums by cluster and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column(0), np.int64)
            x = np.column_stack([np.ones(len(x), np.int64), x])
            out = np.zeros((k, x.shape[1]), np.int64)
            now, was = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            np.add.at(out, now, x)
            np.subtract.at(out, was[was >= 0], x[was >= 0])
            touched = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(touched.astype(np.int32)), _lists(out[touched])], names=["c", "sums"])

    parts = points.filter("cluster != was").select("x", "cluster", "was").mapInArrow(run, "c int, sums array<long>")
    rows = parts.select("c", F.posexplode("sums")).groupBy("c", "pos").agg(F.sum("col").alias("total")).collect()
    out = np.zeros((k, dim + 1), object)
    for c, pos, total in rows:
        out[c, pos] = total
    return out[:, 0], out[:, 1:]


def cluster(vectors: DataFrame, k: int = K, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED, groups: int | None = None) -> DataFrame:
    """vectors (vec_id, embedding) to vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    points, path = written_at(integral(vectors, dim), "centroid-points")
    centroids = first_centroids(points, k, dim, seed)
    k = len(centroids)
    rounds = rounds if k else 0
    group = group_centroids(centroids, min(k, groups or -(-k // 3)))
    counts, sums, before = np.zeros(k, object), np.zeros((k, dim), object), None
    for number in range(rounds + 1):
        old = path
        points, path = written_at(assign_round(points, Yinyang(centroids, group, before)), "centroid-points")
        drop_path(spark, old)
        if number < rounds:
            more, moved = moved_sums(points, k, dim)
            counts, sums, before = counts + more, sums + moved, centroids
            centroids = np.array([[s // n for s in row] if n else old_row.tolist() for row, n, old_row in zip(sums, counts, centroids, strict=True)], np.int64).reshape(k, dim)
    return _told(points, centroids)


def distances(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """points (vec_id, x, cluster) to vec_id, cluster, distance."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(i, BLOCK)
                far = _squared(_rows(batch.column(1), np.int64), shared.value[batch.column(2).to_numpy()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(far)], names=["vec_id", "cluster", "distance"])

    out = T.StructType([points.schema["vec_id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    return points.select("vec_id", "x", "cluster").mapInArrow(run, out)


def _told(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    ranged = distances(points, centroids)
    # One row for each of k centroids.
    sums = {r.cluster: r.total for r in ranged.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    total = sum(sums.values())
    rows = [(c, sums.get(c, 0), total, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    places = points.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return ranged.join(F.broadcast(places), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
