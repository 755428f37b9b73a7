"""Centroid clustering by sort-means.

Every round orders, for each centroid, all others by their distance from it. A vector is compared with the centroid that
it was assigned to before, then with the others in that order, as long as they can matter: a centroid that is further
than twice the vector's distance away from the vector's own centroid is strictly further from the vector, so that the
scan stops there (strictly, because ties go to the smaller number). All numbers are integers, so that results are exact
and don't depend on how the rows are dealt out.

Only centroids (`k` times `dims` integers), their orders and their sums pass through the driver; vectors, with their
assignments, are tables in the shared folder, one round at a time, so that a lost executor costs a round at most. There
is no shuffle of vectors: a task sums its own rows, and `k * dims` sums of each task are added up.

Defined results: vectors that are null, of another length, or with null or non-finite components aren't kept and have no
row; a null id hashes like the word "null"; repeated rows are vectors of their own; vectors with equal hashes start in
the order of their components; fewer vectors than `k` give as many centroids; an empty table gives no rows; other
columns are left out. Components beyond 2^27 after scaling would have distances beyond a long and raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LIMIT = 1 << 27
#: Pairs of vector and centroid that are compared at once in a task.
PAIRS = 1 << 14


def integers(vectors: DataFrame, dims: int = 64, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The vectors that are kept as (key, v array<int>): floor(scale * x) of each component, x as double."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    fits = F.forall(scaled, lambda c: F.abs(c) <= LIMIT)
    checked = F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling")))
    return vectors.filter(x.isNotNull() & (F.size(x) == dims) & ~bad).select(F.col(key), checked.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str = "2", key: str = "vec_id") -> np.ndarray:
    """The `k` vectors with the smallest SHA-256 of "<seed>:<key>" (a table of `k` rows), in that order."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"), 256)
    rows = vectors.select("v", h.alias("h")).orderBy("h", "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


class Orders:
    """The centroids of a round with, for each, all of them by rising distance from it (itself first)."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.centroids = centroids
        apart = np.stack([((centroids - c) ** 2).sum(1) for c in centroids])
        self.order = np.argsort(apart, axis=1, kind="stable")
        # squared distance <= (2 d)^2 = 4 d^2 keeps a centroid; both sides stay below 2^63 if halved once
        self.apart = -(-np.take_along_axis(apart, self.order, 1) // 4)

    def assign(self, v: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid and squared distance of each vector, given its earlier centroid; also how many comparisons."""
        own = ((v - self.centroids[before]) ** 2).sum(1)
        # how far each vector's scan goes: centroids at up to twice its distance, the earlier one itself included
        reach = np.empty(len(v), np.int64)
        for c in np.unique(before):
            at = before == c
            reach[at] = np.searchsorted(self.apart[c], own[at], side="right")
        reach = np.maximum(reach, 1)
        best, dist = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
        ends = np.cumsum(reach)
        start = 0
        while start < len(v):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
            n = reach[start:stop]
            row = np.repeat(np.arange(start, stop), n)
            first = np.cumsum(n) - n
            which = self.order[before[row], np.arange(len(row)) - np.repeat(first, n)]
            d = ((v[row] - self.centroids[which]) ** 2).sum(1)
            least = np.minimum.reduceat(d, first)
            # of the nearest ones the smallest number
            best[start:stop] = np.minimum.reduceat(np.where(d == np.repeat(least, n), which, len(self.centroids)), first)
            dist[start:stop] = least
            start = stop
        return best, dist, int(ends[-1]) if len(v) else 0


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def assign(table: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """(key, v, cluster, distance, compared) from (key, v, cluster), where cluster is the assignment before. `compared`
    is how many comparisons the row's batch took, on the batch's first row, and 0 elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = Orders(centroids)
        for b in batches:
            if not b.num_rows:
                continue
            cluster, distance, n = orders.assign(_matrix(b.column(1)), b.column(2).to_numpy(zero_copy_only=False).astype(np.int64))
            compared = np.zeros(b.num_rows, np.int64)
            compared[0] = n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(distance), pa.array(compared)], [key, "v", "cluster", "distance", "compared"])

    kind = table.schema[key].dataType.simpleString()
    return table.select(key, "v", "cluster").mapInArrow(run, f"{key} {kind}, v array<int>, cluster int, distance long, compared long")


def sums(table: DataFrame) -> DataFrame:
    """(cluster, n, inertia, total array) of an assigned table. A task hands on a row for each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            v, cluster = _matrix(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            distance = b.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(cluster).tolist():
                at = cluster == c
                got = total.setdefault(c, [0, 0, [0] * v.shape[1]])
                got[0] += int(at.sum())
                got[1] += sum(distance[at].tolist())
                got[2] = [x + y for x, y in zip(got[2], v[at].sum(0).tolist())]
        rows = [(c, i - 2, Decimal(x)) for c, (n, inertia, s) in total.items() for i, x in enumerate((n, inertia, *s))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.decimal128(38, 0))], ["cluster", "i", "x"])

    parts = table.select("cluster", "v", "distance").mapInArrow(run, "cluster int, i int, x decimal(38,0)")
    return parts.groupBy("cluster", "i").agg(F.sum("x").cast("decimal(38,0)").alias("x"))


def _totals(table: DataFrame) -> dict[int, dict[int, int]]:
    """The sums as numbers: at most clusters times (components + 2) rows."""
    out: dict[int, dict[int, int]] = {}
    for r in sums(table).collect():
        out.setdefault(r.cluster, {})[r.i] = int(r.x)
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2", key: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, np.ndarray, list[int]]:
    """Assignments (key, v, cluster, distance, cluster_inertia, inertia, centroid_sha256) after `rounds` rounds, the final
    centroids, and the comparisons of vector and centroid that each pass took."""
    spark = common.ship(vectors.sparkSession)
    store = common.Store(spark, "sort-means")
    table = store(integers(vectors, dims, scale, key, column).withColumn("cluster", F.lit(0)), "vectors")
    centroids, name, compared = first_centroids(table, k, seed, key), "vectors", []
    totals: dict[int, dict[int, int]] = {}
    for n in range(rounds + 1 if len(centroids) else 0):
        table = store(assign(table, centroids, key), f"round-{n}")
        store.drop(name)
        name = f"round-{n}"
        totals = _totals(table)
        compared.append(int(table.agg(F.sum("compared")).first()[0]))
        if n < rounds:
            for c, got in totals.items():
                centroids[c] = [got[i] // got[-2] for i in range(dims)]
    if not totals:
        table = table.withColumn("distance", F.lit(0).cast("long"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, got[-1], digests[c]) for c, got in totals.items()]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, centroid_sha256 string")  # k rows at most
    done = table.join(F.broadcast(about), "cluster").withColumn("inertia", F.lit(sum(r[1] for r in rows)).cast("long"))
    return done.select(key, "v", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids, compared
