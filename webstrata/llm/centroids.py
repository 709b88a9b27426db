"""Clustering of integer vectors around centroids, with equal-average equal-variance search for the nearest one.

For vectors of d components, with the sums s and the deviations v = |x - mean(x)| of vector and centroid,
(s1 - s2)^2 / d + (v1 - v2)^2 never exceeds their squared distance. Centroids are sorted by their sum, which orders them
as their mean does. A vector looks at them outward from its own sum: the first term ends its search as soon as it
exceeds the best distance so far, since all centroids left are further off in the mean, and both terms together reject
single centroids. What remains is compared in whole numbers, so that distances and ties are exact. The search runs over
many vectors of a batch at once.

A round sends nothing but sums per task and cluster through a shuffle; the driver holds only the centroids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webstrata.llm.frames import name
from webstrata.session import cut

#: Integer components beyond this bound have no result: squared distances would not fit 64 bits for 64 components.
LARGEST = 1 << 26
#: Vectors compared at a time.
ROWS = 8192
#: Bounds are floating-point numbers: they reject only if they exceed the best distance by more than their error.
_RELATIVE, _ABSOLUTE = 1e-9, 1e-3


def integer_vectors(vectors: DataFrame, dim: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors of exactly `dim` components, none null or not finite, as floor(scale * component).

    `v` is null where a component lies beyond `LARGEST`.
    """
    given = name(vector_col).cast("array<double>")
    sound = F.forall(given, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = vectors.where((F.size(given) == dim) & sound)
    whole = F.transform(given, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint"))
    # The bound is tested on the product, which may not fit a bigint.
    small = F.forall(given, lambda x: F.abs(x * F.lit(float(scale))) <= F.lit(float(LARGEST)))
    return kept.select(name(id_col).alias("id"), F.when(small, whole).alias("v"))


def _deviations(x: np.ndarray) -> np.ndarray:
    centred = x - x.mean(axis=1, keepdims=True)
    return np.sqrt(np.einsum("ij,ij->i", centred, centred))


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of the nearest centroid of every vector, the smaller number of equals; and how many
    distances were computed."""
    n, (k, d) = len(vectors), centroids.shape
    sums = centroids.sum(axis=1)
    order = np.lexsort((np.arange(k), sums))
    sums, ranked, spread = sums[order], centroids[order], _deviations(centroids.astype(float))[order]
    own_sum, own_spread = vectors.sum(axis=1), _deviations(vectors.astype(float))
    right = np.searchsorted(sums, own_sum)
    left = right - 1
    far = np.iinfo(np.int64).max
    best, who, computed = np.full(n, far), np.full(n, k), 0
    active = np.arange(n)
    while len(active):
        a, b, s = left[active], right[active], own_sum[active]
        below = np.where(a >= 0, s - sums[np.maximum(a, 0)], far)
        above = np.where(b < k, sums[np.minimum(b, k - 1)] - s, far)
        down, gap = below <= above, np.minimum(below, above)
        bound = gap.astype(float) ** 2 / d
        # Every centroid left has a mean at least as far away: who fails here is done.
        open_ = (gap < far) & (bound * (1 - _RELATIVE) - _ABSOLUTE <= best[active])
        active, down, bound, at = active[open_], down[open_], bound[open_], np.where(down, a, b)[open_]
        left[active[down]] -= 1
        right[active[~down]] += 1
        bound += (own_spread[active] - spread[at]) ** 2
        close = bound * (1 - _RELATIVE) - _ABSOLUTE <= best[active]
        rows, at = active[close], at[close]
        difference = vectors[rows] - ranked[at]
        distance, number = np.einsum("ij,ij->i", difference, difference), order[at]
        better = (distance < best[rows]) | (distance == best[rows]) & (number < who[rows])
        best[rows[better]], who[rows[better]] = distance[better], number[better]
        computed += len(rows)
    return who, best, computed


def _blocks(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(first row, rows that have a vector, their vectors), a bounded number at a time."""
    for first in range(0, batch.num_rows, ROWS):
        column = batch.column(1).slice(first, ROWS)
        held = column.drop_null()
        yield first, column, held.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(held), dim)


def start(vectors: DataFrame, k: int, seed: int, dim: int) -> np.ndarray:
    """The k vectors whose ids have the smallest SHA-256 of `seed:id`, in that order; null ids come last. Without any
    vector, a centroid at the origin that nothing will move."""
    rows = (vectors.where("v is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256).alias("h"), "v")
            .orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect())
    return np.array([r.v for r in rows] or [[0] * dim], np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every centroid replaced by the exact floor of its vectors' mean; one without vectors stays."""
    k, dim = centroids.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, _, block in _blocks(batch, dim):
                who, _, _ = nearest(block, centroids)
                n += np.bincount(who, minlength=k)
                np.add.at(total, who, block)
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n[held]), pa.array(list(total[held]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "total"])

    partial = vectors.mapInArrow(sums, "cluster bigint, n bigint, total array<bigint>")
    rows = (partial.select("cluster", "n", F.posexplode("total").alias("i", "part")).groupBy("cluster", "i")
            .agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(20,0)")).alias("total")).collect())
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.i] = int(r.total) // r.n
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector."""
    k, dim = centroids.shape
    schema = T.StructType([vectors.schema["id"], T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, column, block in _blocks(batch, dim):
                held = column.is_valid().to_numpy(zero_copy_only=False)
                cluster, distance = np.zeros(len(column), np.int32), np.zeros(len(column), np.int64)
                cluster[held], distance[held], _ = nearest(block, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, ROWS), pa.array(cluster, mask=~held),
                                                  pa.array(distance, mask=~held)], names=["id", "cluster", "distance"])

    return vectors.mapInArrow(assign, schema)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dim: int = 64, scale: int = 64,
            id_col: str = "vec_id", vector_col: str = "embedding",
            watch: Callable[[int, np.ndarray], None] | None = None) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that can be clustered.

    Vectors that are null, of another length, or hold a null, NaN or infinite component have no row. A vector with an
    integer component beyond `LARGEST` has a row without results and moves no centroid. Repeated rows and ids are
    vectors of their own. With fewer than k vectors there are fewer centroids, without any no row. Inertias beyond 64
    bits are null. `watch` sees the centroids before every round and at the end.
    """
    whole = cut(integer_vectors(vectors, dim, scale, id_col, vector_col))
    centroids = start(whole, k, seed, dim)
    for number in range(rounds):
        if watch:
            watch(number, centroids)
        centroids = moved(whole, centroids)
    if watch:
        watch(rounds, centroids)
    found = cut(assigned(whole, centroids))
    # One row per cluster, at most k.
    sums = {r.cluster: int(r.total) for r in found.where("cluster is not null").groupBy("cluster")
            .agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("total")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    report = [(c, fits(total), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
              for c, total in sums.items()]
    per_cluster = found.sparkSession.createDataFrame(report, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(per_cluster), "cluster", "left").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
