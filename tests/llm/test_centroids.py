import hashlib
import math

import numpy as np
import pytest

from webstrata.llm.centroids import LARGEST, cluster, nearest

SCHEMA = "vec_id long, embedding array<float>, cluster string, id int, v int"


def plain(rows, k, rounds, seed, dim=64, scale=64):
    """(id, cluster, distance), final centroids and distances per cluster, by comparing every vector with every centroid."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e]) for i, e in rows
            if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    known = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in known + sorted(("", v) for i, v in kept if i is None)][:k]

    def best(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = [best(v)[1] for _, v in kept]
        for c in set(own):
            members = [v for (_, v), o in zip(kept, own) if o == c]
            centroids[c] = [sum(column) // len(members) for column in zip(*members)]
    found = [(i, *best(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, o, d in found if o == c) for _, c, _ in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digest[c]) for i, c, d in found), key=str)


def vectors(n, seed, dim=64, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    return [(i, [float(x) for x in (spread * (centres[i % 7] + rng.normal(size=dim) * rng.random())).astype(np.float32)]) for i in range(n)]


@pytest.mark.parametrize("n, k, rounds, spread", [(300, 16, 3, 0.3), (200, 40, 2, 3.0), (10, 16, 1, 1.0), (64, 1, 2, 100.0)])
def test_clusters_equal_the_plain_search(spark, n, k, rounds, spread):
    rows = vectors(n, n, spread=spread)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted((tuple(r) for r in cluster(df, k, rounds).collect()), key=str) == plain(rows, k, rounds, 1)


def test_odd_vectors(spark):
    rows = vectors(40, 3)
    good = rows[0][1]
    odd = [(None, good), (5, good), (5, good), (50, None), (51, []), (52, good[:63]), (53, good + [0.0]), (54, [None, *good[1:]]),
           (55, [float("nan"), *good[1:]]), (56, [float("-inf"), *good[1:]]), (57, [-0.0] * 64), (58, [0.0] * 64), (59, [-1e-30] * 64)]
    df = spark.createDataFrame([(i, e, "x", 1, 2) for i, e in rows + odd], SCHEMA)
    got = sorted((tuple(r) for r in cluster(df, 5, 2).collect()), key=str)
    assert got == plain(rows + odd, 5, 2, 1) and len(got) == 46


def test_components_out_of_range_have_no_result(spark):
    rows = vectors(20, 4)
    huge = [(100, [1e30] * 64), (101, [float(LARGEST)] * 64)]
    edge = (102, [LARGEST / 64, -LARGEST / 64] * 32)
    got = {r.vec_id: tuple(r)[1:] for r in cluster(spark.createDataFrame(rows + huge + [edge], "vec_id long, embedding array<float>"), 4, 2).collect()}
    assert got.pop(100) == got.pop(101) == (None,) * 5
    want = {i: tuple(rest) for i, *rest in plain(rows + [edge], 4, 2, 1)}
    assert got == want


def test_empty_and_useless_tables(spark):
    assert cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert cluster(spark.createDataFrame([(1, None, "", 1, 1)], SCHEMA)).collect() == []


@pytest.mark.parametrize("seed, scale, ties", [(1, 10, True), (2, 1000, False), (3, LARGEST // 8, False), (4, 2, True)])
def test_the_bounds_never_reject_the_nearest(seed, scale, ties):
    rng = np.random.default_rng(seed)
    c = rng.integers(-scale, scale + 1, (30, 8))
    if ties:
        c[10:20] = c[:10]
    x = np.concatenate([rng.integers(-scale, scale + 1, (400, 8)), c])
    who, distance, _ = nearest(x, c)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (distance == every.min(axis=1)).all() and (who == every.argmin(axis=1)).all()


def test_most_centroids_are_rejected_unseen():
    rng = np.random.default_rng(5)
    c = rng.integers(-5, 6, (200, 16)) + rng.integers(-400, 401, (200, 1))
    x = c[rng.integers(0, 200, 2000)] + rng.integers(-3, 4, (2000, 16))
    assert nearest(x, c)[2] < 2000 * 200 / 20


def test_rounds_can_be_watched(spark):
    seen = []
    df = spark.createDataFrame(vectors(30, 6), "vec_id long, embedding array<float>")
    cluster(df, 3, 2, watch=lambda n, c: seen.append((n, c.shape))).collect()
    assert seen == [(0, (3, 64)), (1, (3, 64)), (2, (3, 64))]
