import hashlib

import numpy as np
import pytest

from pulsefeat.llm import centroids


def brute_force(rows, k, rounds, dimension, scale):
    kept = [(i, np.floor(scale * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), tuple(p.tolist())) for i, p in kept if i is not None)[:k]
    c = [list(p) for _, p in starts]

    def assign():
        return [min((sum((int(a) - b) ** 2 for a, b in zip(p, m)), j) for j, m in enumerate(c)) for _, p in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(c)):
            mine = [p for (_, p), (_, o) in zip(kept, own) if o == j]
            if mine:
                c[j] = [int(s) // len(mine) for s in np.sum(mine, axis=0)]
    own = assign()
    inertia = [sum(d for d, o in own if o == j) for j in range(len(c))]
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, o, d, inertia[o], sum(inertia), sha[o]) for (i, _), (d, o) in zip(kept, own)), key=str)


@pytest.mark.parametrize("k,rounds,spread", [(1, 3, 1.0), (2, 4, 0.2), (8, 10, 0.3), (17, 6, 1.0), (60, 3, 0.1)])
def test_equals_brute_force(spark, k, rounds, spread):
    rng = np.random.default_rng(k)
    centres = rng.standard_normal((6, 4)) * 3
    rows = [(i, (centres[i % 6] + spread * rng.standard_normal(4)).tolist()) for i in range(300)]
    rows += [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [1.0, float("nan"), 2.0, 3.0]), (904, [1.0] * 5), (None, [0.5] * 4), rows[3], rows[3], (3, [9.0] * 4)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, was int").repartition(5)
    got = centroids.cluster(df, k, rounds, 4, 16)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_force(rows, k, rounds, 4, 16)


def test_ties_on_a_grid_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 5), float(i // 5 % 5)]) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>")
    assert sorted(map(tuple, centroids.cluster(df, 9, 7, 2, 1).collect()), key=str) == brute_force(rows, 9, 7, 2, 1)


def test_empty_few_and_huge(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.cluster(spark.createDataFrame([], schema)).collect() == []
    few = centroids.cluster(spark.createDataFrame([(1, [1.0] * 64), (2, [5.0] * 64)], schema)).collect()
    assert {r.cluster for r in few} == {0, 1} and all(r.distance == 0 for r in few)
    huge = centroids.cluster(spark.createDataFrame([(1, [1e300] * 64), (2, [-1e300] * 64), (3, [-1e38] * 64)], schema), k=1).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and all(0 < r.distance < 2**63 for r in huge)


def test_bounds_save_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 8))
    x = (centres[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))).astype(np.int64)
    before = centroids.Centroids.of(centres + rng.integers(-20, 20, centres.shape))
    own, least, second = before.two_nearest(x, np.arange(40))
    now = centroids.Centroids.of(centres)
    moved = centroids.up(np.sqrt(((now.points - before.points) ** 2).sum(axis=1)))
    got, upper, lower, measured = centroids.exponion(x, own.astype(np.int32), np.sqrt(least) * 1.0001, np.sqrt(second) * 0.9999, now, moved)
    true = np.sort(np.sqrt(centroids.squared(x, centres)), axis=1)
    assert (got == now.two_nearest(x, np.arange(40))[0]).all() and measured < 4000 * 40 / 8
    assert (upper >= true[:, 0]).all() and (lower <= true[:, 1]).all()
