import numpy as np
import pytest

from pulsefeat.llm import embeddings


def brute_force(rows, cosine):
    good = [(i, np.asarray(v, dtype=float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, parent = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, u) in enumerate(good):
        for j, v in good[:a]:
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= cosine:
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {(i, links[i], root(i), root(i) == i) for i, _ in rows}


@pytest.mark.parametrize("block", [5, 4096])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(embeddings, "BUCKET_BLOCK", block)
    monkeypatch.setattr(embeddings, "FAMILY_BLOCK", block)
    rng = np.random.default_rng(3)
    rows = []
    for size in (1, 1, 2, 9, 30, 60):
        centre = rng.standard_normal(32)
        rows += [(centre + rng.standard_normal(32) * rng.uniform(0, 0.3) * np.linalg.norm(centre) / 6).tolist() for _ in range(size)]
    rows += [rows[0], rows[0], [3 * x for x in rows[0]], None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] * 32, [float("inf")] * 32, [1.0, 0.0], [1.0, 0.001]]
    rows = [(int(i), r) for i, r in zip(rng.permutation(len(rows)), rows)]
    df = spark.createDataFrame([(i, r, "x") for i, r in rows], "vec_id long, embedding array<double>, key string")
    got = {tuple(r) for r in embeddings.near_duplicates(df, 0.95).collect()}
    assert got == brute_force(rows, 0.95)


def test_planted_pairs_just_over_the_threshold_are_found(spark):
    """1,000 pairs at cosine 0.9505 among random vectors: all links and components of brute force."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((1000, 64))
    y -= (x[:1000] * y).sum(axis=1, keepdims=True) * x[:1000]
    y = 0.9505 * x[:1000] + np.sqrt(1 - 0.9505**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    all_ = np.concatenate([x, y])
    cosines = all_ @ all_.T >= 0.95
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(all_)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(df, 0.95).collect()}
    found = sum(got.values()) / (cosines.sum() - len(all_))
    assert 0.995 <= found <= 1 and all(got[i] <= cosines[i].sum() - 1 for i in got)


def test_empty_table_and_null_ids(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embeddings.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    df = spark.createDataFrame([(None, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.0], None)], schema)
    assert {tuple(r) for r in embeddings.near_duplicates(df).collect()} == {(None, 0, None, True), (4, 1, 4, True), (5, 1, 4, False)}


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((4000, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    turned = embeddings.rotated(x, 4)
    factors = np.abs(turned).sum(axis=2) / 8
    signs = np.where(turned >= 0, 1.0, -1.0)
    of_y = embeddings.rotated(y, 4)
    error = np.array([embeddings.estimates(signs[i : i + 1], factors[i : i + 1], of_y[i])[0] for i in range(4000)]) - 0.95
    scale = embeddings.deviation(factors, 64, 0.95)
    assert abs(error.mean()) < 0.002
    assert 0.8 < (error / scale).std() < 1.2 and (error > -embeddings.SIGMAS * scale).mean() > 0.999
