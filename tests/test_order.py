import numpy as np
import pytest

from pulsefeat.operators import order


@pytest.mark.parametrize("bins", [8, 64, 1024])
def test_quantiles_of_any_distribution(spark, bins, monkeypatch):
    monkeypatch.setattr(order, "BINS", bins)
    rng = np.random.default_rng(bins)
    n = 20000
    table = {
        "wide": np.exp(100 * rng.standard_normal(n)), "ties": rng.integers(0, 3, n).astype(float), "lump": np.where(rng.random(n) < 0.9, 5.0, rng.standard_normal(n)),
        "line": np.arange(n, dtype=float), "two": np.where(np.arange(n) < n // 2, -1e300, 1e300), "deep": 1 + np.arange(n) * 2.0**-52,
    }
    shares = [0, 0.001, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1]
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in table.values()])), ", ".join(f"{c} double" for c in table)).repartition(7)
    got = order.exact_quantiles(df, list(table), shares)
    for c, v in table.items():
        ordered, ranks = np.sort(v), np.array(shares) * (n - 1)
        lo, hi = ordered[np.floor(ranks).astype(int)], ordered[np.ceil(ranks).astype(int)]
        assert np.allclose(got[c], lo + (hi - lo) * (ranks - np.floor(ranks)), rtol=1e-12), c


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17])
def test_quantiles_of_few_values(spark, n):
    v = [float((i * 7) % 5) for i in range(n)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,), (float("nan"),), (float("inf"),)], "x double")
    shares = [0, 0.1, 0.5, 0.9, 1]
    assert np.allclose(order.exact_quantiles(df, ["x"], shares)["x"], np.quantile(v, shares))


def test_three_scans_whatever_the_data(spark):
    """121 values over 120 decades took sixteen rounds of bins; now any table is scanned three times."""
    executions = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    wide = spark.createDataFrame([(10.0**k, float(k)) for k in range(-60, 61)], "x double, y double")
    alike = spark.range(30000).selectExpr("CAST(id % 2 AS DOUBLE) AS x", "1 + id * power(2, -52) AS y")
    for df in (wide, alike):
        before = executions()
        order.exact_quantiles(df, ["x", "y"], [0.25, 0.5, 0.75])
        assert executions() - before == 3
    assert order.exact_quantiles(wide, ["x", "y"], [0.5]) == {"x": [1.0], "y": [0.0]}
    nothing = wide.selectExpr("CAST(NULL AS DOUBLE) AS x")
    before = executions()
    assert order.exact_quantiles(nothing, ["x"], [0.5]) == {"x": None} and executions() - before == 1


def test_brackets_hold_few_values(spark):
    """The second sketch, over a row per column and bracket, took most of the time; narrow brackets need none."""
    df = spark.range(200_000).selectExpr("CAST(pmod(xxhash64(id), 1000003) AS DOUBLE) AS x0")
    (places,) = order._brackets(df, 1, [0.25, 0.5])
    for place in places:
        assert df.where(f"x0 BETWEEN {place.lo} AND {place.hi}").count() < 0.003 * 200_000
