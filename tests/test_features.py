import math

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsefeat.functions import names, safe
from pulsefeat.operators import families as fam
from pulsefeat.operators import quality, split, validation
from pulsefeat.operators.engineer import FeatureEngineer, Settings, engineer

SERIES = [1.0, 2.0, None, 4.0, None, 8.0]


def values(df, column, order="i"):
    return [r[0] for r in df.orderBy(order).select(column).collect()]


def series(spark, xs, machine="a"):
    return spark.createDataFrame([(i, machine, x) for i, x in enumerate(xs)], "i int, machine string, x double")


def close(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12)) for x, y in zip(a, b))


def test_exponential_mean_over_nulls(spark):
    df = series(spark, SERIES)
    w = fam.history("machine", "i")
    out, features = fam.ewm(df, ["x"], w, (3,))
    assert close(values(fam.add(out, features), "ewm__x__span_3"), [None, 1.0, 1.5, 1.5, 3.1666666666666665, 3.1666666666666665])


def test_exponential_mean_equals_pandas_on_long_gaps(spark):
    xs = [math.sin(i) * 10 if i % 3 else None for i in range(150)] + [None] * 120 + [float(i) for i in range(20)]
    out, features = fam.ewm(series(spark, xs), ["x"], fam.history("machine", "i"), (3, 10))
    df = fam.add(out, features)
    for n in (3, 10):
        want = pd.Series(xs, dtype=float).shift(1).ewm(span=n, adjust=False, min_periods=1).mean()
        assert close(values(df, f"ewm__x__span_{n}"), [None if pd.isna(v) else v for v in want])


def test_rolling_median_and_deviation(spark):
    df = fam.add(series(spark, SERIES), fam.rolling("x", fam.history("machine", "i"), (3,)))
    assert values(df, "rolling__x__median_3") == [None, 1.0, 1.5, 1.5, 3.0, 4.0]
    assert values(df, "rolling__x__std_3") == [None, 0.0, 0.5, 0.5, 1.0, 0.0]


def test_constant_history_has_no_zscore(spark):
    df = fam.add(series(spark, [5.0] * 4), fam.anomaly("x", fam.history("machine", "i"), (5,)))
    assert values(df, "anomaly__x__zscore_5") == [None] * 4 and values(df, "anomaly__x__flag_5") == [0] * 4


def test_guards(spark):
    df = spark.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 1e-9), (2, 1.0, 1e-8), (3, None, 1.0)], "i int, n double, d double")
    assert values(df.withColumn("q", safe.safe_divide(F.col("n"), F.col("d"))), "q") == [None, None, 1e8, None]
    assert values(df.withColumn("q", safe.safe_ratio(F.col("n"), F.col("d"))), "q") == [None, None, None, None]
    x = spark.createDataFrame([(0, -2.0), (1, -1.0), (2, 0.0), (3, float("inf")), (4, float("nan"))], "i int, x double")
    assert values(x.withColumn("y", safe.safe_log1p(F.col("x"))), "y")[:3] == [None, None, 0.0]
    assert values(x.withColumn("y", safe.clamped_log1p(F.col("x"))), "y")[:3] == [0.0, 0.0, 0.0]
    assert values(x.withColumn("y", safe.safe_sqrt(F.col("x"))), "y")[:2] == [0.0, 0.0]
    assert values(x.withColumn("y", safe.finite(F.col("x"))), "y")[3:] == [None, None]


def test_null_machines_are_one_group_and_first_rows_are_null(spark):
    df = spark.createDataFrame([(0, None, 1.0), (1, None, 2.0), (2, "b", 3.0)], "i int, machine string, x double")
    assert values(fam.add(df, fam.lag("x", fam.history("machine", "i"), (1,))), "lag__x__lag_1") == [None, 1.0, None]


def test_history_is_causal(spark):
    xs = [float(i * i % 17) for i in range(30)]
    w = fam.history("machine", "i")

    def features(values_):
        df, means = fam.ewm(series(spark, values_), ["x"], w)
        return fam.add(df, fam.lag("x", w) + fam.rolling("x", w) + means).orderBy("i").drop("x").collect()

    changed = xs[:20] + [1e6] + xs[21:]
    assert features(xs)[:21] == features(changed)[:21]


def test_skew_and_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,)], "x double")
    row = quality.feature_statistics(df).first()
    assert math.isclose(row.skew, 1.1376243669576889) and row.q1 == 1.75


def machine_rows(spark, n=400):
    rows = [(f"u{i}", "LMH"[i % 3], 298.0 + i % 5, 308.0 + i % 4, 1300.0 + i, 30.0 + i % 40, float(i % 250), int(i % 11 == 0), 0) for i in range(n)]
    return spark.createDataFrame(rows, "uid string, type string, air_temperature_k double, process_temperature_k double, rotational_speed_rpm double, torque_nm double, tool_wear_min double, machine_failure int, twf int")


def test_fit_learns_from_training_rows_only(spark):
    parts = split.stratified(machine_rows(spark), "uid")
    frames = [parts.where(F.col("split") == s).drop("split") for s in split.PARTS]
    model, out = engineer(*frames, settings=Settings(parity_wear=False))
    assert out[0].columns == out[1].columns == out[2].columns
    assert "difference__process_minus_air_temperature" in model.learned.duplicate and "ratio__torque_to_speed_ratio" in model.learned.duplicate
    assert not [c for c in model.learned.retained if c in names.LABELS] and "missingness__type" in model.learned.constant
    again = FeatureEngineer.from_state(model.state()).transform(frames[2])
    assert again.orderBy("uid").collect() == out[2].orderBy("uid").collect()
    lacking = model.transform(frames[2].drop("torque_nm"))
    assert lacking.columns == out[2].columns


def test_timeseries_engineer(spark):
    df = machine_rows(spark, 60).withColumns({"machine_id": F.when(F.substring("uid", 2, 1) < "3", "M1").otherwise("M2"), "timestamp": F.timestamp_seconds(F.lit(1767225600) + 60 * F.substring("uid", 2, 9).cast("int"))})
    model = FeatureEngineer(Settings(timestamp="timestamp", machine="machine_id", lags=(1,), windows=(3,), spans=(3,), periods=(1,), z_windows=(5,))).fit(df)
    out = model.transform(df)
    assert model.learned.has_time and "lag__torque_nm__lag_1" in out.columns and "ewm__torque_nm__span_3" in out.columns
    last = model.online(df.where("uid = 'u59'"), df.where("uid != 'u59'")).collect()
    assert [r.uid for r in last] == [out.orderBy(F.desc("machine_id"), F.desc("timestamp")).first().uid]


@pytest.mark.parametrize("bad", [{"lags": ()}, {"windows": (0,)}, {"statistics": ("mode",)}, {"z_limit": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings(**bad)


def test_names():
    assert names.safe_name("Air temperature [K]") == "air_temperature_k"
    assert names.canonical_names(["UDI", "Product ID", "Air temperature [K]", "air_temp", "Torque [Nm]"]) == ["uid", "product_id", "air_temperature_k", "air_temp", "torque_nm"]
    with pytest.raises(ValueError):
        names.canonical_names(["UDI", "UID"])
    assert names.find_column(["Target"], "target") == "Target" and names.machine_column(["x", "Equipment Number"]) == "Equipment Number"


def test_strict_conversion_and_time_detection(spark):
    df = spark.createDataFrame([("1.5", "2026-01-01 08:00:00", 3.0), ("x", "2026-01-02", 4.0)], "a string, event_time string, lifetime double")
    assert [r.a for r in validation.convert_numeric(df, ["a"]).collect()] == [1.5, None]
    with pytest.raises(ValueError):
        validation.convert_numeric(df, ["a"], strict=True)
    assert validation.timestamp_column(df) == "event_time"


def test_failure_logic_edges(spark):
    rows = [("L", 100.0, 115.0), ("M", 100.0, 115.0), ("h", 100.0, 115.0), ("?", 100.0, 500.0)]
    df = spark.createDataFrame([(t, 300.0, 310.0, 1500.0, q, w) for t, w, q in rows], "type string, air_temperature_k double, process_temperature_k double, rotational_speed_rpm double, torque_nm double, tool_wear_min double")
    assert [r.logic_osf for r in validation.failure_logic(df).collect()] == [1, 0, 0, 0]


def test_correlations_of_constants_and_empty_results(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, 1.0)], "a double, b double, c double")
    found = {(r.feature_a, r.feature_b): r.correlation for r in quality.correlation_pairs(df, ["a", "b", "c"]).collect()}
    assert set(found.values()) == {None}
    assert quality.high_correlations(quality.correlation_pairs(df, ["a", "b"])).columns == ["feature_a", "feature_b", "n", "correlation", "abs_correlation"]


def test_one_exchange_serves_all_history_features(spark):
    df = series(spark, [1.0])
    w = Window.partitionBy("machine").orderBy("i")
    plan = fam.add(df, fam.lag("x", w) + fam.rolling("x", w) + fam.anomaly("x", w))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_no_window_over_the_whole_table(spark):
    from pulsefeat.operators import split
    from pulsefeat.sources.views import machines

    df = machines(spark, "/root/testdata/sf0.001")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    model = FeatureEngineer(Settings()).fit(df)
    assert "Window" not in plan(model.transform(df)) and "tool_wear__cumulative_normalized" in model.learned.retained
    parts = split.stratified(df, "uid").cache()
    want = {c: [n * s // 100 for s in (70, 85)] for c, n in df.groupBy("machine_failure").count().collect()}
    got = {(r.machine_failure, r.split): r["count"] for r in parts.groupBy("machine_failure", "split").count().collect()}
    for c, (first, second) in want.items():
        assert (got[c, "train"], got[c, "validation"]) == (first, second - first)


def test_split_keeps_rows_of_a_key_together(spark):
    from pulsefeat.operators import split

    df = spark.createDataFrame([(i % 40 if i % 7 else None, None if i % 50 == 0 else i % 2) for i in range(400)], "k long, y int")
    parts = split.stratified(df, "k", "y")
    assert parts.columns == ["k", "y", "split"] and parts.count() == 400 and parts.groupBy("k", "y").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert split.stratified(df.limit(0), "k", "y").collect() == []


@pytest.mark.parametrize("bins", [16, 1024])
def test_exact_quantiles(spark, bins, monkeypatch):
    import numpy as np

    from pulsefeat.operators import order

    monkeypatch.setattr(order, "BINS", bins)
    rng = np.random.default_rng(1)
    table = {"a": rng.standard_normal(500), "b": rng.integers(0, 4, 500).astype(float), "c": np.full(500, 7.5), "d": np.exp(20 * rng.standard_normal(500))}
    rows = [(*(float(v[i]) for v in table.values()), None, float(i) if i < 1 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    got = order.exact_quantiles(df, list("abcdef"), [0, 0.1, 0.5, 0.75, 1])
    for c, v in table.items():
        assert np.allclose(got[c], np.quantile(v, [0, 0.1, 0.5, 0.75, 1]), rtol=1e-12)
    assert got["e"] is None and got["f"] == [0.0] * 5 and order.exact_quantiles(df, [], [0.5]) == {}
