import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsefeat.operators import families as fam
from pulsefeat.operators import sequence
from pulsefeat.operators.engineer import FeatureEngineer, Settings


def past(w):
    return fam.lag("x", w, (1, 3)) + fam.rolling("x", w, (5,)) + fam.rate_of_change("x", w, (2,)) + fam.anomaly("x", w, (5,))


def table(spark, machines, gaps=0.3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(m, i, None if rng.random() < gaps else float(rng.normal())) for m, n in machines for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame([(None if m is None else str(m), int(i), x) for m, i, x in rows], "machine string, i int, x double").repartition(3)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (str(r[0]), r[1]))


@pytest.mark.parametrize("machines,gaps,size", [([("hot", 400)], 0.3, 7), ([("hot", 300), ("a", 3), (None, 50), ("z", 1)], 0.9, 16), ([(f"m{i}", 5) for i in range(40)], 0.2, 32), ([("hot", 200)], 0.97, 5)])
def test_chunks_give_the_rows_of_one_window(spark, machines, gaps, size):
    df = table(spark, machines, gaps)
    whole, features = fam.with_history(df, "machine", "i", (), past, 5, ["x"], (2, 3, 30), chunk_rows=0)
    chunks, again = fam.with_history(df, "machine", "i", (), past, 5, ["x"], (2, 3, 30), chunk_rows=size)
    assert [f.name for f in features] == [f.name for f in again] and whole.columns == chunks.columns
    a, b = sorted_rows(whole), sorted_rows(chunks)
    assert len(a) == len(b) == sum(n for _, n in machines)
    for r, s in zip(a, b):
        assert all(v == w or (v is not None and w is not None and math.isclose(v, w, rel_tol=1e-9, abs_tol=1e-12)) for v, w in zip(r, s)), (r, s)


@pytest.mark.parametrize("size", [None, 9])
def test_a_table_that_is_one_sequence(spark, size, monkeypatch):
    monkeypatch.setattr(sequence, "CHUNK", 11)
    df = table(spark, [("only", 150)])
    got, _ = fam.with_history(df, None, "i", (), lambda w: fam.rolling("x", w, (4,), ("mean",)), 4, ["x"], (5,), chunk_rows=size)
    got = got.orderBy("i").toPandas()
    shifted = got["x"].astype(float).shift(1)
    assert np.allclose(got["rolling__x__mean_4"], shifted.rolling(4, min_periods=1).mean(), equal_nan=True)
    assert np.allclose(got["ewm__x__span_5"], shifted.ewm(span=5, adjust=False, min_periods=1).mean(), equal_nan=True)


def test_one_machine_keeps_every_task_busy(spark):
    """Of one machine's 4,000 rows, no task evaluates more than two chunks, whatever the frames."""
    df = spark.range(4000).select(F.lit("hot").alias("machine"), F.col("id").alias("i"), (F.col("id") % 17).cast("double").alias("x"))
    order = fam.sequence_order("i")
    chunks = sequence.Chunks(sequence.placed(df, "machine", order), "machine", 500)
    spread = chunks.with_halo(20).repartition(8, "__chunk").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 3 and chunks.with_halo(20).count() == 4000 + 8 * 20
    assert [r.i for r in chunks.rows.orderBy("__place").collect()] == list(range(4000))
    assert chunks.rows.select("__place").distinct().count() == 4000


def test_long_sequences_are_cut_by_themselves(spark, monkeypatch):
    monkeypatch.setattr(sequence, "LONGEST", 50)
    monkeypatch.setattr(sequence, "CHUNK", 20)
    seen = []
    original = sequence.placed
    monkeypatch.setattr(sequence, "placed", lambda *a: seen.append(a[1]) or original(*a))
    fam.with_history(table(spark, [("a", 40), ("b", 50)]), "machine", "i", (), past, 5)
    assert seen == []
    df, _ = fam.with_history(table(spark, [("a", 40), ("b", 51)]), "machine", "i", (), past, 5)
    assert seen == ["machine"] and df.count() == 91


def test_scan_over_batches_equals_pandas():
    rng = np.random.default_rng(4)
    x = np.where(rng.random(500) < 0.5, np.nan, rng.normal(size=500))
    start = np.zeros(500, dtype=bool)
    start[[0, 30, 31, 200]] = True
    want = np.concatenate([pd.Series(part).shift(1).ewm(span=4, adjust=False).mean() for part in np.split(x, [30, 31, 200])])
    for cuts in ([], [1, 2, 30, 99], list(range(10, 500, 10))):
        scan = sequence.MeanScan([4])
        got = np.concatenate([scan.means_before(a, b)[:, 0] for a, b in zip(np.split(x, cuts), np.split(start, cuts))])
        assert np.allclose(got, want, equal_nan=True)


def test_engineer_over_chunks_equals_engineer(spark):
    df = spark.range(120).select(
        F.lit("M1").alias("machine_id"), F.timestamp_seconds(F.lit(1767225600) + 60 * F.col("id")).alias("timestamp"),
        F.when(F.col("id") % 7 != 3, 1300.0 + F.col("id") * 7 % 31).alias("rotational_speed_rpm"), (30.0 + F.col("id") % 5).alias("torque_nm"),
    )
    settings = dict(timestamp="timestamp", machine="machine_id", lags=(1,), windows=(3,), spans=(3,), periods=(1,), z_windows=(5,))
    frames = [FeatureEngineer(Settings(**settings, chunk_rows=size)).fit(df).transform(df).orderBy("timestamp") for size in (0, 25)]
    assert frames[0].columns == frames[1].columns
    for r, s in zip(*(f.collect() for f in frames)):
        assert all(v == w or math.isclose(v, w, rel_tol=1e-9) for v, w in zip(r, s))


def test_means_take_many_small_chunks_for_one(spark, monkeypatch):
    """Means of chunks of 32 rows were scanned chunk by chunk; whatever their chunks, they are those of one sequence."""
    df = spark.range(700).selectExpr("id AS i", "CAST(id % 3 AS STRING) AS machine", "IF(id % 5 = 0, NULL, CAST(hash(id) % 1000 AS DOUBLE)) AS x")
    past = lambda w: fam.lag("x", w, (1,))
    whole, _ = fam.with_history(df, "machine", "i", (), past, 1, ["x"], (2, 30), chunk_rows=0)
    expected, sizes, carried = whole.orderBy("i").collect(), [], sequence.carried_means
    monkeypatch.setattr(sequence, "carried_means", lambda chunks, *more: sizes.append(chunks.size) or carried(chunks, *more))
    for rows in (sequence.MEANS, 64, 1):
        monkeypatch.setattr(sequence, "MEANS", rows)
        got = fam.with_history(df, "machine", "i", (), past, 1, ["x"], (2, 30), chunk_rows=32)[0].orderBy("i").collect()
        for one, other in zip(expected, got, strict=True):
            assert [v if v is None else round(v, 9) for v in one[2:]] == [v if v is None else round(v, 9) for v in other[2:]]
    assert sizes == [4096, 64, 32]
