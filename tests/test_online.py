import math
import random

import pytest
from pyspark.sql import functions as F

from pulsefeat.sources.shared import shared_path
from pulsefeat.streaming import online
from pulsefeat.streaming.machine import MachineState, OnlineSettings, history_features

SMALL = OnlineSettings(sensors=("rpm",), lags=(1, 2), windows=(3,), spans=(3,), history=16)


def test_four_observations():
    state, out = MachineState(), None
    for i, rpm in enumerate((1500.0, 1510.0, 1520.0, 1530.0)):
        out = state.observe(60.0 * i, {"rpm": rpm}, SMALL)
    assert out["rpm_lag_1"] == 1520 and out["rpm_rolling_3_mean"] == 1510 and math.isclose(out["rpm_rolling_3_std"], 10)
    assert math.isclose(out["rpm_rolling_3_zscore"], 2) and math.isclose(out["rpm_roc_1"], 10 / 60) and out["rpm_ewm_3"] == 1521.25 and state.count == 4


def test_gaps_late_rows_and_sliding_start():
    state = MachineState()
    assert state.observe(10.0, {"rpm": float("nan")}, SMALL)["rpm_ewm_3"] is None
    state.observe(20.0, {"rpm": 4.0}, SMALL)
    late = state.observe(5.0, {"rpm": 6.0}, SMALL)
    assert late["time_since_previous_observation_seconds"] == 0 and late["rpm_roc_1"] is None and state.last == 5.0
    for i in range(40):
        out = state.observe(100.0 + i, {"rpm": 1.0}, SMALL)
    assert len(state.times) == 16 and out["elapsed_time_since_machine_start_seconds"] == 16
    assert state.observe(1.0, {"rpm": 1.0}, OnlineSettings(**{**SMALL.__dict__, "late": "drop"})) is None


def test_saved_state_continues_as_if_never_saved():
    a = MachineState()
    for i in range(9):
        a.observe(float(i), {"rpm": float(i * i)}, SMALL)
    b = MachineState.from_json(a.to_json())
    assert a.observe(20.0, {"rpm": 3.0}, SMALL) == b.observe(20.0, {"rpm": 3.0}, SMALL)


def test_default_schema_has_194_names():
    assert len(online.expected_features(OnlineSettings())) == 194 and len(set(online.expected_features(OnlineSettings()))) == 194


def test_stream_equals_replay_and_warm_start(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(None if i % 5 == 0 else f" m{i % 3}", i, float(i % 7) if i % 4 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "machine_id string, seq long, rpm double").withColumn("timestamp", F.timestamp_seconds(F.lit(1767225600) + 10 * F.col("seq")))
    source, out, checkpoint = (shared_path(spark, x) for x in ("rows", "out", "state"))
    df.where("seq >= 50").write.parquet(source)
    warm = online.states_after(df.where("seq < 50"), SMALL)
    stream = online.stream(spark.readStream.schema(df.schema).parquet(source), SMALL, warm=warm)
    job = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    job.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, online.replay(df, SMALL).where("seq >= 50").collect()))
    saved = {r.machine_key: MachineState.from_json(r.payload) for r in online.saved_states(spark, checkpoint).collect()}
    want = {r.machine_key: MachineState.from_json(r.payload) for r in online.states_after(df, SMALL).collect()}
    assert saved == want and set(saved) == {"__DEFAULT_MACHINE__", "m0", "m1", "m2"}


def test_resets_and_numbers_that_are_no_times(spark):
    rows = [("a", i, float(i), i == 3, i) for i in range(5)]
    df = spark.createDataFrame(rows, "machine_id string, seq long, rpm double, reset boolean, timestamp long")
    got = online.replay(df, SMALL).orderBy("seq").collect()
    assert [r.rpm_lag_1 for r in got] == [None, 0.0, 1.0, None, 3.0] and all(r.time_since_previous_observation_seconds is None for r in got)
    assert MachineState.from_json(online.states_after(df, SMALL).first().payload).count == 2
    assert df.select(online.stateless(df)["time_hour"]).first()[0] is None


def test_window_columns_equal_replay_over_gaps(spark):
    rows = [("a", i, None if i % 3 == 0 else float(i * 7 % 11)) for i in range(30)]
    df = spark.createDataFrame(rows, "machine_id string, seq long, rpm double").withColumn("timestamp", F.timestamp_seconds(10 * F.col("seq")))
    from pulsefeat.operators.families import history

    columns = online.online_windows("rpm", history("machine_id", "seq"), SMALL)
    got = df.select("seq", *[c.alias(k) for k, c in columns.items()]).orderBy("seq").collect()
    want = online.replay(df, SMALL).orderBy("seq").select("seq", *columns).collect()
    for a, b in zip(got, want):
        assert all((x is None) == (y is None) and (x is None or math.isclose(x, y, abs_tol=1e-9)) for x, y in zip(a, b))


def test_issues(spark):
    df = spark.createDataFrame([("m", None, 1.0, 1)], "machine_id string, timestamp timestamp, rpm double, machine_failure int")
    assert df.select(online.observation_issues(df, SMALL)).first()[0] == ["missing timestamp", "label machine_failure is not used"]
    assert "time_since_previous_observation_seconds" in history_features(SMALL)


@pytest.mark.parametrize("late,size", [("accept", 16), ("accept", 23), ("drop", 16), ("drop", 40)])
def test_a_machine_over_many_chunks(spark, late, size):
    settings = OnlineSettings(**{**SMALL.__dict__, "late": late, "deltas_without_time": True})
    rng = random.Random(size)
    rows = [("hot", i, rng.choice([None, float(i + rng.randint(-3, 3)), float(i)]), rng.choice([None, float("inf"), *[float(i % 9)] * 8]), rng.random() < 0.01) for i in range(400)]
    rows += [(f"m{j}", i, float(i), float(j), False) for j in range(5) for i in range(7)] + [(None, i, 5.0, 1.0, i == 3) for i in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "machine_id string, seq long, at double, rpm double, reset boolean").withColumn("timestamp", F.timestamp_seconds("at")).repartition(3)
    whole = {(r.machine_key, r.seq): r for r in online.replay(df, settings, chunk_rows=0).collect()}
    cut = {(r.machine_key, r.seq): r for r in online.replay(df, settings, chunk_rows=size).collect()}
    assert set(whole) == set(cut) and (late == "accept") == (len(whole) == len(rows))
    for k, row in whole.items():
        for name, a, b in zip(row.__fields__, row, cut[k]):
            assert (a is None) == (b is None) and (a is None or a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (k, name, a, b)
    one = {r.machine_key: MachineState.from_json(r.payload) for r in online.states_after(df, settings, chunk_rows=0).collect()}
    many = {r.machine_key: MachineState.from_json(r.payload) for r in online.states_after(df, settings, chunk_rows=size).collect()}
    assert set(one) == set(many)
    for k, state in one.items():
        other = many[k]
        assert (state.times, state.values, state.count, state.last, set(state.means)) == (other.times, other.values, other.count, other.last, set(other.means)), k
        assert all(math.isclose(m, other.means[n], rel_tol=1e-9, abs_tol=1e-12) for n, m in state.means.items())
