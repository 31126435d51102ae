"""Changes per second over short times: doubles of seconds since 1970 lose a part of a microsecond."""

from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsefeat.streaming import online
from pulsefeat.streaming.machine import MachineState, OnlineSettings

SMALL = OnlineSettings(sensors=("value",), lags=(1,), windows=(3,), spans=(3,), history=16)
STEPS = [3, 700_001, 1_234_567, 11, 40_000_003]  # microseconds


def rows_of(spark):
    at, rows = datetime(2024, 1, 1, 0, 0, 11, 172425), [("m", 0, datetime(2024, 1, 1, 0, 0, 11, 172425), 0.0)]
    for i, step in enumerate(STEPS):
        at += timedelta(microseconds=step)
        rows.append(("m", i + 1, at, 500.25 * (i + 1)))
    return spark.createDataFrame(rows, "machine_id string, seq long, timestamp timestamp, value double")


WANT = [None, *[500.25 / (step / 1e6) for step in STEPS]]


def test_window_columns_take_whole_microseconds(spark):
    w = Window.partitionBy("machine_id").orderBy("seq")
    got = rows_of(spark).select("seq", online.online_changes("value", w, SMALL)["value_roc_1"].alias("x")).orderBy("seq").collect()
    assert [r.x for r in got] == WANT


def test_states_take_whole_microseconds(spark):
    df = rows_of(spark)
    for chunk_rows in (0, 16):
        got = online.replay(df, SMALL, chunk_rows=chunk_rows).orderBy("seq").collect()
        assert [r.value_roc_1 for r in got] == WANT
        assert [r.time_since_previous_observation_seconds for r in got] == [None, *[step / 1e6 for step in STEPS]]
    state = MachineState.from_json(online.states_after(df.where("seq < 5"), SMALL).first().payload)
    last = df.where("seq = 5").select((F.unix_micros("timestamp") / F.lit(1e6)).alias("at"), "value").first()
    assert state.observe(last["at"], {"value": last["value"]}, SMALL)["value_roc_1"] == WANT[-1]


def test_microseconds_far_from_1970():
    from pulsefeat.streaming.machine import seconds_between

    for micros in (-8_500_000_000_000_003, -1, 4_102_444_800_000_001, 8_500_000_000_000_003):
        assert seconds_between((micros + 7) / 1e6, micros / 1e6) == 7e-6
    assert seconds_between(None, 1.0) is None and seconds_between(0.0, 1.5) == -1.5


def test_means_of_chunks_have_the_roundings_of_one_sequence(spark):
    """Hundredths halved again and again end in ties of the sixth decimal; composed maps alone fell on either side."""
    settings = OnlineSettings(sensors=("value",), lags=(1,), windows=(3,), spans=(3, 6, 12), history=128)
    value = F.when(F.col("id") % 11 != 5, (F.pmod(F.xxhash64("id"), F.lit(60_000)) / F.lit(100)))
    df = spark.range(6000).select(F.lit("m").alias("machine_id"), F.col("id").alias("seq"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("timestamp"), value.alias("value"), (F.col("id") == 3001).alias("reset"))
    names = [f"value_ewm_{n}" for n in settings.spans]
    one, cut, halo = (online.replay(df, settings, chunk_rows=n).orderBy("seq").select("seq", *names).collect() for n in (0, 128, 300))
    assert len(one) == 6000 and cut == one and halo == one
