import pytest
from pyspark.sql import functions as F

from pulsefeat.sources.shared import shared_path
from pulsefeat.streaming import online, snapshots
from pulsefeat.streaming.machine import MachineState, OnlineSettings

SMALL = OnlineSettings(sensors=("rpm",), lags=(1,), windows=(3,), spans=(3,), history=8)
ROWS = "machine_id string, seq long, rpm double, action string"


def rows(spark, data):
    return spark.createDataFrame(data, ROWS).withColumn("timestamp", F.timestamp_seconds(10 * F.col("seq")))


def states(df):
    return {r.machine_key: MachineState.from_json(r.payload) for r in df.collect()}


def run(spark, batches, **more):
    """The batches through one stream, a micro-batch each; its rows and its checkpoint."""
    source, out, checkpoint = (shared_path(spark, x) for x in ("rows", "out", "state"))
    for batch in batches:
        df = rows(spark, batch)
        df.coalesce(1).write.mode("append").parquet(source)
        stream = online.stream(spark.readStream.schema(df.schema).parquet(source), SMALL, **more)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {(r.machine_key, r.seq): r for r in spark.read.parquet(out).collect()}, checkpoint


def test_control_rows(spark):
    first = [("a", i, float(i), None) for i in range(4)] + [("b", 0, 1.0, None), ("new", 0, None, "start")]
    second = [("a", 4, None, "RESET"), ("a", 5, 5.0, None), ("b", 1, None, "forget"), ("a", 6, 6.0, None), ("c", 2, 2.0, None)]
    got, checkpoint = run(spark, [first, second])
    assert set(got) == {("a", i) for i in (0, 1, 2, 3, 5, 6)} | {("b", 0), ("c", 2)}
    assert got["a", 5].rpm_lag_1 is None and got["a", 6].rpm_lag_1 == 5.0
    saved = online.saved_states(spark, checkpoint)
    assert {k: s.count for k, s in states(saved).items()} == {"a": 2, "c": 1, "new": 0}
    assert snapshots.has_machine(saved, " a ") and not snapshots.has_machine(saved, "b") and {r.machine_key for r in snapshots.machine_ids(saved).collect()} == {"a", "c", "new"}


def test_unknown_actions_are_errors(spark):
    with pytest.raises(Exception, match="unknown action"):
        run(spark, [[("a", 0, 1.0, "explode")]])


def test_idle_machines_expire(spark):
    """Ten seconds lie between two numbers of ``seq``: a gap of 30 is over the limit, one of 20 isn't."""
    got, checkpoint = run(spark, [[("a", 0, 1.0, None), ("b", 0, 1.0, None), ("a", 2, 2.0, None)], [("a", 5, 3.0, None), ("b", 2, 4.0, None)]], idle_seconds=20.0)
    assert got["a", 2].rpm_lag_1 == 1.0 and got["a", 5].rpm_lag_1 is None and got["b", 2].rpm_lag_1 == 1.0
    assert {k: s.count for k, s in states(online.saved_states(spark, checkpoint)).items()} == {"a": 1, "b": 2}


def test_snapshots_restore_merge_and_clone(spark):
    data = [("a", i, float(i), None) for i in range(10)] + [("b", i, float(-i), None) for i in range(3)] + [(None, 1, None, None)]
    before, after = online.states_after(rows(spark, data[:6]), SMALL), online.states_after(rows(spark, data), SMALL)
    path = shared_path(spark, "snapshot")
    snapshots.save(after, SMALL, path)
    restored, settings = snapshots.restore(spark, path, SMALL)
    assert settings == SMALL and states(restored) == states(after)
    with pytest.raises(ValueError):
        snapshots.restore(spark, path, OnlineSettings(sensors=("rpm",)))
    spark.read.parquet(path).withColumn("format", F.lit(99)).write.parquet(path + "-other")
    with pytest.raises(ValueError):
        snapshots.restore(spark, path + "-other")
    # The later state of a machine wins on both sides.
    assert states(snapshots.merged(before, after)) == states(snapshots.merged(after, before)) == states(after)
    copied = states(snapshots.cloned(restored, spark.createDataFrame([("a", "twin"), ("a", "b"), ("nobody", "x")], "source string, target string")))
    assert copied["twin"] == copied["b"] == copied["a"] and "x" not in copied
    # A restored engine goes on as the one that was saved.
    more = [("a", 10, 7.0, None), ("twin", 10, 7.0, None)]
    got, _ = run(spark, [more], warm=snapshots.cloned(restored, spark.createDataFrame([("a", "twin")], "source string, target string")))
    want = {(r.machine_key, r.seq): r for r in online.replay(rows(spark, data + more[:1]), SMALL).collect()}
    assert got["a", 10][2:] == want["a", 10][2:] == got["twin", 10][2:]


def test_resets_and_summaries(spark):
    data = [("a", i, float(i) if i % 2 else None, None) for i in range(10)] + [("b", 1, 4.0, None)]
    found = online.states_after(rows(spark, data), SMALL)
    assert {k: s.count for k, s in states(snapshots.reset(found, ["a", "nobody"])).items()} == {"a": 0, "b": 1}
    assert {s.count for s in states(snapshots.reset(found)).values()} == {0}
    assert set(states(snapshots.forgotten(found, idle_since=50.0))) == {"a"} and set(states(snapshots.forgotten(found, machines=["a"]))) == {"b"}
    one = {r.machine_key: r for r in snapshots.summaries(found).collect()}
    assert (one["a"].observations, one["a"].held, one["a"].oldest, one["a"].newest, one["a"].last) == (10, 8, 20.0, 90.0, 90.0)
    assert one["a"].values_held == {"rpm": 4} and one["a"].last_values == {"rpm": 9.0} and one["b"].means == 1
    assert tuple(snapshots.engine_summary(found).first()) == (2, 11, 8, 90.0)
    empty = snapshots.started(spark, ["x", "", "x"])
    assert set(states(empty)) == {"x", "__DEFAULT_MACHINE__"} and tuple(snapshots.engine_summary(empty).first()) == (2, 0, 0, None)
    assert tuple(snapshots.engine_summary(found.limit(0)).first()) == (0, 0, 0, None)
