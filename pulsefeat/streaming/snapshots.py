"""The states of an online engine as a table: looked at, reset, cloned, merged, saved and restored.

A table of states is ``machine_key, payload``, a row per machine, as ``online.states_after`` makes it from
stored rows and ``online.saved_states`` reads it from a running stream's checkpoint; ``online.stream`` and
``resumed`` start from one. So an engine is started with chosen machines, asked for its machines, emptied
or copied by plain joins and unions, whatever the number of machines.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefeat.functions.safe import machine_key
from pulsefeat.streaming.machine import VERSION, MachineState, OnlineSettings

PAYLOAD = "version INT, times ARRAY<DOUBLE>, values MAP<STRING, ARRAY<DOUBLE>>, means MAP<STRING, DOUBLE>, count BIGINT, last DOUBLE"
FORMAT = 1


def _read(payload: str = "payload") -> Column:
    return F.from_json(F.col(payload), PAYLOAD)


def started(spark: SparkSession, machines: Sequence[str]) -> DataFrame:
    """Empty states of the machines."""
    keys = spark.createDataFrame([(m,) for m in machines], "machine_key string").select(machine_key(F.col("machine_key")).alias("machine_key")).distinct()
    return keys.withColumn("payload", F.lit(MachineState().to_json()))


def machine_ids(states: DataFrame) -> DataFrame:
    return states.select("machine_key")


def has_machine(states: DataFrame, machine: str | None) -> bool:
    return not states.where(F.col("machine_key") == machine_key(F.lit(machine).cast("string"))).isEmpty()


def reset(states: DataFrame, machines: DataFrame | Sequence[str] | None = None) -> DataFrame:
    """The states with those of the machines (all of them, if none are named) emptied."""
    empty = F.lit(MachineState().to_json())
    if machines is None:
        return states.withColumn("payload", empty)
    if not isinstance(machines, DataFrame):
        machines = states.sparkSession.createDataFrame([(m,) for m in machines], "machine_key string")
    named = machines.select(machine_key(F.col(machines.columns[0])).alias("__key")).distinct().withColumn("__named", F.lit(True))
    joined = states.join(named, F.col("machine_key") == F.col("__key"), "left")
    return joined.select("machine_key", F.when(F.col("__named"), empty).otherwise(F.col("payload")).alias("payload"))


def forgotten(states: DataFrame, idle_since: float | None = None, machines: Sequence[str] = ()) -> DataFrame:
    """The states without those whose last time is before ``idle_since`` (seconds) and those named."""
    gone = F.lit(False)
    if idle_since is not None:
        gone = gone | F.coalesce(_read()["last"] < F.lit(float(idle_since)), F.lit(False))
    if machines:
        gone = gone | F.col("machine_key").isin([m if m is not None else "__DEFAULT_MACHINE__" for m in machines])
    return states.where(~gone)


def cloned(states: DataFrame, pairs: DataFrame) -> DataFrame:
    """The states, and for each row ``source, target`` of ``pairs`` the source's state under the target, in
    place of what the target had. A source without a state gives none; of several the first in order counts."""
    wanted = pairs.select(machine_key(F.col("source")).alias("source"), machine_key(F.col("target")).alias("target"))
    copies = wanted.join(states, F.col("source") == F.col("machine_key")).groupBy("target").agg(F.min_by("payload", "source").alias("payload")).withColumnRenamed("target", "machine_key")
    return states.join(copies.select("machine_key"), "machine_key", "left_anti").unionByName(copies)


def merged(states: DataFrame, others: DataFrame) -> DataFrame:
    """One table of two: of a machine in both, the state with the later last time, then of more observations,
    then the first table's."""
    both = states.select("machine_key", "payload", F.lit(1).alias("mine")).union(others.select("machine_key", "payload", F.lit(0)))
    order = F.struct(F.coalesce(_read()["last"], F.lit(float("-inf"))), _read()["count"], F.col("mine"))
    return both.groupBy("machine_key").agg(F.max_by("payload", order).alias("payload"))


def summaries(states: DataFrame) -> DataFrame:
    """Per machine: observations ever, held rows, times of the oldest and newest of these, last known time,
    and per sensor the number of held values and the newest one."""
    s = states.select("machine_key", _read().alias("s"))
    held = F.transform_values("s.values", lambda k, v: F.size(F.filter(v, lambda x: x.isNotNull())))
    newest = F.transform_values("s.values", lambda k, v: F.element_at(F.filter(v, lambda x: x.isNotNull()), -1))
    some = F.filter("s.times", lambda t: t.isNotNull())
    return s.select(
        "machine_key", F.col("s.count").alias("observations"), F.size("s.times").alias("held"), F.array_min(some).alias("oldest"), F.array_max(some).alias("newest"), F.col("s.last").alias("last"),
        held.alias("values_held"), F.map_filter(newest, lambda k, v: v.isNotNull()).alias("last_values"), F.size("s.means").alias("means"),
    )


def engine_summary(states: DataFrame) -> DataFrame:
    """One row: machines, observations, the largest history and the latest time."""
    s = summaries(states)
    return s.agg(F.count(F.lit(1)).alias("machines"), F.coalesce(F.sum("observations"), F.lit(0)).alias("observations"), F.coalesce(F.max("held"), F.lit(0)).alias("largest_history"), F.max("last").alias("last"))


def save(states: DataFrame, settings: OnlineSettings, path: str) -> None:
    """A snapshot of a whole engine: its states, with the format's version and the settings in every row."""
    kept = json.dumps(asdict(settings), sort_keys=True)
    states.select(F.lit(FORMAT).alias("format"), F.lit(VERSION).alias("version"), F.lit(kept).alias("settings"), "machine_key", "payload").write.mode("errorifexists").parquet(path)


def restore(spark: SparkSession, path: str, settings: OnlineSettings | None = None) -> tuple[DataFrame, OnlineSettings | None]:
    """States and settings of a snapshot; ValueError if its version is another, or if ``settings`` are
    given and differ. An empty snapshot has no settings of its own."""
    table = spark.read.parquet(path)
    kinds = table.select("format", "version", "settings").distinct().limit(2).collect()
    if len(kinds) > 1 or any((k.format, k.version) != (FORMAT, VERSION) for k in kinds):
        raise ValueError(f"{path} is no snapshot of version {FORMAT}.{VERSION}")
    own = OnlineSettings(**{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(kinds[0].settings).items()}) if kinds else settings
    if settings is not None and own != settings:
        raise ValueError("the snapshot was made with other settings")
    return table.select("machine_key", "payload"), own
