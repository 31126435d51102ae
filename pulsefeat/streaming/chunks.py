"""Stored rows of online machines in order, long ones cut into chunks that tasks take up on their own.

A machine's state is a bounded history, exponential means, a count and a last time. The history at the
first row of a chunk is the halo of rows before it; the means are affine maps of what reaches the halo,
composed over chunks like count and last time. From there the halo's rows take the means on step by step,
so that the rounding of the composed maps has faded where the chunk's own rows begin (where values are missing
all through the halo, it may stay in the last digit). A reset row, or another machine, cuts all of it. Where late
rows are dropped, these go first: a row is late if an earlier one since the last reset has a later time, a
running maximum, which is carried from chunk to chunk by windows over a row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefeat.operators import sequence
from pulsefeat.operators.sequence import CARRY, OWN, PART, PLACE
from pulsefeat.streaming.machine import MachineState, OnlineSettings

LONGEST = 1 << 18
CHUNK = 1 << 14


def ordered(keyed: DataFrame, settings: OnlineSettings, chunk_rows: int | None) -> tuple[DataFrame, bool]:
    """Rows (machine_key, seq, at, reset, readings, ...) whose partitions hold whole machines in order, or
    whole chunks with halo and carry; and whether they are cut."""
    if chunk_rows is None:
        chunk_rows = CHUNK if sequence.longest_sequence(keyed.select("machine_key"), "machine_key") > LONGEST else 0
    if chunk_rows:
        return in_chunks(keyed, settings, max(chunk_rows, settings.history)), True
    # The number of partitions is given: rows are few bytes, but costly, and would be coalesced by their bytes.
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(tasks, "machine_key").sortWithinPartitions("machine_key", "seq"), False


def in_chunks(keyed: DataFrame, settings: OnlineSettings, size: int) -> DataFrame:
    order = [F.col("seq").asc_nulls_first()]
    rows = sequence.placed(keyed, "machine_key", order)
    if settings.late == "drop":
        rows = sequence.placed(without_late(rows, size).drop(PLACE), "machine_key", order)
    chunks = sequence.Chunks(rows, "machine_key", size)
    carries = carried_states(chunks, settings).withColumnsRenamed({PART: "__of", "machine_key": "__whose"})
    first = (F.col(PART) == F.col("__of")) & (F.col(PLACE) + settings.history == F.col(PART) * size) & (F.col("machine_key") == F.col("__whose"))
    joined = chunks.with_halo(settings.history).join(carries, first, "left").drop("__of", "__whose")
    return joined.repartition(PART).sortWithinPartitions(PART, PLACE)


def without_late(rows: DataFrame, size: int) -> DataFrame:
    """Rows but those before the latest time that their machine had since its last reset."""
    chunk = F.floor(F.col(PLACE) / size)
    inside = Window.partitionBy(PART, "machine_key")
    upto = inside.orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn(PART, chunk).withColumn("__stretch", F.sum(F.col("reset").cast("long")).over(upto))
    # Per chunk and machine: resets, and the latest time after the last of them.
    by_stretch = cut.groupBy(PART, "machine_key", "__stretch").agg(F.max("at").alias("top"))
    tails = by_stretch.groupBy(PART, "machine_key").agg(F.max("__stretch").alias("resets"), F.max_by("top", "__stretch").alias("top"))
    of_machine = Window.partitionBy("machine_key").orderBy(PART)
    tails = tails.withColumn("upto", F.sum("resets").over(of_machine))
    tails = tails.withColumn("top", F.max("top").over(Window.partitionBy("machine_key", "upto").orderBy(PART)))
    carried = tails.select(F.col(PART).alias("__of"), F.col("machine_key").alias("__whose"), F.lag("top").over(of_machine).alias("__top"))
    earlier = Window.partitionBy(PART, "machine_key", "__stretch").orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    joined = cut.join(carried.where("__top IS NOT NULL"), (F.col(PART) == F.col("__of")) & (F.col("machine_key") == F.col("__whose")), "left")
    before = F.greatest(F.max("at").over(earlier), F.when(F.col("__stretch") == 0, F.col("__top")))
    return joined.withColumn("__late", F.coalesce(F.col("at") < before, F.lit(False))).where("NOT __late").select(*rows.columns)


def carried_states(chunks: sequence.Chunks, settings: OnlineSettings) -> DataFrame:
    """``__chunk, machine_key, __carry``: count, last time (NaN: none), then per sensor and span the mean
    (NaN: none) that reach the first row of a chunk's halo if its machine is that of the row before."""
    sensors, alpha = settings.sensors, np.array([2 / (n + 1) for n in settings.spans])
    width = 1 + 2 * len(alpha)

    def tail(batch: pa.RecordBatch) -> tuple[bool, list[float]]:
        """What the rows since the chunk's last start make of a state, and whether all of them do."""
        resets = batch.column("reset").to_numpy(zero_copy_only=False)
        start = sequence.starts_of(batch, ["machine_key"], None) | resets
        lo = int(np.flatnonzero(start)[-1])
        times = batch.column("at").slice(lo).to_numpy(zero_copy_only=False)
        known = times[~np.isnan(times)]
        out = [float(batch.num_rows - lo), float(known[-1]) if len(known) else math.nan]
        for s in sensors:
            x = batch.column(s).slice(lo).to_numpy(zero_copy_only=False)
            x = x[np.isfinite(x)]
            if not len(x):
                out += [math.nan, *[1.0] * len(alpha), *[0.0] * len(alpha)]
                continue
            rest = x[1:]
            weights = np.power(1 - alpha[:, None], np.arange(len(rest) - 1, -1, -1))
            out += [float(x[0]), *np.power(1 - alpha, len(rest)), *((weights * rest).sum(axis=1) * alpha)]
        return lo == 0 and not resets[0], out

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sequence.chunk_tables(batches):
            batch = table.combine_chunks().to_batches()[0]
            whole, state = tail(batch)
            at = batch.num_rows - 1
            yield pa.RecordBatch.from_arrays([batch.column(PART).slice(at), batch.column("machine_key").slice(at), pa.array([whole]), pa.array([state], pa.list_(pa.float64()))], names=[PART, "machine_key", "whole", "state"])

    def composed(state: list[float] | None, given: list[float]) -> list[float]:
        count, last = (state[0], state[1]) if state else (0.0, math.nan)
        out = [count + given[0], last if math.isnan(given[1]) else given[1]]
        for i in range(len(sensors)):
            first, *rest = given[2 + i * width : 2 + (i + 1) * width]
            means = np.array(state[2 + i * len(alpha) : 2 + (i + 1) * len(alpha)]) if state else np.full(len(alpha), np.nan)
            if not math.isnan(first):
                begun = np.where(np.isnan(means), first, alpha * first + (1 - alpha) * means)
                means = np.array(rest[: len(alpha)]) * begun + np.array(rest[len(alpha) :])
            out += means.tolist()
        return out

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, state = None, -2, None
        for batch in batches:
            out = []
            for number, key, whole, given in zip(*(batch.column(c).to_pylist() for c in (PART, "machine_key", "whole", "state"))):
                state = composed(state if whole and key == current and number == at + 1 else None, given)
                current, at = key, number
                out.append(state)
            part = pa.array([n + 1 for n in batch.column(PART).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part, batch.column("machine_key"), pa.array(out, pa.list_(pa.float64()))], names=[PART, "machine_key", CARRY])

    upto_halo = F.floor((F.col(PLACE) + settings.history) / chunks.size)
    rows = chunks.rows.withColumn(PART, upto_halo).select(PART, PLACE, "machine_key", "at", "reset", *sensors)
    maps = rows.repartition(PART).sortWithinPartitions(PART, PLACE).mapInArrow(summaries, f"{PART} long, machine_key string, whole boolean, state array<double>")
    return maps.repartition("machine_key").sortWithinPartitions("machine_key", PART).mapInArrow(scan, f"{PART} long, machine_key string, {CARRY} array<double>")


class Follower:
    """Runs rows in order through the states of their machines, from batch to batch."""

    def __init__(self, settings: OnlineSettings, cut: bool):
        # Late rows of cut machines are gone already.
        self.settings = replace(settings, late="accept") if cut else settings
        self.cut = cut
        self.key: str | None = None
        self.part = 0
        self.fresh = True
        self.state = MachineState()

    def observed(self, batch: pa.RecordBatch, done: list | None = None) -> Iterator[tuple[int, str, int, dict]]:
        """(row, machine, seq, features) of every row that is no halo; states that end go to ``done``."""
        settings, sensors = self.settings, self.settings.sensors
        columns = [batch.column(c).to_pylist() for c in ("machine_key", "seq", "at", "reset", *sensors)]
        parts, own, carry = ([batch.column(c).to_pylist() for c in (PART, OWN, CARRY)]) if self.cut else (None, None, None)
        for i, (key, number, at, reset, *readings) in enumerate(zip(*columns)):
            part = parts[i] if parts else 0
            if key != self.key or reset or part != self.part:
                if done is not None and (key != self.key or part != self.part):
                    done += self.state_now()
                self.key, self.part, self.state, self.fresh = key, part, MachineState(), True
            if carry and carry[i] is not None and not reset:
                self.take_over(carry[i])
            if own and not own[i]:
                self.state.absorb(at, dict(zip(sensors, readings)), settings)
                continue
            self.fresh = False
            features = self.state.observe(at, dict(zip(sensors, readings)), settings)
            if features is not None:
                yield i, key, number, features

    def take_over(self, carry: list[float]) -> None:
        """What a halo doesn't tell of the state that reaches its first row."""
        self.state.count = int(carry[0])
        self.state.last = None if math.isnan(carry[1]) else carry[1]
        names = [f"{s}|{n}" for s in self.settings.sensors for n in self.settings.spans]
        self.state.means = {name: m for name, m in zip(names, carry[2:]) if not math.isnan(m)}

    def state_now(self) -> list[tuple[str, int, str]]:
        return [] if self.key is None or self.fresh else [(self.key, self.part, self.state.to_json())]
