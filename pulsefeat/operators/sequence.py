"""Long sequences in chunks, and exponential means as a scan.

A machine's rows are a sequence. Up to LONGEST rows it is evaluated by one task. Longer ones, and tables
that are one sequence, are cut: rows are range-partitioned by machine and time and written with their
place in that order; CHUNK neighbouring places are a chunk, which also gets the ``halo`` of rows before it
that bounded frames look at. Windows then run over (chunk, machine), and the halo is dropped, so one hot
machine keeps every task busy and gives the rows that one window would give.

Exponential means have no bounded frame, but a step is an affine map of the mean so far, y -> a y + b. Maps
compose, so a batch of rows is scanned in log2(rows) vector steps, whatever machines and gaps it holds, and
a chunk's rows are one map: the maps of a machine's chunks are composed in order, a row per chunk, and every
chunk starts from the mean that reaches it. A chunk costs some calls of NumPy, so means take as many neighbouring
chunks as give MEANS rows for one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pulsefeat.sources.shared import written

LONGEST = 1 << 20
CHUNK = 1 << 15
MEANS = 1 << 12  # rows of a chunk for exponential means, or more
PLACE, PART, OWN, CARRY = "__place", "__chunk", "__own", "__carry"
ROW_BITS = 33  # of monotonically_increasing_id, below the partition number


def longest_sequence(df: DataFrame, machine: str | None) -> int:
    """Rows of the longest sequence, from an aggregate per machine."""
    if machine is None:
        return df.count()
    return df.groupBy(machine).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def placed(df: DataFrame, machine: str | None, order: Sequence[Column]) -> DataFrame:
    """``df``, written in (machine, order), with ``__place``: the row's number in it, from 0. What comes to
    the driver is a row count per partition of the exchange."""
    spark = df.sparkSession
    keys = [*([F.col(machine).asc_nulls_first()] if machine else []), *order]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Rows of equal sort keys go to one partition; the hash keeps their order the same in every run.
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(PLACE, F.monotonically_increasing_id())
    table = written(ranged, "sequence")
    part = F.shiftright(PLACE, ROW_BITS).cast("int")
    counts = sorted(table.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for number, n in counts:
        starts.append((number, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(starts, "__part int, __start long"))  # a row per partition
    own = F.col(PLACE).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return table.join(offsets, part == F.col("__part")).withColumn(PLACE, F.col("__start") + own).drop("__part", "__start")


@dataclass(frozen=True)
class Chunks:
    """A table in chunks: ``rows`` has every column of the table and ``__place``."""

    rows: DataFrame
    machine: str | None
    size: int = CHUNK

    def number(self) -> Column:
        return F.floor(F.col(PLACE) / self.size)

    def with_halo(self, halo: int) -> DataFrame:
        """Rows with ``__chunk`` and ``__own``; the last ``halo`` rows of a chunk are also in the next one."""
        if halo > self.size:
            raise ValueError(f"a halo of {halo} rows is longer than a chunk of {self.size}")
        again = F.col(PLACE) % self.size >= self.size - halo
        chunks = F.when(again, F.array(self.number(), self.number() + 1)).otherwise(F.array(self.number()))
        return self.rows.withColumn(PART, F.explode(chunks)).withColumn(OWN, F.col(PART) == self.number())

    def window(self) -> WindowSpec:
        return Window.partitionBy(PART, *([self.machine] if self.machine else [])).orderBy(PLACE)


def starts_of(batch: pa.RecordBatch, keys: Sequence[str], before: list | None) -> np.ndarray:
    """Which rows begin a new sequence, nulls being a key like others; ``before``: the keys of the last
    row of the batch before, None if there is none."""
    start = np.zeros(batch.num_rows, dtype=bool)
    start[0] = before is None or before != [batch.column(k)[0].as_py() for k in keys]
    for k in keys:
        c = batch.column(k)
        codes = pc.fill_null(c.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        start[1:] |= codes[1:] != codes[:-1]
    return start


class MeanScan:
    """Exponential means of one sensor at several spans, continued from batch to batch. Weights decay at
    gaps too: a value after g rows weighs alpha against (1 - alpha) ** g of the mean so far."""

    def __init__(self, spans: Sequence[int]):
        self.alpha = np.array([2 / (n + 1) for n in spans])
        self.mean: np.ndarray | None = None  # after the last row; None before the first value
        self.age = 0  # rows since the last value

    def maps(self, x: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The map (a, b) from the mean before the batch to that after each row, composed; what is left of
        the old weight at each value, where a mean exists within the batch, and each row's last value."""
        n, at = len(x), np.arange(len(x))
        has = ~np.isnan(x)
        last = np.maximum.accumulate(np.where(has, at, -1))
        began = np.maximum.accumulate(np.where(start, at, -1))
        before = np.concatenate([[-1], last[:-1]])
        inside = (before >= began) & (before >= 0)
        carried = ~inside & (began < 0) & (self.mean is not None)
        gap = np.where(inside, at - before, at + self.age)[:, None]
        old = np.where((inside | carried)[:, None], np.power(1 - self.alpha, np.maximum(gap, 1)), 0.0)
        a = np.where(has[:, None], old / (old + self.alpha), 1.0)
        b = np.where(has[:, None], (1 - a) * np.where(has, x, 0.0)[:, None], 0.0)
        a[start & ~has] = 0.0
        step = 1
        while step < n:
            b[step:] += a[step:] * b[:-step]
            a[step:] = a[step:] * a[:-step]
            step *= 2
        return a, b, old, last >= np.maximum(began, 0), last

    def stepped(self, x: np.ndarray, old: np.ndarray, after: np.ndarray) -> np.ndarray:
        """``after`` with the roundings of one step after the other: steps are taken everywhere at once until
        nothing changes, and they shrink any difference, so that this takes few rounds."""
        has, value = ~np.isnan(x)[:, None], np.nan_to_num(x)[:, None]
        first = np.zeros((1, len(self.alpha))) if self.mean is None else self.mean[None, :]
        for _ in range(len(x)):
            prior = np.concatenate([first, after[:-1]])
            following = np.where(has, np.where(old > 0, (old * prior + self.alpha * value) / (old + self.alpha), value), prior)
            if np.array_equal(following, after):
                break
            after = following
        return after

    def means_before(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """For each row and span, the mean of the sequence's rows before it; NaN where there is none."""
        n = len(x)
        a, b, old, exists, last = self.maps(x, start)
        after = self.stepped(x, old, b if self.mean is None else a * self.mean + b)
        if self.mean is not None:
            exists = exists | (np.maximum.accumulate(start) == 0)
        after = np.where(exists[:, None], after, np.nan)
        first = np.full((1, len(self.alpha)), np.nan) if self.mean is None else self.mean[None, :]
        out = np.concatenate([first, after[:-1]])
        out[start] = np.nan
        begun = np.flatnonzero(start)
        lately = last[-1] >= (begun[-1] if len(begun) else 0)
        self.age = int(n - last[-1]) if lately else self.age + n
        if len(begun) or lately:
            self.mean = after[-1] if exists[-1] else None
        return out


def ewm_names(sensors: Sequence[str], spans: Sequence[int]) -> list[str]:
    return [f"__ewm_{s}_{n}" for s in sensors for n in spans]


def scanned_means(df: DataFrame, keys: Sequence[str], sensors: Sequence[str], spans: Sequence[int], carry: bool = False) -> DataFrame:
    """``df``, whose partitions hold whole sequences in order, with the mean before each row per sensor and
    span. ``carry``: a column ``__carry`` has, on the first row of a chunk, age and means to start from."""
    names = ewm_names(sensors, spans)
    kept = [f for f in df.schema.fields if f.name != CARRY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scans, before = [MeanScan(spans) for _ in sensors], None
        for batch in batches:
            if not batch.num_rows:
                continue
            start = starts_of(batch, keys, before)
            before = [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            given = pc.is_valid(batch.column(CARRY)).to_numpy(zero_copy_only=False).nonzero()[0].tolist() if carry else []
            values = [batch.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False) for s in sensors]
            # A carry continues a sequence at a chunk's first row: the batch is scanned in stretches.
            edges = [0, *[g for g in given if g], batch.num_rows]
            parts: list[list[np.ndarray]] = [[] for _ in sensors]
            for lo, hi in zip(edges[:-1], edges[1:]):
                begins = start[lo:hi].copy()
                if lo in given:
                    state = batch.column(CARRY)[lo].as_py()
                    begins[0] = False
                    for i, scan in enumerate(scans):
                        age, *mean = state[i * (len(spans) + 1) : (i + 1) * (len(spans) + 1)]
                        scan.age, scan.mean = int(age), None if age == 0 else np.array(mean)
                for part, scan, x in zip(parts, scans, values):
                    part.append(scan.means_before(x[lo:hi], begins))
            made = [pa.array(c, from_pandas=True) for part in parts for c in np.concatenate(part).T]
            columns = [batch.column(f.name) for f in kept]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*[f.name for f in kept], *names])

    return df.mapInArrow(run, StructType([*kept, *[StructField(n, DoubleType()) for n in names]]))


def chunk_maps(chunks: Chunks, sensors: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """``__chunk, machine, whole, maps``: what each chunk's last sequence does to the mean that reaches it,
    per sensor: rows, index of its first value and that value, index of its last value, then per span the
    map of the values after the first. ``whole``: the chunk holds this sequence only."""
    machine = chunks.machine
    keys = [PART, *([machine] if machine else [])]

    def summary(table: pa.Table, x: list[np.ndarray], start: np.ndarray) -> tuple[bool, list[float]]:
        lo = int(np.flatnonzero(start)[-1])
        out: list[float] = []
        for values in x:
            own = values[lo:]
            at = np.flatnonzero(~np.isnan(own))
            if not len(at):
                out += [float(len(own)), -1.0, 0.0, -1.0, *[0.0] * (2 * len(spans))]
                continue
            scan = MeanScan(spans)
            if lo:  # the sequence begins here: its mean is known
                scan.means_before(own, start[lo:])
                out += [float(len(own)), float(at[0]), float(own[at[0]]), float(at[-1]), *[0.0] * len(spans), *scan.mean]
                continue
            scan.mean, scan.age = np.zeros(len(spans)), 1  # the first value has just been taken
            rest = own[at[0] + 1 :]
            a, b = scan.maps(rest, np.zeros(len(rest), dtype=bool))[:2] if len(rest) else (np.ones((1, len(spans))), np.zeros((1, len(spans))))
            out += [float(len(own)), float(at[0]), float(own[at[0]]), float(at[-1]), *a[-1], *b[-1]]
        return lo == 0, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in chunk_tables(batches):
            batch = table.combine_chunks().to_batches()[0]
            x = [batch.column(s).cast(pa.float64()).to_numpy(zero_copy_only=False) for s in sensors]
            whole, maps = summary(table, x, starts_of(batch, keys, None))
            key = [batch.column(k).slice(batch.num_rows - 1, 1) for k in keys]
            yield pa.RecordBatch.from_arrays([*key, pa.array([whole]), pa.array([maps], pa.list_(pa.float64()))], names=[*keys, "whole", "maps"])

    rows = chunks.rows.withColumn(PART, chunks.number()).select(*keys, PLACE, *[F.col(f"`{s}`").cast("double").alias(s) for s in sensors])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", whole boolean, maps array<double>"
    return rows.repartition(PART).sortWithinPartitions(PART, PLACE).mapInArrow(run, schema)


def chunk_tables(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.Table]:
    """Whole chunks, which are bounded, from batches in order of ``__chunk``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        numbers = batch.column(PART).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(PART)[0].as_py() != numbers[lo]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def carried_means(chunks: Chunks, sensors: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """``__chunk, machine, __carry``: age and means that reach a chunk's first row, where its machine is
    that of the chunk before. The maps of a machine's chunks are composed in order, a row per chunk."""
    maps, machine, alpha = chunk_maps(chunks, sensors, spans), chunks.machine, np.array([2 / (n + 1) for n in spans])
    width = 4 + 2 * len(spans)

    def composed(state: list[tuple[int, np.ndarray | None]] | None, given: list[float]) -> list[tuple[int, np.ndarray | None]]:
        out = []
        for i in range(len(sensors)):
            rows, first, value, last, *rest = given[i * width : (i + 1) * width]
            age, mean = state[i] if state else (0, None)
            if first < 0:
                out.append((int(age + rows) if mean is not None else 0, mean))
                continue
            old = np.power(1 - alpha, age + first) if mean is not None else np.zeros(len(spans))
            y = (old * mean + alpha * value) / (old + alpha) if mean is not None else np.full(len(spans), value)
            out.append((int(rows - last), np.array(rest[: len(spans)]) * y + np.array(rest[len(spans) :])))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, chunk, state = None, -2, None
        for batch in batches:
            keys = batch.column(machine).to_pylist() if machine else [None] * batch.num_rows
            out = []
            for key, number, whole, given in zip(keys, *(batch.column(c).to_pylist() for c in (PART, "whole", "maps"))):
                state = composed(state if whole and key == current and number == chunk + 1 else None, given)
                current, chunk = key, number
                out.append([v for age, mean in state for v in (float(age if mean is not None else 0), *(mean if mean is not None else [0.0] * len(spans)))])
            part = pc.add(batch.column(PART), 1)
            yield pa.RecordBatch.from_arrays([part, *([batch.column(machine)] if machine else []), pa.array(out, pa.list_(pa.float64()))], names=[PART, *([machine] if machine else []), CARRY])

    kinds = {f.name: f.dataType.simpleString() for f in maps.schema.fields}
    schema = f"{PART} {kinds[PART]}, " + (f"`{machine}` {kinds[machine]}, " if machine else "") + f"{CARRY} array<double>"
    by_machine = maps.repartition(machine).sortWithinPartitions(machine, PART) if machine else maps.repartition(1).sortWithinPartitions(PART)
    return by_machine.mapInArrow(run, schema)


def means_in_chunks(df: DataFrame, chunks: Chunks, sensors: Sequence[str], spans: Sequence[int]) -> DataFrame:
    """``df``: rows of ``chunks`` with halos and maybe more columns; returns own rows with the means."""
    machine, size = chunks.machine, chunks.size * -(-MEANS // chunks.size)
    chunks = Chunks(chunks.rows, machine, size)
    carries = carried_means(chunks, sensors, spans).withColumnRenamed(PART, "__of")
    on = (F.col(PART) == F.col("__of")) & (F.col(PLACE) % size == 0)
    if machine:
        carries = carries.withColumnRenamed(machine, "__whose")
        on &= F.col(machine).eqNullSafe(F.col("__whose"))
    joined = df.where(OWN).withColumn(PART, chunks.number()).join(carries, on, "left").drop("__of", "__whose")
    ordered = joined.repartition(PART).sortWithinPartitions(PART, PLACE)
    return scanned_means(ordered, [PART, *([machine] if machine else [])], sensors, spans, carry=True)


def evaluated(df: DataFrame, machine: str | None, order: Sequence[Column], halo: int, make: Callable[[WindowSpec], list[Column]], sensors: Sequence[str] = (), spans: Sequence[int] = (), size: int = CHUNK) -> DataFrame:
    """``df`` with the columns that ``make`` builds over a window, whose frames reach back ``halo`` rows at
    most, and the means of ``sensors``; in chunks of ``size`` rows."""
    size = max(size, halo)
    chunks = Chunks(placed(df, machine, order), machine, size)
    out = chunks.with_halo(halo).select("*", *make(chunks.window()))
    out = means_in_chunks(out, chunks, sensors, spans) if sensors and spans else out.where(OWN)
    return out.drop(PLACE, PART, OWN)
