"""A table in (machine, time) order, with its diagnostics, from one exchange.

Rows are range-partitioned by machine and time, sorted within partitions and written with a row number that
grows in that order. Equal rows are neighbours then, and so are rows of equal machine and time: one pass
over the keys, without another exchange, counts them. A task hands on a summary per stretch of rows that it
read; the stretches, a few per file, are put together in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.sources.shared import written

STRETCH = "first_row long, last_row long, rows long, untimed long, machines long, same_key long, same_row long, gap double, least double, most double, first_machine string, first_at double, first_hash long, last_machine string, last_at double, last_hash long"


@dataclass(frozen=True)
class Diagnostics:
    """What the order tells of a table."""

    rows: int
    machines: int
    untimed: int  # rows without a time
    repeated_keys: int  # rows of a machine and time that an earlier row has
    repeated_rows: int  # rows equal to an earlier one
    longest_gap_seconds: float | None  # between neighbours of one machine
    first_time: datetime | None
    last_time: datetime | None


def _summary(frame) -> list:
    """Of neighbouring rows (row, machine, at, hash)."""
    machine, at, hashes = frame["machine"].to_numpy(dtype=object), frame["at"].to_numpy(dtype=float), frame["hash"].to_numpy()
    machine = np.array(["\0" if m is None else m for m in machine], dtype=object)
    same = machine[1:] == machine[:-1]
    steps = at[1:] - at[:-1]
    key = same & ((steps == 0) | (np.isnan(at[1:]) & np.isnan(at[:-1])))
    gaps = steps[same & ~np.isnan(steps)]
    known = at[~np.isnan(at)]
    ends = [[None if machine[i] == "\0" else machine[i], None if np.isnan(at[i]) else float(at[i]), int(hashes[i])] for i in (0, -1)]
    number = lambda x, f: float(f(x)) if len(x) else None
    return [
        int(frame["row"].iloc[0]), int(frame["row"].iloc[-1]), len(frame), int(np.isnan(at).sum()), int((~same).sum()) + 1, int(key.sum()), int((key & (hashes[1:] == hashes[:-1])).sum()),
        number(gaps, np.max), number(known, np.min), number(known, np.max), *ends[0], *ends[1],
    ]


def ordered(df: DataFrame, machine: str | None, timestamp: str, row: str | None = None) -> tuple[DataFrame, Diagnostics]:
    """The table in files that are ranges of machine, then time, nulls last, sorted within each, and what
    the order tells of it. Spark reads files in no order of theirs: a column named by ``row`` grows in it."""
    columns = df.columns
    keys = [*([F.col(f"`{machine}`").asc_nulls_last()] if machine else []), F.col(f"`{timestamp}`").asc_nulls_last()]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("__hash", F.xxhash64(*[F.col(f"`{c}`") for c in columns])).repartitionByRange(parts, *keys)
    table = written(ranged.sortWithinPartitions(*keys, "__hash").withColumn("__row", F.monotonically_increasing_id()), "ordered")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        held, out = None, []
        for batch in batches:
            frame = batch.to_pandas()
            for _, part in frame.groupby(((frame["row"].diff() != 1) & (frame.index > 0)).cumsum(), sort=False):
                if held is not None and int(part["row"].iloc[0]) != held[1] + 1:
                    out.append(held)
                    held = None
                held = _summary(part) if held is None else _joined(held, _summary(part))
        if held is not None:
            out.append(held)
        names = [f.split(" ")[0] for f in STRETCH.split(", ")]
        made = pd.DataFrame(out, columns=names)
        kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
        yield pa.RecordBatch.from_arrays([pa.array(made[n].tolist(), kinds[f.split(" ")[1]], from_pandas=True) for n, f in zip(names, STRETCH.split(", "))], names=names)

    at = (F.unix_micros(F.col(f"`{timestamp}`").cast("timestamp")) / F.lit(1e6)).alias("at")
    keyed = table.select(F.col("__row").alias("row"), (F.col(f"`{machine}`").cast("string") if machine else F.lit("")).alias("machine"), at, F.col("__hash").alias("hash"))
    stretches = sorted(list(r) for r in keyed.mapInArrow(run, STRETCH).collect())  # a few per file
    found = None
    for stretch in stretches:
        found = stretch if found is None else _joined(found, stretch)
    result = table.select(*[f"`{c}`" for c in columns], *([F.col("__row").alias(row)] if row else []))
    if found is None:
        return result, Diagnostics(0, 0, 0, 0, 0, None, None, None)
    _, _, rows, untimed, machines, same_key, same_row, gap, least, most, *_ = found
    time = lambda x: None if x is None else datetime.fromtimestamp(x)
    return result, Diagnostics(rows, machines, untimed, same_key, same_row, gap, time(least), time(most))


def _joined(a: list, b: list) -> list:
    """The summary of two stretches, the second following the first."""
    (machine, at, hash_), (next_machine, next_at, next_hash) = a[13:16], b[10:13]
    same = machine == next_machine
    key = same and at == next_at
    gap = next_at - at if same and at is not None and next_at is not None else None
    least, most = [x for x in (a[8], b[8]) if x is not None], [x for x in (a[9], b[9]) if x is not None]
    return [
        a[0], b[1], a[2] + b[2], a[3] + b[3], a[4] + b[4] - same, a[5] + b[5] + key, a[6] + b[6] + (key and hash_ == next_hash),
        max((x for x in (a[7], b[7], gap) if x is not None), default=None), min(least, default=None), max(most, default=None), *a[10:13], *b[13:16],
    ]
