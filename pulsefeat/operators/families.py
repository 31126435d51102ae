"""Feature families as lists of ``Feature``: a name, its lineage and a Spark column.

Everything but exponential means is a column, so a stage of any number of families is one ``select``; all
history features share one window specification and thus one exchange and one sort per machine.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from pulsefeat.functions.names import FAILURE_MODES, SENSORS, TARGET, feature_name
from pulsefeat.functions.safe import finite, flag, null_count, safe_divide, safe_log1p, safe_sqrt, seconds_between
from pulsefeat.operators import sequence

LAGS = (1, 2, 3, 5, 10)
WINDOWS = (3, 5, 10, 20)
STATISTICS = ("mean", "std", "min", "max", "median")
SPANS = (3, 5, 10)
PERIODS = (1, 3, 5)
Z_WINDOWS = (5, 10, 20)
Z_LIMIT = 3.0
#: Physical limits of the operating rules.
TOP_WEAR = "__top_wear"
LOW_RPM, SMALL_GAP, HIGH_WEAR, CRITICAL_WEAR, POWER_LOW, POWER_HIGH = 1380.0, 8.6, 200.0, 240.0, 3500.0, 9000.0
RAD_PER_S = 2 * math.pi / 60

AIR, PROCESS, RPM, TORQUE, WEAR = SENSORS


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    sources: tuple[str, ...]
    operation: str
    column: Column
    causal: bool = True
    leakage_safe: bool = True
    description: str = ""


def _feature(group: str, source: str, operation: str, column: Column, sources: Sequence[str], **more) -> Feature:
    return Feature(feature_name(group, source, operation), group, tuple(sources), operation, column, **more)


def _has(df: DataFrame, *columns: str) -> bool:
    return set(columns) <= set(df.columns)


def add(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    return df.select("*", *[f.column.alias(f.name) for f in features])


def metadata(spark, features: Sequence[Feature]) -> DataFrame:
    rows = [(f.name, f.group, ",".join(f.sources), f.operation, f.causal, f.leakage_safe, f.description) for f in features]
    return spark.createDataFrame(rows, "feature string, feature_group string, sources string, operation string, causal boolean, leakage_safe boolean, description string")


# --- families of single rows -------------------------------------------------------------------


def missingness(df: DataFrame, exclude: Sequence[str] = ()) -> list[Feature]:
    skip = {TARGET, *FAILURE_MODES, *exclude}
    columns = [c for c, kind in df.dtypes if c not in skip and (kind in ("double", "float", "int", "bigint", "smallint", "tinyint", "string") or kind.startswith("decimal"))]
    out = [_feature("missingness", c, "", F.col(f"`{c}`").isNull().cast("int"), [c]) for c in columns]
    sensors = [c for c in SENSORS if c in df.columns]
    if sensors:
        out.append(_feature("missingness", "sensor_missing_count", "", null_count(sensors), sensors))
    return out


def calendar(ts: str) -> list[Feature]:
    t = F.col(ts)
    parts = {
        "hour": F.hour(t), "day_of_week": F.weekday(t), "day_of_month": F.dayofmonth(t), "day_of_year": F.dayofyear(t),
        "week_of_year": F.weekofyear(t), "month": F.month(t), "quarter": F.quarter(t),
    }
    flags = {
        "is_weekend": F.weekday(t) >= 5,
        "is_month_start": F.dayofmonth(t) == 1,
        "is_month_end": F.to_date(t) == F.last_day(t),
        "is_quarter_start": (F.dayofmonth(t) == 1) & (F.month(t) % 3 == 1),
        "is_quarter_end": (F.to_date(t) == F.last_day(t)) & (F.month(t) % 3 == 0),
    }
    out = [_feature("time", k, "", c.cast("double"), [ts]) for k, c in parts.items()]
    return out + [_feature("time", k, "", flag(c), [ts]) for k, c in flags.items()]


def cyclical(ts: str) -> list[Feature]:
    t, out = F.col(ts), []
    for k, c, period in (("hour", F.hour(t), 24), ("day_of_week", F.weekday(t), 7), ("month", F.month(t), 12)):
        angle = c * F.lit(2 * math.pi / period)
        out += [_feature("time", f"{k}_sin", "", F.sin(angle), [ts]), _feature("time", f"{k}_cos", "", F.cos(angle), [ts])]
    return out


def elapsed(df: DataFrame, ts: str, machine: str | None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Adds ``time__elapsed_seconds`` since the first row in (machine, time) order; the one first row
    is found by an aggregate and joined as a single broadcast row."""
    order = [F.col(ts).isNull(), F.col(ts), *[F.col(c) for c in tiebreak]]
    if machine:
        order = [F.col(machine).isNull(), F.col(machine), *order]
    first = df.agg(F.min_by(F.col(ts), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("__first"))
    return df.crossJoin(F.broadcast(first)).withColumn("time__elapsed_seconds", seconds_between(F.col(ts), F.col("__first"))).drop("__first")


def power_w() -> Column:
    return F.col(TORQUE) * F.col(RPM) * F.lit(RAD_PER_S)


def physical(df: DataFrame) -> list[Feature]:
    out = []
    if _has(df, AIR, PROCESS):
        out.append(_feature("physical", "temperature_gap_k", "", F.col(PROCESS) - F.col(AIR), [PROCESS, AIR]))
    if _has(df, TORQUE, RPM):
        both = [TORQUE, RPM]
        out += [
            _feature("physical", "mechanical_power_w", "", power_w(), both),
            _feature("physical", "mechanical_power_kw", "", power_w() / 1000, both),
            _feature("physical", "torque_speed_interaction", "", F.col(TORQUE) * F.col(RPM), both),
            _feature("physical", "torque_per_rpm", "", safe_divide(F.col(TORQUE), F.col(RPM)), both),
        ]
    if _has(df, RPM):
        out.append(_feature("physical", "angular_velocity_rad_s", "", F.col(RPM) * F.lit(RAD_PER_S), [RPM]))
    return out


def with_top_wear(df: DataFrame) -> DataFrame:
    """``df`` with the batch's largest tool wear in every row, from an aggregate of one row."""
    return df.crossJoin(F.broadcast(df.agg(F.max(WEAR).alias(TOP_WEAR)))) if _has(df, WEAR) else df


def tool_wear(df: DataFrame, fitted_max: float | None = None) -> list[Feature]:
    """With ``fitted_max`` the normalised wear uses the training maximum; without it the maximum of
    the batch (``with_top_wear``), which looks at later rows and is marked as not causal."""
    if not _has(df, WEAR):
        return []
    w = F.col(WEAR)
    top = F.lit(fitted_max) if fitted_max is not None else F.col(TOP_WEAR)
    return [
        _feature("tool_wear", "square", "", w * w, [WEAR]),
        _feature("tool_wear", "sqrt", "", safe_sqrt(w), [WEAR]),
        _feature("tool_wear", "log1p", "", safe_log1p(w), [WEAR]),
        _feature("tool_wear", "cumulative_normalized", "", w / F.greatest(top, F.lit(1.0)), [WEAR], causal=fitted_max is not None),
        _feature("tool_wear", "distance_to_200_min", "", F.lit(HIGH_WEAR) - w, [WEAR]),
    ]


def differences(df: DataFrame) -> list[Feature]:
    return [_feature("difference", "process_minus_air_temperature", "", F.col(PROCESS) - F.col(AIR), [PROCESS, AIR])] if _has(df, AIR, PROCESS) else []


def ratios(df: DataFrame) -> list[Feature]:
    out = []
    if _has(df, AIR, PROCESS):
        out.append(_feature("ratio", "process_to_air_temperature_ratio", "", safe_divide(F.col(PROCESS), F.col(AIR)), [PROCESS, AIR]))
    if _has(df, TORQUE, RPM):
        out.append(_feature("ratio", "torque_to_speed_ratio", "", safe_divide(F.col(TORQUE), F.col(RPM)), [TORQUE, RPM]))
    return out


def interactions(df: DataFrame) -> list[Feature]:
    pairs = [("process_temperature_x_tool_wear", PROCESS, WEAR), ("torque_x_tool_wear", TORQUE, WEAR), ("rpm_x_tool_wear", RPM, WEAR)]
    out = [_feature("interaction", name, "", F.col(a) * F.col(b), [a, b]) for name, a, b in pairs if _has(df, a, b)]
    if _has(df, PROCESS, AIR, TORQUE):
        out.append(_feature("interaction", "temperature_gap_x_torque", "", (F.col(PROCESS) - F.col(AIR)) * F.col(TORQUE), [PROCESS, AIR, TORQUE]))
    return out


def operating(df: DataFrame) -> list[Feature]:
    rules = []
    if _has(df, RPM):
        rules.append(("low_rpm_flag", F.col(RPM) < LOW_RPM, [RPM]))
    if _has(df, AIR, PROCESS):
        rules.append(("small_temperature_gap_flag", F.col(PROCESS) - F.col(AIR) < SMALL_GAP, [PROCESS, AIR]))
    if _has(df, WEAR):
        rules += [("high_tool_wear_flag", F.col(WEAR) >= HIGH_WEAR, [WEAR]), ("critical_tool_wear_window_flag", F.col(WEAR).between(HIGH_WEAR, CRITICAL_WEAR), [WEAR])]
    if _has(df, TORQUE, RPM):
        rules.append(("power_outside_range_flag", (power_w() < POWER_LOW) | (power_w() > POWER_HIGH), [TORQUE, RPM]))
    return [_feature("operating_condition", name, "", flag(rule), sources) for name, rule, sources in rules]


def global_zscores(means: dict[str, float], deviations: dict[str, float]) -> list[Feature]:
    """Distances from the training means in training deviations; not among the defaults. Give it to
    ``FeatureEngineer(extra=...)`` with what another fit has learned."""
    return [_feature("global", c, "zscore", safe_divide(F.col(c) - F.lit(m), F.lit(deviations[c])), [c]) for c, m in means.items() if c in SENSORS]


# --- families of a machine's history -----------------------------------------------------------


def sequence_order(ts: str, tiebreak: Sequence[str] = ()) -> list[Column]:
    return [F.col(ts).asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in tiebreak]]


def history(machine: str | None, ts: str, tiebreak: Sequence[str] = ()) -> WindowSpec:
    """A machine's rows in time order; null machine ids form one machine. The columns stay with the
    specification as ``sequence``. ``with_history`` cuts sequences that are too long for one task."""
    order = sequence_order(ts, tiebreak)
    spec = (Window.partitionBy(machine) if machine else Window.partitionBy(F.lit(0))).orderBy(*order)
    spec.sequence = (machine, order)
    return spec


def with_history(
    df: DataFrame, machine: str | None, ts: str, tiebreak: Sequence[str], make: Callable[[WindowSpec], list[Feature]], reach: int,
    sensors: Sequence[str] = (), spans: Sequence[int] = (), chunk_rows: int | None = None,
) -> tuple[DataFrame, list[Feature]]:
    """``df`` with the features that ``make`` builds over a window, whose frames reach back ``reach`` rows
    at most, and exponential means of ``sensors``. Sequences of more than ``sequence.LONGEST`` rows, and
    tables without a machine, are evaluated in chunks of ``sequence.CHUNK`` rows; ``chunk_rows`` asks for
    chunks of so many rows, 0 for none. Only what is cut is written to the shared folder first."""
    order = sequence_order(ts, tiebreak)
    made: list[Feature] = make(history(machine, ts, tiebreak))
    if chunk_rows is None:
        chunk_rows = sequence.CHUNK if not machine or sequence.longest_sequence(df, machine) > sequence.LONGEST else 0
    means = [_feature("ewm", s, f"span_{n}", F.col(f"__ewm_{s}_{n}"), [s]) for s in sensors for n in spans]
    if chunk_rows:
        out = sequence.evaluated(df, machine, order, reach, lambda w: [f.column.alias(f.name) for f in make(w)], sensors, spans, chunk_rows)
    else:
        out = add(df, made)
        if means:
            out, _ = ewm(out, sensors, history(machine, ts, tiebreak), spans)
    return add(out, means).drop(*sequence.ewm_names(sensors, spans)), made + means


def lag(s: str, w: WindowSpec, lags: Sequence[int] = LAGS) -> list[Feature]:
    return [_feature("lag", s, f"lag_{k}", F.lag(s, k).over(w), [s]) for k in lags]


def median_of(values: Column) -> Column:
    """Of an array without nulls: the middle element, or the mean of the two."""
    ordered, n = F.array_sort(values), F.size(values)
    middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
    return F.when(n > 0, middle)


def window_statistic(s: str, w: WindowSpec, size: int, statistic: str) -> Column:
    """Over the ``size`` rows before the current one; the deviation divides by the count."""
    frame = w.rowsBetween(-size, -1)
    if statistic == "median":
        return median_of(F.collect_list(s).over(frame))
    return {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}[statistic](s).over(frame)


def rolling(s: str, w: WindowSpec, windows: Sequence[int] = WINDOWS, statistics: Sequence[str] = STATISTICS) -> list[Feature]:
    return [_feature("rolling", s, f"{k}_{n}", window_statistic(s, w, n, k), [s]) for n in windows for k in statistics]


def ewm(df: DataFrame, sensors: Sequence[str], w: WindowSpec, spans: Sequence[int] = SPANS) -> tuple[DataFrame, list[Feature]]:
    """Exponentially weighted means of earlier rows: weights decay at nulls too, the mean stays. ``w`` is a
    specification of ``history``; windows over it that are already in ``df`` share its exchange."""
    machine, order = w.sequence
    rows = df.repartition(machine) if machine else df.repartition(1)
    rows = rows.sortWithinPartitions(*([machine] if machine else []), *order)
    out = sequence.scanned_means(rows, [machine] if machine else [], sensors, spans)
    return out, [_feature("ewm", s, f"span_{n}", F.col(f"__ewm_{s}_{n}"), [s]) for s in sensors for n in spans]


def rate_of_change(s: str, w: WindowSpec, periods: Sequence[int] = PERIODS) -> list[Feature]:
    out = []
    for k in periods:
        before = F.lag(s, k).over(w)
        out += [
            _feature("rate_of_change", s, f"absolute_change_{k}", F.col(s) - before, [s]),
            _feature("rate_of_change", s, f"pct_change_{k}", safe_divide(F.col(s) - before, F.abs(before)), [s]),
        ]
    return out


def anomaly(s: str, w: WindowSpec, windows: Sequence[int] = Z_WINDOWS, limit: float = Z_LIMIT) -> list[Feature]:
    out = []
    for n in windows:
        mean, std = window_statistic(s, w, n, "mean"), window_statistic(s, w, n, "std")
        z = safe_divide(F.col(s) - mean, std)
        columns = {"historical_mean": mean, "historical_std": std, "zscore": z, "flag": flag(F.abs(z) >= limit)}
        out += [_feature("anomaly", s, f"{k}_{n}", c, [s]) for k, c in columns.items()]
    return out


def cleaned(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Infinities and NaN of the double features become NULL."""
    names = {f.name for f in features}
    return df.select(*[finite(F.col(f"`{c}`")).alias(c) if c in names and k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])
