"""Checks and profiles of loaded tables; every table-wide figure comes from one aggregate."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.functions.names import AI4I, SENSORS, TARGET, is_ai4i, machine_column
from pulsefeat.functions.safe import flag, numeric
from pulsefeat.operators.families import LOW_RPM, POWER_HIGH, POWER_LOW, SMALL_GAP, power_w

#: Plausible ranges of the sensors.
RANGES = {
    "air_temperature_k": (250.0, 350.0),
    "process_temperature_k": (250.0, 400.0),
    "rotational_speed_rpm": (0.0, 10000.0),
    "torque_nm": (0.0, 500.0),
    "tool_wear_min": (0.0, 1000.0),
}
#: Overstrain limits of wear times torque, by machine type.
OVERSTRAIN = {"L": 11000.0, "M": 12000.0, "H": 13000.0}


def long_form(row_of: DataFrame, columns: Sequence[str], measures: Sequence[str], name: str = "column_name") -> DataFrame:
    """One row with columns ``measure__i`` for column i, turned into a row per column."""
    entries = ", ".join("'{}', {}".format(c.replace("'", "\\'"), ", ".join(f"`{m}__{i}`" for m in measures)) for i, c in enumerate(columns))
    return row_of.selectExpr(f"stack({len(columns)}, {entries}) AS ({', '.join([name, *measures])})")


def convert_numeric(df: DataFrame, columns: Sequence[str], strict: bool = False) -> DataFrame:
    """Columns as finite doubles. ``strict`` raises if that loses a value."""
    if strict:
        lost = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & numeric(F.col(f"`{c}`")).isNull()).alias(c) for c in columns]).first().asDict()
        if bad := {c: n for c, n in lost.items() if n}:
            raise ValueError(f"values that are no numbers: {bad}")
    return df.withColumns({c: numeric(F.col(f"`{c}`")) for c in columns})


def convert_timestamp(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.col(f"`{column}`").try_cast("timestamp"))


def timestamp_column(df: DataFrame, least: float = 0.95) -> str | None:
    """The column named after time or date whose values parse best, if enough of them do. Numbers are
    never times, ids neither."""
    kinds = dict(df.dtypes)
    named = [c for c in df.columns if re.search("time|date", c.lower()) and c.lower() not in ("uid", "udi", "product_id", "product id") and (kinds[c] == "string" or kinds[c].startswith("timestamp") or kinds[c] == "date")]
    if not named:
        return None
    shares = df.agg(*[F.avg(F.col(f"`{c}`").try_cast("timestamp").isNotNull().cast("int")).alias(c) for c in named]).first().asDict()
    best = max(named, key=lambda c: shares[c] or 0.0)
    return best if (shares[best] or 0.0) >= least else None


def data_mode(df: DataFrame, mode: str = "auto") -> str:
    """ai4i, timeseries or generic; known machine tables count as cross-sections under auto."""
    if mode not in ("auto", "ai4i", "timeseries"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "ai4i" and not is_ai4i(df.columns):
        raise ValueError("not an AI4I table")
    if mode == "timeseries" and timestamp_column(df) is None:
        raise ValueError("no column of timestamps")
    if mode != "auto":
        return mode
    return "ai4i" if is_ai4i(df.columns) else "timeseries" if timestamp_column(df) and machine_column(df.columns) else "generic"


def schema_problems(df: DataFrame, target: str | None = None, ai4i: bool = False) -> list[str]:
    problems = []
    if df.isEmpty():
        problems.append("no rows")
    if len(df.columns) < 2:
        problems.append("fewer than two columns")
    if len(set(df.columns)) < len(df.columns):
        problems.append("column names repeat")
    if ai4i:
        problems += [f"missing column {c}" for c in AI4I if c not in df.columns]
    if target and target not in df.columns:
        problems.append(f"missing target {target}")
    elif target and df.select(target).na.drop().distinct().limit(2).count() < 2:
        problems.append("the target has fewer than two classes")
    return problems


def missing_summary(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing__{i}") for i, c in enumerate(df.columns)], *[F.count(F.lit(1)).alias(f"n_rows__{i}") for i in range(len(df.columns))])
    table = long_form(row, df.columns, ["missing", "n_rows"])
    return table.withColumn("missing_ratio", F.when(F.col("n_rows") > 0, F.col("missing") / F.col("n_rows"))).orderBy(F.desc("missing_ratio"), "column_name")


def duplicate_summary(df: DataFrame) -> DataFrame:
    """``duplicate_rows``: rows that have an equal; ``extra_copies``: rows beyond the first of each."""
    counts = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__n"))
    return counts.agg(F.coalesce(F.sum(F.when(F.col("__n") > 1, F.col("__n")).otherwise(0)), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("extra_copies"))


def range_diagnostics(df: DataFrame) -> DataFrame:
    columns = [c for c in SENSORS if c in df.columns]
    aggregates = []
    for i, c in enumerate(columns):
        lo, hi = RANGES[c]
        column = F.col(c)
        aggregates += [F.min(column).alias(f"observed_min__{i}"), F.max(column).alias(f"observed_max__{i}"), F.lit(lo).alias(f"allowed_min__{i}"), F.lit(hi).alias(f"allowed_max__{i}"), F.count_if((column < lo) | (column > hi)).alias(f"violations__{i}")]
    return long_form(df.agg(*aggregates), columns, ["observed_min", "observed_max", "allowed_min", "allowed_max", "violations"])


def binary_target_problems(df: DataFrame, target: str = TARGET) -> dict[str, int]:
    row = df.agg(F.count_if(F.col(target).isNull()).alias("missing"), F.count_if(~F.col(target).isin(0, 1)).alias("not_binary")).first()
    return row.asDict()


def target_histogram(df: DataFrame, target: str = TARGET) -> DataFrame:
    return df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n_rows")).orderBy("target")


def profile(df: DataFrame, target: str = TARGET) -> DataFrame:
    """One row: rows, columns by kind, missing cells, rows that repeat, positive rate."""
    kinds = [k for _, k in df.dtypes]
    n_numeric = sum(k in ("double", "float", "int", "bigint", "smallint", "tinyint") or k.startswith("decimal") for k in kinds)
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns), F.lit(0))
    basics = df.agg(F.count(F.lit(1)).alias("n_rows"), missing.cast("long").alias("missing_cells"), F.avg(F.col(target).cast("double")).alias("positive_rate"))
    return basics.crossJoin(F.broadcast(duplicate_summary(df))).select("n_rows", F.lit(len(kinds)).alias("n_columns"), F.lit(n_numeric).alias("numeric_columns"), F.lit(len(kinds) - n_numeric).alias("other_columns"), "missing_cells", "duplicate_rows", "extra_copies", "positive_rate")


def failure_logic(df: DataFrame) -> DataFrame:
    """Flags of heat dissipation, power, tool wear and overstrain failures from the sensor readings."""
    gap = F.col("process_temperature_k") - F.col("air_temperature_k")
    limit = F.coalesce(*[F.when(F.upper("type") == k, F.lit(v)) for k, v in OVERSTRAIN.items()])
    return df.withColumns(
        {
            "logic_hdf": flag((gap < SMALL_GAP) & (F.col("rotational_speed_rpm") < LOW_RPM)),
            "logic_pwf": flag((power_w() < POWER_LOW) | (power_w() > POWER_HIGH)),
            "logic_twf": flag(F.col("tool_wear_min").between(200, 240)),
            "logic_osf": flag(F.col("tool_wear_min") * F.col("torque_nm") > limit),
        }
    )


def failure_logic_summary(df: DataFrame) -> DataFrame:
    """Per rule: rows it marks, and, where the table has the label, rows marked by both."""
    marked = failure_logic(df)
    rules = ["hdf", "pwf", "twf", "osf"]
    aggregates = []
    for i, r in enumerate(rules):
        label = F.col(r) == 1 if r in df.columns else F.lit(False)
        aggregates += [F.sum(f"logic_{r}").alias(f"marked__{i}"), F.count_if((F.col(f"logic_{r}") == 1) & label).alias(f"labelled__{i}")]
    return long_form(marked.agg(*aggregates), rules, ["marked", "labelled"], "rule")


def chronological(df: DataFrame, machine: str | None, timestamp: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    keys = [F.col(c).asc_nulls_last() for c in (machine, timestamp, *tiebreak) if c]
    return df.orderBy(*keys)
