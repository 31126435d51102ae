"""The online engine on Spark.

``replay`` runs stored rows through machine states; ``stream`` does the same in Structured Streaming,
with the state in the state store; both share ``MachineState``. Features of single observations are
plain columns (``stateless``) and stay in code generation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from pulsefeat.functions.names import LABELS
from pulsefeat.functions.safe import clamped_log1p, finite, flag, machine_key, safe_ratio, safe_sqrt
from pulsefeat.streaming import chunks
from pulsefeat.streaming.machine import MachineState, OnlineSettings, history_features

NOMINAL_POWER = 2860.0


def observed_at(df: DataFrame, timestamp: str) -> Column:
    """The time of an observation: texts are read, numbers are never times."""
    kind = dict(df.dtypes).get(timestamp, "")
    if kind == "string" or kind == "date" or kind.startswith("timestamp"):
        return F.col(timestamp).try_cast("timestamp")
    return F.lit(None).cast("timestamp")


def stateless(df: DataFrame, timestamp: str = "timestamp") -> dict[str, Column]:
    """Time, physical and interaction features of an observation; NULL where an input is missing."""
    out: dict[str, Column] = {}
    if timestamp in df.columns:
        t = observed_at(df, timestamp)
        out |= {
            "time_hour": F.hour(t), "time_minute": F.minute(t), "time_day_of_week": F.weekday(t), "time_day_of_month": F.dayofmonth(t), "time_day_of_year": F.dayofyear(t),
            "time_month": F.month(t), "time_quarter": F.quarter(t), "time_week_of_year": F.weekofyear(t), "time_is_weekend": F.when(t.isNotNull(), flag(F.weekday(t) >= 5)),
        }
    if {"air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"} <= set(df.columns):
        air, process, rpm, torque, wear = (finite(F.col(c)) for c in ("air_temperature_k", "process_temperature_k", "rotational_speed_rpm", "torque_nm", "tool_wear_min"))
        gap, power = process - air, torque * rpm * F.lit(2 * math.pi / 60)
        out |= {
            "temperature_gap_k": gap, "temperature_ratio": safe_ratio(process, air), "torque_speed_interaction": torque * rpm,
            "rotational_speed_rad_per_s": rpm * F.lit(2 * math.pi / 60), "mechanical_power_w": power, "mechanical_power_kw": power / 1000,
            "mechanical_power_to_nominal_ratio": power / NOMINAL_POWER, "torque_per_rpm": safe_ratio(torque, rpm), "rpm_per_torque": safe_ratio(rpm, torque),
            "tool_wear_squared": wear * wear, "tool_wear_sqrt": safe_sqrt(wear), "tool_wear_log1p": clamped_log1p(wear),
            "tool_wear_fraction_of_240_min": wear / 240, "rotational_speed_k_rpm": rpm / 1000, "torque_k_nm": torque / 10,
            "temperature_gap_x_torque": gap * torque, "temperature_gap_x_speed": gap * rpm, "temperature_gap_x_tool_wear": gap * wear,
            "mechanical_power_x_tool_wear": power * wear, "torque_x_tool_wear": torque * wear, "speed_x_tool_wear": rpm * wear,
        }
    return out


def expected_features(settings: OnlineSettings) -> list[str]:
    """All names of the online schema: id, time, sensors, then the rest in order of name."""
    single = [
        "time_hour", "time_minute", "time_day_of_week", "time_day_of_month", "time_day_of_year", "time_month", "time_quarter", "time_week_of_year", "time_is_weekend",
        "temperature_gap_k", "temperature_ratio", "torque_speed_interaction", "rotational_speed_rad_per_s", "mechanical_power_w", "mechanical_power_kw", "mechanical_power_to_nominal_ratio",
        "torque_per_rpm", "rpm_per_torque", "tool_wear_squared", "tool_wear_sqrt", "tool_wear_log1p", "tool_wear_fraction_of_240_min", "rotational_speed_k_rpm", "torque_k_nm",
        "temperature_gap_x_torque", "temperature_gap_x_speed", "temperature_gap_x_tool_wear", "mechanical_power_x_tool_wear", "torque_x_tool_wear", "speed_x_tool_wear",
    ]
    missing = [f"{s}_missing" for s in settings.sensors]
    return ["machine_id", "timestamp", *settings.sensors, *sorted([*single, *missing, *history_features(settings)])]


def _keyed(df: DataFrame, settings: OnlineSettings, machine: str, timestamp: str, seq: str, carry: Sequence[Column] = ()) -> DataFrame:
    """Key, order, time and readings; a true ``reset`` in a row clears its machine's state before it."""
    at = F.unix_micros(observed_at(df, timestamp)) / F.lit(1e6)
    readings = [(F.col(s).cast("double") if s in df.columns else F.lit(None).cast("double")).alias(s) for s in settings.sensors]
    reset = F.coalesce(F.col("reset").cast("boolean"), F.lit(False)) if "reset" in df.columns else F.lit(False)
    if "action" in df.columns:
        carry = [*carry, F.lower(F.col("action").cast("string")).alias("action")]
    return df.select(machine_key(F.col(machine) if machine in df.columns else F.lit(None)).alias("machine_key"), F.col(seq).cast("long").alias("seq"), at.alias("at"), reset.alias("reset"), *readings, *carry)


def _schema(settings: OnlineSettings) -> StructType:
    return StructType([StructField("machine_key", StringType()), StructField("seq", LongType()), *[StructField(n, DoubleType()) for n in history_features(settings)]])


def replay(df: DataFrame, settings: OnlineSettings, machine: str = "machine_id", timestamp: str = "timestamp", seq: str = "seq", carry: Column | None = None, chunk_rows: int | None = None) -> DataFrame:
    """History features of stored rows, in order of ``seq`` per machine. Rows stream through a task
    sorted; only the current machine's bounded state is held, however long its history. Machines of more
    than ``chunks.LONGEST`` rows are cut (see ``chunks``); ``chunk_rows`` asks for chunks of so many rows, 0
    for none. A struct ``carry`` goes along with each row, as the last column."""
    keyed = _keyed(df, settings, machine, timestamp, seq, [] if carry is None else [carry.alias("carry")])
    rows, cut = chunks.ordered(keyed, settings, chunk_rows)
    schema = _schema(settings)
    if carry is not None:
        schema = StructType([*schema.fields, keyed.schema["carry"]])
    names, carried = history_features(settings), carry is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower = chunks.Follower(settings, cut)
        for batch in batches:
            out, kept = [], []
            for i, key, number, features in follower.observed(batch):
                out.append((key, number, *[features[n] for n in names]))
                kept.append(i)
            columns = list(zip(*out)) or [()] * (2 + len(names))
            made = [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[2:]]]
            if carried:
                made.append(batch.column("carry").take(pa.array(kept, pa.int64())))
            yield pa.RecordBatch.from_arrays(made, names=["machine_key", "seq", *names, *(["carry"] if carried else [])])

    return rows.mapInArrow(run, schema)


def update_rows(df: DataFrame, settings: OnlineSettings, machine: str = "machine_id", timestamp: str = "timestamp", seq: str = "seq", medians: dict[str, float] | None = None) -> DataFrame:
    """Whole rows of the online schema, in its order, after ``seq``: id, time, readings, features of the
    observation, marks of missing readings and features of the history. ``medians`` asks for imputation:
    missing numbers become the median of their name, 0 where there is none."""
    single = stateless(df, timestamp)
    marks = {f"{s}_missing": (finite(F.col(s).cast("double")).isNull() if s in df.columns else F.lit(True)).cast("double") for s in settings.sensors}
    readings = {s: finite(F.col(s).cast("double")) if s in df.columns else F.lit(None).cast("double") for s in settings.sensors}
    carry = F.struct(observed_at(df, timestamp).alias("timestamp"), *[c.alias(n) for n, c in (readings | single | marks).items()])
    rows = replay(df, settings, machine, timestamp, seq, carry).select("machine_key", "seq", "carry.*", *history_features(settings))
    names = [n for n in expected_features(settings) if n != "machine_id"]
    rows = rows.select("seq", F.col("machine_key").alias("machine_id"), *[F.col(n) if n in rows.columns else F.lit(None).cast("double").alias(n) for n in names])
    return rows if medians is None else imputed(rows, [n for n in names if n != "timestamp"], medians)


class MachineProcessor(StatefulProcessor):
    """The state of one machine in the state store, as versioned JSON. If given, an observation more than
    ``idle_seconds`` after the last one, both by their own times, finds an expired state and begins anew. Rows with an ``action`` are no observations: ``start`` makes an empty state, ``reset``
    empties it, ``forget`` removes it; an unknown action is an error."""

    def __init__(self, settings: OnlineSettings, idle_seconds: float | None = None):
        self.settings, self.idle_seconds = settings, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machine", StructType([StructField("payload", StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine: MachineState | None = MachineState.from_json(self.state.get()[0]) if self.state.exists() else None
        names = history_features(self.settings)
        out = []
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        for values in batch.to_dict("records"):
            action = values.get("action")
            if isinstance(action, str) and action:
                if action not in ACTIONS:
                    raise ValueError(f"unknown action {action!r}; there are {', '.join(ACTIONS)}")
                machine = None if action == "forget" else MachineState() if action == "reset" or machine is None else machine
                continue
            at = None if pd.isna(values["at"]) else float(values["at"])
            if values["reset"] or machine is None or self.expired(machine, at):
                machine = MachineState()
            reading = {s: None if pd.isna(values[s]) else float(values[s]) for s in self.settings.sensors}
            features = machine.observe(at, reading, self.settings)
            if features is not None:
                out.append([key[0], values["seq"], *[features[n] for n in names]])
        if machine is not None:
            self.state.update((machine.to_json(),))
        elif self.state.exists():
            self.state.clear()
        frame = pd.DataFrame(out, columns=["machine_key", "seq", *names])
        yield frame.astype({n: "float64" for n in names})

    def expired(self, machine: MachineState, at: float | None) -> bool:
        return self.idle_seconds is not None and at is not None and machine.last is not None and at - machine.last > self.idle_seconds

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.state.update((initialState["payload"].iloc[0],))

    def close(self) -> None:
        pass


ACTIONS = ("start", "reset", "forget")


def stream(
    df: DataFrame, settings: OnlineSettings, machine: str = "machine_id", timestamp: str = "timestamp", seq: str = "seq", warm: DataFrame | None = None, idle_seconds: float | None = None
) -> DataFrame:
    """History features of a streaming DataFrame. ``warm``: ``machine_key, payload`` of saved states; more
    than ``idle_seconds`` after its last observation a machine begins anew. A column ``action`` has control rows."""
    keyed = _keyed(df, settings, machine, timestamp, seq).groupBy("machine_key")
    return keyed.transformWithStateInPandas(
        statefulProcessor=MachineProcessor(settings, idle_seconds), outputStructType=_schema(settings), outputMode="append",
        timeMode="None", initialState=warm.groupBy("machine_key") if warm is not None else None,
    )


def saved_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``machine_key, payload`` of the states in a stream's checkpoint, for export or a warm start."""
    store = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "machine").load()
    return store.select(F.col("key.machine_key").alias("machine_key"), F.col("value.payload").alias("payload"))


def states_after(df: DataFrame, settings: OnlineSettings, machine: str = "machine_id", timestamp: str = "timestamp", seq: str = "seq", chunk_rows: int | None = None) -> DataFrame:
    """``machine_key, payload``: the states that stored rows lead to (a warm start without output)."""
    rows, cut = chunks.ordered(_keyed(df, settings, machine, timestamp, seq), settings, chunk_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        follower = chunks.Follower(settings, cut)
        for batch in batches:
            done: list[tuple[str, int, str]] = []
            for _ in follower.observed(batch, done):
                pass
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in done], pa.string()), pa.array([c for _, c, _ in done], pa.int64()), pa.array([p for _, _, p in done], pa.string())], names=["machine_key", "at", "payload"])
        last = follower.state_now()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in last], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))], names=["machine_key", "at", "payload"])

    found = rows.mapInArrow(run, "machine_key string, at long, payload string")
    return found.groupBy("machine_key").agg(F.max_by("payload", "at").alias("payload"))  # a row per machine, or per machine and chunk


def imputed(df: DataFrame, names: Sequence[str], medians: dict[str, float] | None = None) -> DataFrame:
    """Missing numbers become the training median, or 0 where there is none."""
    return df.fillna({n: (medians or {}).get(n, 0.0) for n in names})


def observation_issues(df: DataFrame, settings: OnlineSettings, machine: str = "machine_id", timestamp: str = "timestamp") -> Column:
    """An array of texts: what is missing from an observation, and labels that it should not carry."""
    checks = [F.when(F.col(machine).isNull(), "missing machine id") if machine in df.columns else F.lit("missing machine id")]
    checks.append(F.when(F.col(timestamp).isNull(), "missing timestamp") if timestamp in df.columns else F.lit("missing timestamp"))
    checks += [F.when(finite(F.col(s).cast("double")).isNull(), f"missing {s}") if s in df.columns else F.lit(f"missing {s}") for s in settings.sensors]
    checks += [F.when(F.col(c).isNotNull(), f"label {c} is not used") for c in LABELS if c in df.columns]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


# --- the same history features as window columns ------------------------------------------------


def past_values(s: str, w: WindowSpec, settings: OnlineSettings, size: int) -> Column:
    """The last ``size`` finite values of the bounded history before the row."""
    held = F.collect_list(finite(F.col(s).cast("double"))).over(w.rowsBetween(-settings.history, -1))
    return F.slice(held, F.greatest(F.size(held) - size + 1, F.lit(1)), size)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return total / F.nullif(F.size(values), F.lit(0))


def _deviation(values: Column, mean: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(F.size(values) > 1, F.sqrt(squares / F.nullif(F.size(values) - 1, F.lit(0))))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it occurs there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _moments(values: Column, x: Column, settings: OnlineSettings) -> Column:
    """``mean, std, zscore`` by an array. A column that is merely repeated is computed again for every element
    of a lambda and in every branch, so all that depends on mean and deviation is inside."""

    def parts(v: Column, mean: Column, std: Column) -> Column:
        enough = F.size(v) >= settings.least_values
        z = F.when((F.size(v) >= settings.least_for_z) & (std > settings.epsilon), (x - mean) / std)
        return F.struct(F.when(enough, mean).alias("mean"), F.when(enough, std).alias("std"), z.alias("zscore"))

    return _bound(values, lambda v: _bound(_mean(v), lambda m: _bound(_deviation(v, m), lambda d: parts(v, m, d))))


def _extremes(values: Column, settings: OnlineSettings) -> Column:
    """``min, max, median`` by an array, sorted once."""

    def parts(o: Column) -> Column:
        enough = F.size(o) >= settings.least_values
        middle = (F.get(o, F.floor((F.size(o) - 1) / 2).cast("int")) + F.get(o, F.floor(F.size(o) / 2).cast("int"))) / 2
        return F.struct(F.when(enough, F.get(o, F.lit(0))).alias("min"), F.when(enough, F.get(o, F.size(o) - 1)).alias("max"), F.when(enough, middle).alias("median"))

    return _bound(F.sort_array(values), parts)


def online_windows(s: str, w: WindowSpec, settings: OnlineSettings) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for n in settings.windows:
        values = past_values(s, w, settings, n)
        moments, extremes = _moments(values, F.col(s), settings), _extremes(values, settings)
        parts = {k: moments[k] for k in ("mean", "std")} | {k: extremes[k] for k in ("min", "max", "median")} | {"zscore": moments["zscore"], "anomaly_score": F.abs(moments["zscore"])}
        out |= {f"{s}_rolling_{n}_{k}": c for k, c in parts.items()}
    return out


def online_changes(s: str, w: WindowSpec, settings: OnlineSettings, timestamp: str = "timestamp") -> dict[str, Column]:
    out: dict[str, Column] = {}
    micros = F.unix_micros(F.col(timestamp).cast("timestamp"))
    for k in settings.lags:
        seconds = (micros - F.lag(micros, k).over(w)) / F.lit(1e6)
        out[f"{s}_roc_{k}"] = F.when(seconds > 0, (F.col(s) - F.lag(s, k).over(w)) / seconds)
    return out
