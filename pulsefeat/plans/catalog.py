"""The queries over the driver's tables, by name, and the SQL that gives the same rows.

Doubles are rounded to six decimals on both sides, as engines add up in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefeat.functions import names
from pulsefeat.functions.names import SENSORS
from pulsefeat.operators import families as fam
from pulsefeat.operators import plots, quality, split, validation
from pulsefeat.operators.order import exact_quantiles
from pulsefeat.operators.engineer import FeatureEngineer, Settings, constant_columns, duplicate_columns, engineer, group_counts
from pulsefeat.sources import loading, ordering
from pulsefeat.sources.shared import shared_path
from pulsefeat.sources.tables import normalized
from pulsefeat.sources.views import AI4I_SQL, GAP_SQL, machines, machines_with_gaps, telemetry
from pulsefeat.streaming import online, snapshots
from pulsefeat.streaming.machine import OnlineSettings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

M = f"WITH m AS ({AI4I_SQL}) "
G = f"WITH g AS ({GAP_SQL}) "
SPLIT = M + ", s AS (SELECT *, row_number() OVER (PARTITION BY machine_failure ORDER BY md5(uid || '42'), uid) AS place, count(*) OVER (PARTITION BY machine_failure) AS n FROM m), p AS (SELECT *, CASE WHEN place <= floor(n * 70 / 100) THEN 'train' WHEN place <= floor(n * 85 / 100) THEN 'validation' ELSE 'test' END AS split FROM s) "
RAD = "0.10471975511965977::DOUBLE"
POWER = f"(torque_nm * rotational_speed_rpm * {RAD})"
ONLINE = OnlineSettings(sensors=("value",))


def half_up(sql: str) -> str:
    """``round(x, 6)`` spelled out as in ``r6``: engines' own roundings part at halves."""
    out, at = [], 0
    while (start := sql.find("round(", at)) >= 0:
        depth, i = 1, start + 6
        while depth:
            depth += (sql[i] == "(") - (sql[i] == ")")
            i += 1
        inner = sql[start + 6 : i - 1].removesuffix(", 6")
        out += [sql[at:start], f"(floor(({half_up(inner)}) * 1e6 + 0.5) / 1e6)"]
        at = i
    return "".join([*out, sql[at:]])


def query(oracle: str | None = None):
    """Register a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = half_up(oracle)
        return f

    return register


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[(F.floor(F.col(f"`{c}`") * 1e6 + 0.5) / 1e6).alias(c) if k in ("double", "float") else F.col(f"`{c}`") for c, k in df.dtypes])


def of(features: list[fam.Feature], keys: list[str]) -> list:
    return [F.col(k) for k in keys] + [f.column.alias(f.name) for f in features]


def sql_round(*items: str) -> str:
    return ", ".join("round({}, 6) AS {}".format(*i.rsplit(" AS ", 1)) for i in items)


E_WINDOW = " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


def e_frames(*sizes: int) -> str:
    return E_WINDOW + "".join(f", f{n} AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in sizes)


def events_window():
    return fam.history("machine_id", "timestamp", ["seq"])


# --- history families ---------------------------------------------------------------------------


@query(
    "SELECT event_id, user_id, lag(value, 1) OVER w AS lag_1, round(avg(value) OVER f5, 6) AS mean_5, round(stddev_pop(value) OVER f5, 6) AS std_5, "
    "round(CASE WHEN stddev_pop(value) OVER f5 >= 1e-8 THEN (value - avg(value) OVER f5) / stddev_pop(value) OVER f5 END, 6) AS zscore_5, "
    "CASE WHEN stddev_pop(value) OVER f5 >= 1e-8 AND abs((value - avg(value) OVER f5) / stddev_pop(value) OVER f5) >= 3 THEN 1 ELSE 0 END AS flag_5" + e_frames(5)
)
def telemetry_flagship(spark, sf_dir):
    w = events_window()
    parts = {f.name.split("__")[-1]: f.column for f in fam.anomaly("value", w, (5,))}
    lag_1 = fam.lag("value", w, (1,))[0].column
    return r6(telemetry(spark, sf_dir).select(F.col("seq").alias("event_id"), F.col("machine_id").alias("user_id"), lag_1.alias("lag_1"), parts["historical_mean_5"].alias("mean_5"), parts["historical_std_5"].alias("std_5"), parts["zscore_5"].alias("zscore_5"), parts["flag_5"].alias("flag_5")))


@query("SELECT event_id AS seq, " + ", ".join(f"lag(value, {k}) OVER w AS lag__value__lag_{k}" for k in fam.LAGS) + E_WINDOW)
def lag_family(spark, sf_dir):
    return telemetry(spark, sf_dir).select(*of(fam.lag("value", events_window()), ["seq"]))


@query("SELECT event_id AS seq, " + sql_round(*[f"{f}(value) OVER f{n} AS rolling__value__{k}_{n}" for n in fam.WINDOWS for k, f in (("mean", "avg"), ("std", "stddev_pop"))]) + e_frames(*fam.WINDOWS))
def rolling_mean_std(spark, sf_dir):
    return r6(telemetry(spark, sf_dir).select(*of(fam.rolling("value", events_window(), statistics=("mean", "std")), ["seq"])))


@query("SELECT event_id AS seq, " + sql_round(*[f"{k}(value) OVER f{n} AS rolling__value__{k}_{n}" for n in fam.WINDOWS for k in ("min", "max")]) + e_frames(*fam.WINDOWS))
def rolling_min_max(spark, sf_dir):
    return r6(telemetry(spark, sf_dir).select(*of(fam.rolling("value", events_window(), statistics=("min", "max")), ["seq"])))


@query("SELECT event_id AS seq, " + sql_round(*[f"median(value) OVER f{n} AS rolling__value__median_{n}" for n in fam.WINDOWS]) + e_frames(*fam.WINDOWS))
def rolling_median(spark, sf_dir):
    return r6(telemetry(spark, sf_dir).select(*of(fam.rolling("value", events_window(), statistics=("median",)), ["seq"])))


def _ewm_sql(n: int, frame: str) -> str:
    return f"list_reduce(list(value) OVER ({frame}), lambda a, x: (1 - {2 / (n + 1)!r}::DOUBLE) * a + {2 / (n + 1)!r}::DOUBLE * x)"


@query("SELECT event_id AS seq, " + sql_round(*[_ewm_sql(n, "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING") + f" AS ewm__value__span_{n}" for n in fam.SPANS]) + " FROM events")
def ewm_history(spark, sf_dir):
    df, means = fam.ewm(telemetry(spark, sf_dir), ["value"], events_window())
    return r6(df.select(*of(means, ["seq"])))


@query(
    "SELECT event_id AS seq, "
    + sql_round(*[x for k in fam.PERIODS for x in (f"value - lag(value, {k}) OVER w AS rate_of_change__value__absolute_change_{k}", f"CASE WHEN abs(lag(value, {k}) OVER w) >= 1e-8 THEN (value - lag(value, {k}) OVER w) / abs(lag(value, {k}) OVER w) END AS rate_of_change__value__pct_change_{k}")])
    + E_WINDOW
)
def roc_family(spark, sf_dir):
    return r6(telemetry(spark, sf_dir).select(*of(fam.rate_of_change("value", events_window()), ["seq"])))


def _anomaly_sql(n: int) -> list[str]:
    z = f"CASE WHEN stddev_pop(value) OVER f{n} >= 1e-8 THEN (value - avg(value) OVER f{n}) / stddev_pop(value) OVER f{n} END"
    return [f"avg(value) OVER f{n} AS anomaly__value__historical_mean_{n}", f"stddev_pop(value) OVER f{n} AS anomaly__value__historical_std_{n}", f"{z} AS anomaly__value__zscore_{n}"]


@query(
    "SELECT event_id AS seq, " + sql_round(*[x for n in fam.Z_WINDOWS for x in _anomaly_sql(n)]) + ", "
    + ", ".join(f"CASE WHEN abs({_anomaly_sql(n)[2].rsplit(' AS ', 1)[0]}) >= 3 THEN 1 ELSE 0 END AS anomaly__value__flag_{n}" for n in fam.Z_WINDOWS) + e_frames(*fam.Z_WINDOWS)
)
def anomaly_family(spark, sf_dir):
    return r6(telemetry(spark, sf_dir).select(*of(fam.anomaly("value", events_window()), ["seq"])))


@query(None)
def all_window_families(spark, sf_dir):
    """Every history feature of one sensor: 46 columns, one exchange."""
    w = events_window()
    past = fam.lag("value", w) + fam.rolling("value", w) + fam.rate_of_change("value", w) + fam.anomaly("value", w)
    df, means = fam.ewm(fam.add(telemetry(spark, sf_dir), past), ["value"], w)
    return r6(df.select("seq", *[f.name for f in past], *[f.column.alias(f.name) for f in means]))


ORACLES["all_window_families"] = "SELECT * FROM " + " JOIN ".join(f"({ORACLES[q]}) AS {q}" + (" USING (seq)" if i else "") for i, q in enumerate(("lag_family", "rolling_mean_std", "rolling_min_max", "rolling_median", "ewm_history", "roc_family", "anomaly_family")))


# --- time ---------------------------------------------------------------------------------------


@query(
    "SELECT event_id AS seq, " + ", ".join(f"({e})::DOUBLE AS time__{k}" for k, e in (("hour", "hour(ts)"), ("day_of_week", "isodow(ts) - 1"), ("day_of_month", "day(ts)"), ("day_of_year", "dayofyear(ts)"), ("week_of_year", "weekofyear(ts)"), ("month", "month(ts)"), ("quarter", "quarter(ts)")))
    + ", " + ", ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END AS time__{k}" for k, e in (("is_weekend", "isodow(ts) >= 6"), ("is_month_start", "day(ts) = 1"), ("is_month_end", "ts::DATE = last_day(ts)"), ("is_quarter_start", "day(ts) = 1 AND month(ts) % 3 = 1"), ("is_quarter_end", "ts::DATE = last_day(ts) AND month(ts) % 3 = 0")))
    + " FROM events"
)
def time_calendar(spark, sf_dir):
    return telemetry(spark, sf_dir).select(*of(fam.calendar("timestamp"), ["seq"]))


@query("SELECT event_id AS seq, " + sql_round(*[f"{f}(2 * pi() * ({e}) / {p}) AS time__{k}_{f}" for k, e, p in (("hour", "hour(ts)", 24), ("day_of_week", "isodow(ts) - 1", 7), ("month", "month(ts)", 12)) for f in ("sin", "cos")]) + " FROM events")
def time_cyclical(spark, sf_dir):
    return r6(telemetry(spark, sf_dir).select(*of(fam.cyclical("timestamp"), ["seq"])))


@query("SELECT event_id AS seq, round((epoch_us(ts) - (SELECT epoch_us(ts) FROM events ORDER BY user_id, ts, event_id LIMIT 1)) / 1e6::DOUBLE, 6) AS time__elapsed_seconds FROM events")
def time_elapsed(spark, sf_dir):
    return r6(fam.elapsed(telemetry(spark, sf_dir), "timestamp", "machine_id", ["seq"]).select("seq", "time__elapsed_seconds"))


# --- single rows --------------------------------------------------------------------------------


@query(
    G + "SELECT uid, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS missingness__{c}" for c in ("type", *SENSORS)) + ", "
    + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in SENSORS) + " AS missingness__sensor_missing_count FROM g"
)
def missingness_flags(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    return df.select(*of(fam.missingness(df, ["uid"]), ["uid"]))


@query(
    M + "SELECT uid, "
    + sql_round("process_temperature_k - air_temperature_k AS physical__temperature_gap_k", f"{POWER} AS physical__mechanical_power_w", f"{POWER} / 1000 AS physical__mechanical_power_kw", "torque_nm * rotational_speed_rpm AS physical__torque_speed_interaction", "torque_nm / rotational_speed_rpm AS physical__torque_per_rpm", f"rotational_speed_rpm * {RAD} AS physical__angular_velocity_rad_s")
    + " FROM m"
)
def physical_features(spark, sf_dir):
    df = machines(spark, sf_dir)
    return r6(df.select(*of(fam.physical(df), ["uid"])))


@query(
    M + "SELECT uid, "
    + sql_round("tool_wear_min * tool_wear_min AS tool_wear__square", "sqrt(greatest(tool_wear_min, 0)) AS tool_wear__sqrt", "ln(1 + tool_wear_min) AS tool_wear__log1p", "tool_wear_min / greatest((SELECT max(tool_wear_min) FROM m), 1) AS tool_wear__cumulative_normalized", "200 - tool_wear_min AS tool_wear__distance_to_200_min")
    + " FROM m"
)
def tool_wear_features(spark, sf_dir):
    df = machines(spark, sf_dir)
    top = df.agg(F.max("tool_wear_min")).first()[0]
    return r6(df.select(*of(fam.tool_wear(df, top), ["uid"])))


@query(M + "SELECT uid, " + sql_round("process_temperature_k - air_temperature_k AS difference__process_minus_air_temperature", "process_temperature_k / air_temperature_k AS ratio__process_to_air_temperature_ratio", "torque_nm / rotational_speed_rpm AS ratio__torque_to_speed_ratio") + " FROM m")
def difference_ratio(spark, sf_dir):
    df = machines(spark, sf_dir)
    return r6(df.select(*of(fam.differences(df) + fam.ratios(df), ["uid"])))


@query(
    M + "SELECT uid, "
    + sql_round("process_temperature_k * tool_wear_min AS interaction__process_temperature_x_tool_wear", "torque_nm * tool_wear_min AS interaction__torque_x_tool_wear", "rotational_speed_rpm * tool_wear_min AS interaction__rpm_x_tool_wear", "(process_temperature_k - air_temperature_k) * torque_nm AS interaction__temperature_gap_x_torque")
    + " FROM m"
)
def interactions(spark, sf_dir):
    df = machines(spark, sf_dir)
    return r6(df.select(*of(fam.interactions(df), ["uid"])))


OPERATING = {"low_rpm_flag": "rotational_speed_rpm < 1380", "small_temperature_gap_flag": "process_temperature_k - air_temperature_k < 8.6::DOUBLE", "high_tool_wear_flag": "tool_wear_min >= 200", "critical_tool_wear_window_flag": "tool_wear_min BETWEEN 200 AND 240", "power_outside_range_flag": f"{POWER} < 3500 OR {POWER} > 9000"}


@query(G + "SELECT uid, " + ", ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END AS operating_condition__{k}" for k, e in OPERATING.items()) + " FROM g")
def operating_flags(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    return df.select(*of(fam.operating(df), ["uid"]))


# --- fit and transform --------------------------------------------------------------------------


@query(G + "SELECT uid, " + sql_round(*[f"coalesce({c}, (SELECT median({c}) FROM g)) AS {c}" for c in SENSORS]) + " FROM g")
def learned_imputation(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    medians = {c: m[0] for c, m in exact_quantiles(df, SENSORS, [0.5]).items() if m}
    return r6(df.fillna(medians).select("uid", *SENSORS))


PHYSICAL_SQL = {
    "physical__temperature_gap_k": "process_temperature_k - air_temperature_k", "physical__mechanical_power_w": POWER, "physical__mechanical_power_kw": f"{POWER} / 1000", "physical__torque_speed_interaction": "torque_nm * rotational_speed_rpm",
    "physical__torque_per_rpm": "torque_nm / rotational_speed_rpm", "physical__angular_velocity_rad_s": f"rotational_speed_rpm * {RAD}", "difference__process_minus_air_temperature": "process_temperature_k - air_temperature_k",
    "ratio__process_to_air_temperature_ratio": "process_temperature_k / air_temperature_k", "ratio__torque_to_speed_ratio": "torque_nm / rotational_speed_rpm",
}


def _equal_pairs_sql(names: dict[str, str]) -> str:
    """Pairs of equal columns, each column only with the first that it equals."""
    order = list(names)
    table = M + ", x AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in names.items()) + " FROM m), e AS ("
    pairs = " UNION ALL ".join(f"SELECT {i} AS place, '{a}' AS kept, '{b}' AS duplicate FROM x HAVING count(*) FILTER ({a} IS DISTINCT FROM {b}) = 0" for i, a in enumerate(order) for b in order[i + 1 :])
    return table + pairs + ") SELECT arg_min(kept, place) AS kept, duplicate FROM e GROUP BY duplicate"


CONSTANTS = ["uid", "type", *SENSORS, "fixed", "nothing", "sometimes"]


@query(
    M + ", x AS (SELECT *, 1 AS fixed, NULL::DOUBLE AS nothing, CASE WHEN torque_nm > 20 THEN 1 END AS sometimes FROM m) "
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name FROM x HAVING count({c}) = 0 OR (count({c}) = count(*) AND count(DISTINCT {c}) = 1)" for c in CONSTANTS)
)
def constant_columns_found(spark, sf_dir):
    df = machines(spark, sf_dir).select("*", F.lit(1).alias("fixed"), F.lit(None).cast("double").alias("nothing"), F.expr("CASE WHEN torque_nm > 20 THEN 1 END").alias("sometimes"))
    return spark.createDataFrame([(c,) for c in constant_columns(df, [c for c in df.columns if c != "machine_failure"])], "column_name string")


@query(_equal_pairs_sql(PHYSICAL_SQL))
def duplicate_columns_found(spark, sf_dir):
    df = machines(spark, sf_dir)
    features = fam.physical(df) + fam.differences(df) + fam.ratios(df)
    found = duplicate_columns(fam.add(df, features), [f.name for f in features], ["uid"])
    return spark.createDataFrame([(b, a) for a, b in found], "duplicate string, kept string")


STATS = ["n_rows", "non_null", "missing", "mean", "std", "min", "median", "max", "n_unique"]


def _stats_sql(columns: list[str], exprs: dict[str, str], table: str, name: str = "feature") -> str:
    """A row per column from one aggregate each, with {c} for the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS {name}, " + ", ".join(f"{e.format(c=c)} AS {k}" for k, e in exprs.items()) + f" FROM {table}" for c in columns)


SUMMARY_SQL = {"n_rows": "count(*)", "non_null": "count({c})", "missing": "count(*) - count({c})", "mean": "round(avg({c}), 6)", "std": "round(stddev_pop({c}), 6)", "min": "round(min({c}), 6)", "median": "round(median({c}), 6)", "max": "round(max({c}), 6)", "n_unique": "count(DISTINCT {c})"}


@query(G + _stats_sql(SENSORS, SUMMARY_SQL, "g"))
def feature_summary(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir).select(*SENSORS)
    s = quality.feature_statistics(df)
    # Population deviation, as the feature summary has it.
    std = F.col("std") * F.sqrt((F.col("non_null") - 1) / F.col("non_null"))
    return r6(s.withColumn("std", std).select("feature", *STATS))


@query("SELECT * FROM (VALUES ('missingness', 7), ('physical', 6), ('operating_condition', 5), ('tool_wear', 5), ('interaction', 4), ('ratio', 2), ('difference', 1)) t(feature_group, features)")
def feature_group_counts(spark, sf_dir):
    df = machines(spark, sf_dir)
    engineer = FeatureEngineer(Settings())
    engineer.generate(df.drop("uid", "product_id"), False, None)
    return group_counts(fam.metadata(spark, engineer.features)).select("feature_group", F.col("features").cast("int").alias("features"))


@query(
    f"WITH a AS ({GAP_SQL}), s AS (SELECT *, row_number() OVER (PARTITION BY machine_failure ORDER BY md5(uid || '42'), uid) AS place, count(*) OVER (PARTITION BY machine_failure) AS n FROM a), "
    "t AS (SELECT * FROM s WHERE place <= floor(n * 70 / 100)) "
    + "SELECT uid, machine_failure, " + sql_round(*[f"coalesce({c}, (SELECT median({c}) FROM t)) AS {c}" for c in SENSORS], f"{POWER} AS physical__mechanical_power_w") + " FROM s WHERE place > floor(n * 85 / 100)"
)
def engineered_test_split(spark, sf_dir):
    """Fit on the training split, transform the test split."""
    parts = split.stratified(machines_with_gaps(spark, sf_dir), "uid")
    model = FeatureEngineer(Settings()).fit(parts.where("split = 'train'").drop("split"))
    return r6(model.transform(parts.where("split = 'test'").drop("split")).select("uid", "machine_failure", *SENSORS, "physical__mechanical_power_w"))


@query(
    SPLIT + "SELECT uid, " + sql_round("tool_wear_min / greatest((SELECT max(tool_wear_min) FROM p WHERE split = 'test'), 1) AS tool_wear__cumulative_normalized", "200 - tool_wear_min AS tool_wear__distance_to_200_min") + " FROM p WHERE split = 'test'"
)
def engineered_wear(spark, sf_dir):
    """The default fit and transform, whose normalised wear looks at the batch's maximum."""
    parts = split.stratified(machines(spark, sf_dir), "uid")
    model = FeatureEngineer(Settings(missing_indicators=False)).fit(parts.where("split = 'train'").drop("split"))
    table = model.transform(parts.where("split = 'test'").drop("split"))
    return r6(table.select("uid", "tool_wear__cumulative_normalized", "tool_wear__distance_to_200_min"))


@query("SELECT event_id, round(avg(value) OVER w, 6) AS rolling__value__mean_3, round(max(value) OVER w, 6) AS rolling__value__max_3 FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)")
def rolling_ungrouped(spark, sf_dir):
    """Windows of a table without a machine column: all rows are one sequence, evaluated in chunks."""
    df, features = fam.with_history(telemetry(spark, sf_dir), None, "timestamp", ["seq"], lambda w: fam.rolling("value", w, (3,), ("mean", "max")), 3)
    return r6(df.select(F.col("seq").alias("event_id"), *[f.name for f in features]))


@query(ORACLES["all_window_families"])
def chunked_window_families(spark, sf_dir):
    """Every history feature of one sensor, each machine's sequence cut in chunks of 32 rows."""
    past = lambda w: fam.lag("value", w) + fam.rolling("value", w) + fam.rate_of_change("value", w) + fam.anomaly("value", w)
    df, features = fam.with_history(telemetry(spark, sf_dir), "machine_id", "timestamp", ["seq"], past, 20, ["value"], fam.SPANS, chunk_rows=32)
    return r6(df.select("seq", *[f.name for f in features]))


@query(M + "SELECT uid, type, machine_failure, " + sql_round(*[f"{c} AS {c}" for c in SENSORS]) + " FROM m")
def canonical_columns(spark, sf_dir):
    """A table under raw names gets the canonical ones, numbers out of texts, and no empty rows."""
    raw = {"uid": "Unique Identifier", "type": "Product_Type", "air_temperature_k": "Air temp", "process_temperature_k": "Process temperature [K]", "rotational_speed_rpm": "RPM", "torque_nm": " Torque  [Nm]", "tool_wear_min": "tool_wear", "machine_failure": "failure flag"}
    df = machines(spark, sf_dir)
    given = df.select(*[F.col(c).cast("string" if c in SENSORS else kind).alias(raw[c]) for c, kind in df.dtypes if c in raw])
    empty = given.limit(1).select(*[F.lit(None).cast(kind).alias(c) for c, kind in given.dtypes])
    return r6(validation.convert_numeric(normalized(given.union(empty)), SENSORS, strict=True))


# --- validation and profiling -------------------------------------------------------------------


@query(G + _stats_sql(["uid", "type", *SENSORS, "machine_failure"], {"missing": "count(*) - count({c})", "n_rows": "count(*)", "missing_ratio": "round((count(*) - count({c})) / count(*)::DOUBLE, 6)"}, "g", "column_name"))
def missing_summary(spark, sf_dir):
    return r6(validation.missing_summary(machines_with_gaps(spark, sf_dir)))


@query("SELECT coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0)::BIGINT AS duplicate_rows, coalesce(sum(n - 1), 0)::BIGINT AS extra_copies FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount, l_tax)")
def duplicate_row_summary(spark, sf_dir):
    return validation.duplicate_summary(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"))


@query(G + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(min({c}), 6) AS observed_min, round(max({c}), 6) AS observed_max, {lo}::DOUBLE AS allowed_min, {hi}::DOUBLE AS allowed_max, count(*) FILTER ({c} < {lo} OR {c} > {hi}) AS violations FROM g" for c, (lo, hi) in validation.RANGES.items()))
def range_diagnostics(spark, sf_dir):
    return r6(validation.range_diagnostics(machines_with_gaps(spark, sf_dir)))


@query(
    G + "SELECT count(*) AS n_rows, 8 AS n_columns, 6 AS numeric_columns, 2 AS other_columns, sum(" + " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in ("uid", "type", *SENSORS, "machine_failure")) + ")::BIGINT AS missing_cells, "
    "(SELECT coalesce(sum(CASE WHEN n > 1 THEN n ELSE 0 END), 0)::BIGINT FROM (SELECT count(*) AS n FROM g GROUP BY ALL)) AS duplicate_rows, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM g GROUP BY ALL)) AS extra_copies, round(avg(machine_failure), 6) AS positive_rate FROM g"
)
def dataset_profile(spark, sf_dir):
    return r6(validation.profile(machines_with_gaps(spark, sf_dir)))


ORACLES["dataset_profile"] = ORACLES["dataset_profile"].replace("(SELECT count(*) AS n FROM g GROUP BY ALL)", "(SELECT count(*) AS n FROM g GROUP BY uid, type, air_temperature_k, process_temperature_k, rotational_speed_rpm, torque_nm, tool_wear_min, machine_failure)")


@query(M + "SELECT machine_failure AS target, count(*) AS n_rows FROM m GROUP BY 1")
def target_histogram(spark, sf_dir):
    return validation.target_histogram(machines(spark, sf_dir))


@query("SELECT count(*) FILTER (toxic IS NULL) AS missing, count(*) FILTER (toxic NOT IN (0, 1)) AS not_binary FROM labels")
def binary_target_check(spark, sf_dir):
    found = validation.binary_target_problems(spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic")
    return spark.createDataFrame([(found["missing"], found["not_binary"])], "missing long, not_binary long")


LOGIC = {
    "hdf": "process_temperature_k - air_temperature_k < 8.6::DOUBLE AND rotational_speed_rpm < 1380",
    "pwf": f"{POWER} < 3500 OR {POWER} > 9000",
    "twf": "tool_wear_min BETWEEN 200 AND 240",
    "osf": "tool_wear_min * torque_nm > CASE upper(type) WHEN 'L' THEN 11000 WHEN 'M' THEN 12000 WHEN 'H' THEN 13000 END",
}


@query(G + "SELECT uid, " + ", ".join(f"CASE WHEN {e} THEN 1 ELSE 0 END AS logic_{k}" for k, e in LOGIC.items()) + " FROM g")
def failure_logic_diagnostics(spark, sf_dir):
    return validation.failure_logic(machines_with_gaps(spark, sf_dir)).select("uid", *[f"logic_{k}" for k in LOGIC])


@query(G + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({e}) AS marked, 0::BIGINT AS labelled FROM g" for k, e in LOGIC.items()))
def failure_logic_summary(spark, sf_dir):
    return validation.failure_logic_summary(machines_with_gaps(spark, sf_dir))


@query("SELECT 'ts' AS timestamp_column, 'timeseries' AS data_mode")
def mode_detection(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("user_id", "machine_id").withColumnRenamed("ts", "event_time")
    return spark.createDataFrame([(validation.timestamp_column(df).replace("event_time", "ts"), validation.data_mode(df))], "timestamp_column string, data_mode string")


LOADED_SQL = "WITH e AS (SELECT user_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS ts, event_id % 3 AS kind FROM events), k AS (SELECT user_id, ts, count(*) AS n FROM e GROUP BY ALL), r AS (SELECT count(*) AS n FROM e GROUP BY user_id, ts, kind), g AS (SELECT max(epoch_us(ts) - epoch_us(before)) AS gap FROM (SELECT ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM e WHERE ts IS NOT NULL)) "


@query(LOADED_SQL + "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS machines, count(*) - count(ts) AS untimed, (SELECT sum(n - 1) FROM k)::BIGINT AS repeated_keys, (SELECT sum(n - 1) FROM r)::BIGINT AS repeated_rows, (SELECT round(gap / 1e6, 6) FROM g) AS longest_gap FROM e")
def loaded_diagnostics(spark, sf_dir):
    """A table under raw names, some times missing, put in order: what the order tells."""
    raw = telemetry(spark, sf_dir).select(F.col("machine_id").alias("Machine ID"), F.when(F.col("seq") % 50 != 0, F.col("timestamp")).cast("string").alias("Event Timestamp"), (F.col("seq") % 3).alias("kind"))
    d = loading.prepared(raw, "timeseries").diagnostics
    return r6(spark.createDataFrame([(d.rows, d.machines, d.untimed, d.repeated_keys, d.repeated_rows, d.longest_gap_seconds)], "n_rows long, machines long, untimed long, repeated_keys long, repeated_rows long, longest_gap double"))


@query("SELECT event_id, user_id AS machine, ts AS at, row_number() OVER (ORDER BY user_id, ts, event_id) - row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_machine FROM events")
def loaded_order(spark, sf_dir):
    """The rows of a loaded table lie in order: how many of other machines lie before each one's."""
    raw = telemetry(spark, sf_dir).select(F.col("machine_id").alias("Machine ID"), F.col("timestamp").alias("Event Timestamp"), F.col("seq").alias("event id"))
    numbered, _ = ordering.ordered(raw, "Machine ID", "Event Timestamp", row="place")
    first = numbered.groupBy("Machine ID").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    start = first.withColumn("before_machine", F.coalesce(F.sum("n").over(Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("Machine ID").alias("of"), "before_machine")
    return numbered.join(start, F.col("Machine ID") == F.col("of")).select(F.col("event id").alias("event_id"), F.col("Machine ID").alias("machine"), F.col("Event Timestamp").alias("at"), "before_machine")


# --- splits -------------------------------------------------------------------------------------


@query(SPLIT + "SELECT split, machine_failure, count(*) AS n_rows FROM p GROUP BY ALL")
def stratified_split_sizes(spark, sf_dir):
    return split.stratified(machines(spark, sf_dir), "uid").groupBy("split", "machine_failure").agg(F.count(F.lit(1)).alias("n_rows"))


@query(SPLIT + " UNION ALL ".join(f"SELECT '{a}_{b}' AS pair, count(*) AS shared_ids FROM (SELECT uid FROM p WHERE split = '{a}' INTERSECT SELECT uid FROM p WHERE split = '{b}')" for a, b in (("train", "validation"), ("train", "test"), ("validation", "test"))))
def split_overlap(spark, sf_dir):
    return split.overlaps(split.stratified(machines(spark, sf_dir), "uid"), "uid")


@query(SPLIT + "SELECT split, count(*) AS n_rows, 0::BIGINT AS missing_cells, sum(machine_failure)::BIGINT AS positives, 0.0::DOUBLE AS missing_rate, round(avg(machine_failure), 6) AS positive_rate FROM p GROUP BY split")
def split_summary(spark, sf_dir):
    return r6(split.split_summary(split.stratified(machines(spark, sf_dir), "uid")))


@query(M + "SELECT type, " + sql_round(*[f"{c} AS {c}" for c in SENSORS]) + " FROM m")
def predictive_frame(spark, sf_dir):
    return r6(split.predictive_frame(machines(spark, sf_dir)))


# --- quality audit ------------------------------------------------------------------------------

PROFILE_SQL = {
    "n_rows": "count(*)", "non_null": "count({c})", "infinite": "0::BIGINT", "mean": "round(avg({c}), 6)", "std": "round(stddev_samp({c}), 6)", "variance": "round(var_samp({c}), 6)",
    "min": "round(min({c}), 6)", "max": "round(max({c}), 6)", "skew": "round(skewness({c}), 6)", "zeros": "count(*) FILTER ({c} = 0)", "negatives": "count(*) FILTER ({c} < 0)", "positives": "count(*) FILTER ({c} > 0)",
    "q1": "round(quantile_cont({c}, 0.25), 6)", "median": "round(quantile_cont({c}, 0.5), 6)", "q3": "round(quantile_cont({c}, 0.75), 6)", "n_unique": "count(DISTINCT {c})",
    "missing": "count(*) - count({c})", "missing_ratio": "round((count(*) - count({c})) / count(*)::DOUBLE, 6)", "unique_ratio": "round(count(DISTINCT {c}) / count({c})::DOUBLE, 6)",
    "iqr": "round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6)", "is_constant": "count(DISTINCT {c}) <= 1", "possible_identifier": "count(DISTINCT {c}) / count({c})::DOUBLE >= 0.98 AND count(DISTINCT {c}) > 10",
    "top_share": "(SELECT round(max(n) / sum(n), 6) FROM (SELECT count(*) AS n FROM g GROUP BY {c}))", "is_near_constant": "(SELECT max(n) >= 0.995 * sum(n) FROM (SELECT count(*) AS n FROM g GROUP BY {c}))",
}
PROFILED = [*SENSORS, "machine_failure"]


@query(G + _stats_sql(PROFILED, PROFILE_SQL, "g"))
def quality_statistics(spark, sf_dir):
    return r6(quality.feature_statistics(machines_with_gaps(spark, sf_dir)).select("feature", *PROFILE_SQL))


@query(G + "SELECT * FROM (" + _stats_sql(PROFILED, {"missing": "count(*) - count({c})", "missing_ratio": "round((count(*) - count({c})) / count(*)::DOUBLE, 6)"}, "g") + ") WHERE missing_ratio > 0.03")
def missing_features(spark, sf_dir):
    return r6(quality.missing_features(quality.feature_statistics(machines_with_gaps(spark, sf_dir)), 0.03))


@query("WITH e AS (SELECT CASE WHEN event_id % 400 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare, value FROM events) SELECT 'rare' AS feature, round(greatest(avg(rare), 1 - avg(rare)), 6) AS top_share FROM e")
def near_constant(spark, sf_dir):
    df = telemetry(spark, sf_dir).select(F.when(F.col("seq") % 400 == 0, 1.0).otherwise(0.0).alias("rare"), "value")
    return r6(quality.near_constant_features(quality.feature_statistics(df)))


@query("WITH e AS (SELECT CASE WHEN event_id % 400 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS rare, value, user_id::DOUBLE AS machine FROM events), n AS (SELECT 'rare' AS feature, max(n) AS n FROM (SELECT count(*) AS n FROM e GROUP BY rare) UNION ALL SELECT 'value', max(n) FROM (SELECT count(*) AS n FROM e GROUP BY value) UNION ALL SELECT 'machine', max(n) FROM (SELECT count(*) AS n FROM e GROUP BY machine)) SELECT feature, round(n / (SELECT count(*) FROM e)::DOUBLE, 6) AS top_share FROM n")
def most_frequent_shares(spark, sf_dir):
    df = telemetry(spark, sf_dir).select(F.when(F.col("seq") % 400 == 0, 1.0).otherwise(0.0).alias("rare"), "value", F.col("machine_id").cast("double").alias("machine"))
    return r6(quality.top_shares(df, df.columns))


@query(ORACLES["near_constant"])
def near_constant_scan(spark, sf_dir):
    """The same columns from frequent-items sketches and a count of their candidates."""
    df = telemetry(spark, sf_dir).select(F.when(F.col("seq") % 400 == 0, 1.0).otherwise(0.0).alias("rare"), "value")
    return r6(quality.near_constants(df))


@query("SELECT * FROM (VALUES ('physical__temperature_gap_k', 'difference__process_minus_air_temperature'), ('physical__torque_per_rpm', 'ratio__torque_to_speed_ratio')) t(kept, duplicate)")
def duplicate_pairs(spark, sf_dir):
    df = machines(spark, sf_dir)
    features = fam.physical(df) + fam.differences(df) + fam.ratios(df)
    return quality.duplicate_pairs(df.select("uid", *of(features, [])), ["uid"])


@query("SELECT 'reading' AS feature, count(*) FILTER (event_id % 7 = 0) AS positive, count(*) FILTER (event_id % 11 = 0 AND event_id % 7 <> 0) AS negative FROM events")
def infinite_values(spark, sf_dir):
    x = F.when(F.col("seq") % 7 == 0, float("inf")).when(F.col("seq") % 11 == 0, float("-inf")).otherwise(F.col("value"))
    return quality.infinite_values(telemetry(spark, sf_dir).select(x.alias("reading"), "value"))


def _pairs_sql(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, round(corr({a}, {b}), 6) AS correlation FROM {table}" for i, a in enumerate(columns) for b in columns[i + 1 :])


@query(G + _pairs_sql(PROFILED, "g"))
def correlation_pairs(spark, sf_dir):
    return r6(quality.correlation_pairs(machines_with_gaps(spark, sf_dir), PROFILED))


WIDE = [*SENSORS, "gap", "power", "wear2"]
WIDE_SQL = f"WITH g AS ({GAP_SQL}), x AS (SELECT *, process_temperature_k - air_temperature_k AS gap, {POWER} AS power, tool_wear_min * tool_wear_min AS wear2 FROM g) "


def wide(spark, sf_dir):
    return machines_with_gaps(spark, sf_dir).withColumns({"gap": F.col("process_temperature_k") - F.col("air_temperature_k"), "power": fam.power_w(), "wear2": F.col("tool_wear_min") * F.col("tool_wear_min")})


@query(WIDE_SQL + "SELECT *, abs(correlation) AS abs_correlation FROM (" + _pairs_sql(WIDE, "x") + ") WHERE abs(correlation) >= 0.7")
def high_correlations(spark, sf_dir):
    return r6(quality.high_correlations(quality.correlation_pairs(wide(spark, sf_dir), WIDE), 0.7))


def _target_sql(columns: list[str], table: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, machine_failure), 6) AS correlation, round(abs(corr({c}, machine_failure)), 6) AS abs_correlation FROM {table}" for c in columns)


@query(WIDE_SQL + _target_sql(WIDE, "x"))
def target_correlations(spark, sf_dir):
    return r6(quality.target_correlations(wide(spark, sf_dir), "machine_failure"))


@query(WIDE_SQL + f"SELECT * FROM ({_target_sql(WIDE, 'x')}) ORDER BY abs_correlation DESC, feature LIMIT 3")
def top_correlations(spark, sf_dir):
    return r6(plots.top_correlations(quality.target_correlations(wide(spark, sf_dir), "machine_failure"), 3))


DISTRIBUTION = ["non_null", "mean", "std", "min", "q1", "median", "q3", "max", "iqr", "skew", "zeros", "negatives", "positives"]


@query(G + _stats_sql(PROFILED, {k: PROFILE_SQL[k] for k in DISTRIBUTION}, "g"))
def distribution_summary(spark, sf_dir):
    return r6(quality.distribution_summary(machines_with_gaps(spark, sf_dir)))


@query(
    G + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(any_value(lo), 6) AS lower, round(any_value(hi), 6) AS upper, count(*) FILTER ({c} < lo) AS below, count(*) FILTER ({c} > hi) AS above, count({c}) AS valid, round((count(*) FILTER ({c} < lo OR {c} > hi)) / count({c})::DOUBLE, 6) AS outlier_ratio "
        f"FROM g, (SELECT quantile_cont({c}, 0.25) - 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS lo, quantile_cont({c}, 0.75) + 1.5::DOUBLE * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS hi FROM g)"
        for c in SENSORS
    )
)
def iqr_outliers(spark, sf_dir):
    return r6(quality.iqr_outliers(machines_with_gaps(spark, sf_dir).select(*SENSORS)))


@query("SELECT 'event_id' AS feature, count(DISTINCT event_id) AS n_unique, round(count(DISTINCT event_id) / count(*)::DOUBLE, 6) AS unique_ratio FROM events")
def identifier_like(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    return r6(quality.identifier_like(quality.feature_statistics(df)))


LEAKY_SQL = "WITH x AS (SELECT *, machine_failure * 2.0::DOUBLE + 1 AS doubled, machine_failure AS machine_failure_copy FROM g) "


@query(
    G.rstrip() + ", " + LEAKY_SQL[5:]
    + "SELECT * FROM (VALUES ('doubled', false, false, true, 'correlates almost fully'), ('machine_failure_copy', true, true, true, 'named like the target; copies the target; correlates almost fully')) t(feature, has_name, is_copy, is_high, reason), (SELECT round(corr(doubled, machine_failure), 6) AS correlation FROM x)"
)
def leakage_report(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir).withColumns({"doubled": F.col("machine_failure") * 2.0 + 1, "machine_failure_copy": F.col("machine_failure")})
    return r6(quality.leakage_report(df, "machine_failure"))


def _audited(spark, sf_dir) -> DataFrame:
    df = wide(spark, sf_dir).withColumns({"fixed": F.lit(1.0), "sparse": F.when(F.col("torque_nm") < 20, F.col("torque_nm")), "machine_failure_copy": F.col("machine_failure")})
    return df.drop("power")


#: Columns of ``_audited`` that share a type, and may be equal.
COMPARED = [*SENSORS, "gap", "wear2", "fixed", "sparse"]
DUPLICATES_SQL = " + ".join(f"(count(*) FILTER ({a} IS DISTINCT FROM {b}) = 0)::INTEGER" for i, a in enumerate(COMPARED) for b in COMPARED[i + 1 :])
SPEED_IS_ID = "(SELECT count(DISTINCT rotational_speed_rpm) >= 0.98 * count(rotational_speed_rpm) FROM g)"


@query(G + f"SELECT * FROM (VALUES ('air_temperature_k', 'KEEP'), ('fixed', 'REMOVE_CONSTANT'), ('gap', 'KEEP'), ('machine_failure_copy', 'REVIEW_LEAKAGE'), ('process_temperature_k', 'KEEP'), ('rotational_speed_rpm', CASE WHEN {SPEED_IS_ID} THEN 'REVIEW_IDENTIFIER' ELSE 'KEEP' END), ('sparse', 'IMPUTE'), ('tool_wear_min', 'REVIEW'), ('torque_nm', 'REVIEW'), ('wear2', 'REVIEW')) t(feature, recommendation)")
def recommendations(spark, sf_dir):
    return quality.audit(_audited(spark, sf_dir), "machine_failure", ["uid"])["recommendations"].select("feature", "recommendation")


@query(
    G + "SELECT metric, value::DOUBLE AS value FROM (SELECT 'rows' AS metric, count(*) AS value FROM g UNION ALL SELECT 'missing_cells', " + " + ".join(f"count(*) - count({c})" for c in SENSORS)
    + " + count(*) FILTER (torque_nm IS NULL OR torque_nm >= 20) + " + "count(*) FILTER (air_temperature_k IS NULL)"
    + f" FROM g UNION ALL SELECT * FROM (VALUES ('features', 10), ('infinite_cells', 0), ('constant_features', 1), ('near_constant_features', 0), ('identifier_like_features', {SPEED_IS_ID}::INTEGER), ('kept_features', 4 - {SPEED_IS_ID}::INTEGER)) t(metric, value)"
    + f" UNION ALL SELECT 'duplicate_pairs', {DUPLICATES_SQL} FROM (SELECT *, process_temperature_k - air_temperature_k AS gap, tool_wear_min * tool_wear_min AS wear2, 1.0::DOUBLE AS fixed, CASE WHEN torque_nm < 20 THEN torque_nm END AS sparse FROM g))"
)
def quality_summary(spark, sf_dir):
    tables = quality.audit(_audited(spark, sf_dir), "machine_failure", ["uid"], only=["statistics", "recommendations", "duplicates"])
    return quality.summary(tables["statistics"], tables["recommendations"], tables["duplicates"])


# --- online -------------------------------------------------------------------------------------


@query("SELECT user_id::VARCHAR AS machine_key, epoch_us(ts) AS seq, " + ", ".join(f"lag(value, {k}) OVER w AS value_lag_{k}" for k in ONLINE.lags) + E_WINDOW)
def online_lag(spark, sf_dir):
    return online.replay(arrivals(spark, sf_dir), ONLINE).select("machine_key", "seq", *[f"value_lag_{k}" for k in ONLINE.lags])


def _when(least: int, n: int, e: str) -> str:
    return f"CASE WHEN count(value) OVER f{n} >= {least} THEN {e} END"


ROLLING_SQL = [_when(2, n, f"{f}(value) OVER f{n}") + f" AS value_rolling_{n}_{k}" for n in ONLINE.windows for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("median", "median"))]
Z_SQL = {n: _when(3, n, f"CASE WHEN stddev_samp(value) OVER f{n} > 1e-8 THEN (value - avg(value) OVER f{n}) / stddev_samp(value) OVER f{n} END") for n in ONLINE.windows}
ROC_SQL = [f"CASE WHEN epoch_us(ts) > lag(epoch_us(ts), {k}) OVER w THEN (value - lag(value, {k}) OVER w) / ((epoch_us(ts) - lag(epoch_us(ts), {k}) OVER w) / 1e6::DOUBLE) END AS value_roc_{k}" for k in ONLINE.lags]
EWMA_SQL = [_ewm_sql(n, "PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW") + f" AS value_ewm_{n}" for n in ONLINE.spans]


@query("SELECT event_id AS seq, " + sql_round(*ROLLING_SQL) + e_frames(*ONLINE.windows))
def online_rolling(spark, sf_dir):
    columns = {k: c for k, c in online.online_windows("value", events_window(), ONLINE).items() if "score" not in k}
    return r6(telemetry(spark, sf_dir).select("seq", *[c.alias(k) for k, c in columns.items()]))


@query("SELECT event_id AS seq, " + sql_round(*[f"{z} AS value_rolling_{n}_zscore" for n, z in Z_SQL.items()], *[f"abs({z}) AS value_rolling_{n}_anomaly_score" for n, z in Z_SQL.items()]) + e_frames(*ONLINE.windows))
def online_zscore(spark, sf_dir):
    columns = {k: c for k, c in online.online_windows("value", events_window(), ONLINE).items() if "score" in k}
    return r6(telemetry(spark, sf_dir).select("seq", *[c.alias(k) for k, c in columns.items()]))


@query("SELECT event_id AS seq, " + sql_round(*ROC_SQL) + E_WINDOW)
def online_roc(spark, sf_dir):
    return r6(telemetry(spark, sf_dir).select("seq", *[c.alias(k) for k, c in online.online_changes("value", events_window(), ONLINE).items()]))


def arrivals(spark, sf_dir) -> DataFrame:
    """Events with ``seq``, their time in microseconds, as their order of arrival; no user has two at a time."""
    df = telemetry(spark, sf_dir)
    return df.select("machine_id", "timestamp", F.col("seq").alias("event_id"), "value", F.unix_micros(F.col("timestamp").cast("timestamp")).alias("seq"))


@query("SELECT user_id::VARCHAR AS machine_key, epoch_us(ts) AS seq, " + sql_round(*EWMA_SQL) + " FROM events")
def online_ewma(spark, sf_dir):
    return r6(online.replay(arrivals(spark, sf_dir), ONLINE).select("machine_key", "seq", *[f"value_ewm_{n}" for n in ONLINE.spans]))


REPLAY_SQL = (
    "SELECT user_id::VARCHAR AS machine_key, epoch_us(ts) AS seq, "
    + sql_round(*[f"lag(value, {k}) OVER w AS value_lag_{k}" for k in ONLINE.lags], *ROLLING_SQL, *[f"{z} AS value_rolling_{n}_zscore" for n, z in Z_SQL.items()], *[f"abs({z}) AS value_rolling_{n}_anomaly_score" for n, z in Z_SQL.items()], *EWMA_SQL, *ROC_SQL, "(epoch_us(ts) - lag(epoch_us(ts), 1) OVER w) / 1e6::DOUBLE AS time_since_previous_observation_seconds", "(epoch_us(ts) - first_value(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 128 PRECEDING AND 1 PRECEDING)) / 1e6::DOUBLE AS elapsed_time_since_machine_start_seconds")
    + e_frames(*ONLINE.windows)
)


@query(REPLAY_SQL)
def online_replay(spark, sf_dir):
    return r6(online.replay(arrivals(spark, sf_dir), ONLINE))


@query(REPLAY_SQL)
def online_replay_chunks(spark, sf_dir):
    """The same rows with each machine's rows cut in chunks of 128."""
    return r6(online.replay(arrivals(spark, sf_dir), ONLINE, chunk_rows=128))


@query(REPLAY_SQL)
def stream_replay(spark, sf_dir):
    """The same rows through Structured Streaming, with the state in the state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source, out, checkpoint = (shared_path(spark, x) for x in ("arrivals", "features", "state"))
    rows = arrivals(spark, sf_dir)
    rows.write.parquet(source)
    features = online.stream(spark.readStream.schema(rows.schema).parquet(source), ONLINE)
    job = features.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    job.awaitTermination()
    return r6(spark.read.schema(features.schema).parquet(out))


@query("SELECT event_id AS seq, " + ", ".join(f"({e})::INTEGER AS time_{k}" for k, e in (("hour", "hour(ts)"), ("minute", "minute(ts)"), ("day_of_week", "isodow(ts) - 1"), ("day_of_month", "day(ts)"), ("day_of_year", "dayofyear(ts)"), ("month", "month(ts)"), ("quarter", "quarter(ts)"), ("week_of_year", "weekofyear(ts)"), ("is_weekend", "CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END"))) + " FROM events")
def online_time(spark, sf_dir):
    df = telemetry(spark, sf_dir)
    return df.select("seq", *[c.cast("int").alias(k) for k, c in online.stateless(df).items()])


ONLINE_PHYSICAL = {
    "temperature_gap_k": "process_temperature_k - air_temperature_k", "temperature_ratio": "process_temperature_k / air_temperature_k", "torque_speed_interaction": "torque_nm * rotational_speed_rpm",
    "rotational_speed_rad_per_s": f"rotational_speed_rpm * {RAD}", "mechanical_power_w": POWER, "mechanical_power_kw": f"{POWER} / 1000", "mechanical_power_to_nominal_ratio": f"{POWER} / 2860",
    "torque_per_rpm": "torque_nm / rotational_speed_rpm", "rpm_per_torque": "CASE WHEN abs(torque_nm) > 1e-8 THEN rotational_speed_rpm / torque_nm END", "tool_wear_squared": "tool_wear_min * tool_wear_min",
    "tool_wear_sqrt": "sqrt(greatest(tool_wear_min, 0))", "tool_wear_log1p": "ln(1 + greatest(tool_wear_min, 0))", "tool_wear_fraction_of_240_min": "tool_wear_min / 240", "rotational_speed_k_rpm": "rotational_speed_rpm / 1000", "torque_k_nm": "torque_nm / 10",
}
ONLINE_INTERACTIONS = {
    "temperature_gap_x_torque": "(process_temperature_k - air_temperature_k) * torque_nm", "temperature_gap_x_speed": "(process_temperature_k - air_temperature_k) * rotational_speed_rpm", "temperature_gap_x_tool_wear": "(process_temperature_k - air_temperature_k) * tool_wear_min",
    "mechanical_power_x_tool_wear": f"{POWER} * tool_wear_min", "torque_x_tool_wear": "torque_nm * tool_wear_min", "speed_x_tool_wear": "rotational_speed_rpm * tool_wear_min",
}


@query(G + "SELECT uid, " + sql_round(*[f"{e} AS {k}" for k, e in ONLINE_PHYSICAL.items()]) + " FROM g")
def online_physical(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    return r6(df.select("uid", *[online.stateless(df)[k].alias(k) for k in ONLINE_PHYSICAL]))


@query(G + "SELECT uid, " + sql_round(*[f"{e} AS {k}" for k, e in ONLINE_INTERACTIONS.items()]) + " FROM g")
def online_interactions(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    return r6(df.select("uid", *[online.stateless(df)[k].alias(k) for k in ONLINE_INTERACTIONS]))


@query(G + "SELECT uid, " + sql_round("coalesce(rotational_speed_rpm, (SELECT median(rotational_speed_rpm) FROM g)) AS rotational_speed_rpm", "coalesce(torque_nm, 0) AS torque_nm") + " FROM g")
def online_impute(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    medians = {c: m[0] for c, m in exact_quantiles(df, ["rotational_speed_rpm"], [0.5]).items() if m}
    return r6(online.imputed(df, ["rotational_speed_rpm", "torque_nm"], medians).select("uid", "rotational_speed_rpm", "torque_nm"))


UPDATES = OnlineSettings(lags=(1,), windows=(3,), spans=(3,))
READINGS = {"air_temperature_k": "295 + event_id % 7", "process_temperature_k": "304 + event_id % 11", "rotational_speed_rpm": "1200 + value", "torque_nm": "10 + event_id % 50", "tool_wear_min": "event_id % 254"}


def _history_sql(s: str) -> list[str]:
    """Features of a sensor's history in the whole online row, but for the exponential means (online_ewma)."""
    out = [f"lag({s}, 1) OVER w AS {s}_lag_1", f"({s} - lag({s}, 1) OVER w) / ((epoch_us(ts) - lag(epoch_us(ts), 1) OVER w) / 1e6::DOUBLE) AS {s}_roc_1"]
    rules = {k: (2, f"{f}({s}) OVER f3") for k, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"), ("median", "median"))}
    z = f"CASE WHEN stddev_samp({s}) OVER f3 > 1e-8 THEN ({s} - avg({s}) OVER f3) / stddev_samp({s}) OVER f3 END"
    rules |= {"zscore": (3, z), "anomaly_score": (3, f"abs({z})")}
    return out + [f"CASE WHEN count({s}) OVER f3 >= {least} THEN {e} END AS {s}_rolling_3_{k}" for k, (least, e) in rules.items()]


@query(
    "WITH events AS (SELECT user_id, ts, event_id, " + ", ".join(f"({e})::DOUBLE AS {s}" for s, e in READINGS.items()) + " FROM events) SELECT user_id::VARCHAR AS machine_id, epoch_us(ts) AS seq, "
    + sql_round(*[f"{s} AS {s}" for s in SENSORS], *[f"({s} IS NULL)::INTEGER::DOUBLE AS {s}_missing" for s in SENSORS], *[f"{e} AS {k}" for k, e in (ONLINE_PHYSICAL | ONLINE_INTERACTIONS).items()], *[x for s in SENSORS for x in _history_sql(s)])
    + e_frames(3)
)
def online_update(spark, sf_dir):
    """Whole rows of the online schema."""
    rows = arrivals(spark, sf_dir).selectExpr("machine_id", "timestamp", "seq", *[f"cast({e} as double) AS {s}" for s, e in READINGS.items()])
    rows = online.update_rows(rows, UPDATES)
    return r6(rows.drop("timestamp", *[n for n in rows.columns if n.startswith("time_") or n.startswith("elapsed_") or "_ewm_" in n]))


@query(
    G + "SELECT uid, concat_ws('; ', 'missing machine id', 'missing timestamp', " + ", ".join(f"CASE WHEN {c} IS NULL THEN 'missing {c}' END" for c in SENSORS) + ", 'label machine_failure is not used') AS issues FROM g"
)
def online_validation(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    return df.select("uid", F.array_join(online.observation_issues(df, OnlineSettings()), "; ").alias("issues"))


# --- plot data ----------------------------------------------------------------------------------


@query(
    "WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events) "
    "SELECT event_type, least(floor((value - lo) * 30 / (hi - lo)), 29)::INTEGER AS bin, count(*) AS n_rows FROM events, s GROUP BY ALL"
)
def histogram_by_class(spark, sf_dir):
    return plots.histogram(telemetry(spark, sf_dir), "value", 30, "event_type")


@query(
    G + " UNION ALL ".join(f"SELECT '{c}' AS feature, " + sql_round(*[f"({e} - avg({c})) / stddev_samp({c}) AS {k}" for k, e in (("z_min", f"min({c})"), ("z_q1", f"quantile_cont({c}, 0.25)"), ("z_median", f"quantile_cont({c}, 0.5)"), ("z_q3", f"quantile_cont({c}, 0.75)"), ("z_max", f"max({c})"))]) + " FROM g" for c in SENSORS)
)
def boxplot_standardized(spark, sf_dir):
    return r6(plots.standardized_boxes(machines_with_gaps(spark, sf_dir), SENSORS))


@query(
    "SELECT event_id AS seq, " + sql_round("CASE WHEN count(value) OVER c >= 5 THEN avg(value) OVER c END AS rolling_mean", "CASE WHEN count(value) OVER c >= 5 THEN stddev_samp(value) OVER c END AS rolling_std")
    + " FROM events WINDOW c AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
)
def plot_rolling(spark, sf_dir):
    return r6(plots.rolling_trace(telemetry(spark, sf_dir), "value", "machine_id", "timestamp", ["seq"]).select("seq", "rolling_mean", "rolling_std"))


@query(M + "SELECT machine_failure AS target, count(*) AS n_rows, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM m GROUP BY 1")
def failure_rate(spark, sf_dir):
    return r6(plots.class_rates(machines(spark, sf_dir), "machine_failure"))


@query("WITH s AS (SELECT avg(value) AS m, stddev_samp(value) AS d FROM events) SELECT count(value) AS n_values, count(*) FILTER (abs((value - m) / d) >= 3) AS n_anomalous, round((count(*) FILTER (abs((value - m) / d) >= 3)) * 100.0::DOUBLE / count(value), 6) AS percent_anomalous FROM events, s")
def anomaly_share(spark, sf_dir):
    return r6(plots.anomaly_share(telemetry(spark, sf_dir), "value"))


@query(
    "WITH t AS (SELECT event_id AS seq, value, row_number() OVER w AS place, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS trend FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT seq, round(value, 6) AS value, round(trend, 6) AS trend FROM t WHERE n <= 20 OR (place * 20 + n - 1) // n > ((place - 1) * 20 + n - 1) // n"
)
def sensor_trend(spark, sf_dir):
    trend = plots.sensor_trend(telemetry(spark, sf_dir), "value", "machine_id", "timestamp", ["seq"], points=20)
    return r6(trend.select("seq", "value", "trend"))


@query("SELECT event_id AS seq, value FROM events ORDER BY md5(event_id::VARCHAR || '42'), event_id LIMIT 500")
def relation_sample(spark, sf_dir):
    return plots.relation_sample(telemetry(spark, sf_dir), ["seq", "value"], "seq", 500)


@query("SELECT DISTINCT user_id AS machine_id FROM events ORDER BY 1 LIMIT 8")
def machines_shown(spark, sf_dir):
    return plots.machines_shown(telemetry(spark, sf_dir), "machine_id")


# --- more of loading, checks, fits and plots -------------------------------------------------------


@query("SELECT event_id AS seq, CASE WHEN event_id % 10 > 0 THEN ts END AS timestamp FROM events")
def timestamp_coercion(spark, sf_dir):
    """Texts that are no times become NULL."""
    df = telemetry(spark, sf_dir).select("seq", F.when(F.col("seq") % 10 > 0, F.col("timestamp").cast("string")).otherwise("no time").alias("timestamp"))
    return validation.convert_timestamp(df, "timestamp")


def _listed(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


@query(f"SELECT count(*) AS known, count(*) >= 7 AS is_ai4i FROM (DESCRIBE {AI4I_SQL}) WHERE column_name IN ({_listed(names.DETECTABLE)})")
def ai4i_detection(spark, sf_dir):
    df = machines(spark, sf_dir)
    return spark.createDataFrame([(len(set(df.columns) & set(names.DETECTABLE)), names.is_ai4i(df.columns))], "known long, is_ai4i boolean")


@query(
    M + f"SELECT 'missing column ' || c AS problem FROM (SELECT unnest([{_listed(names.AI4I)}]) AS c) WHERE c NOT IN (SELECT column_name FROM (DESCRIBE {AI4I_SQL})) "
    "UNION ALL SELECT 'the target has fewer than two classes' FROM m WHERE machine_failure = 0 HAVING count(DISTINCT machine_failure) < 2"
)
def schema_problems_found(spark, sf_dir):
    """What a table of healthy machines lacks to be a table of the known kind."""
    df = machines(spark, sf_dir).where("machine_failure = 0")
    return spark.createDataFrame([(p,) for p in validation.schema_problems(df, "machine_failure", ai4i=True)], "problem string")


@query(f"SELECT column_name FROM (DESCRIBE {AI4I_SQL}) WHERE lower(column_name) IN ({_listed(names.LABELS)})")
def label_columns_found(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in names.leak_columns(machines(spark, sf_dir).columns)], "column_name string")


@query("SELECT n AS broken_of_100, count(*) FILTER (event_id % 100 >= n) >= 0.95 * count(*) AS has_time FROM events CROSS JOIN (VALUES (2), (8)) t(n) GROUP BY n")
def time_gate(spark, sf_dir):
    """A fit takes a column for time if 95 % of its values are times."""
    rows = []
    for n in (2, 8):
        stamp = F.when(F.col("seq") % 100 >= n, F.col("timestamp").cast("string")).otherwise("?")
        df = telemetry(spark, sf_dir).select(stamp.alias("timestamp"), "machine_id", "seq", "value")
        settings = Settings(timestamp="timestamp", machine="machine_id", tiebreak=("seq",), lags=(1,), windows=(3,), statistics=("mean",), spans=(3,), periods=(1,), z_windows=(3,))
        rows.append((n, FeatureEngineer(settings).fit(df).learned.has_time))
    return spark.createDataFrame(rows, "broken_of_100 int, has_time boolean")


@query("SELECT column_name AS feature FROM (DESCRIBE SELECT value, value * 2 AS twice, event_id % 7 AS phase FROM events) WHERE column_type IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER')")
def sequence_inputs(spark, sf_dir):
    """The columns whose history becomes features: numbers that are neither key, time nor label."""
    df = telemetry(spark, sf_dir).select("machine_id", "timestamp", "seq", "event_type", "value", (F.col("value") * 2).alias("twice"), (F.col("seq") % 7).alias("phase"), F.lit(0).alias("twf"))
    model = FeatureEngineer(Settings(timestamp="timestamp", machine="machine_id", tiebreak=("seq",)))
    return spark.createDataFrame([(c,) for c in model.sequence_sources(df)], "feature string")


@query(G + "SELECT uid, " + sql_round(*[f"coalesce({c}, (SELECT median({c}) FROM g)) AS {c}" for c in SENSORS], "process_temperature_k - air_temperature_k AS physical__temperature_gap_k") + " FROM g")
def fitted_training_rows(spark, sf_dir):
    """``fit_transform``: raw readings filled with medians, after features were derived."""
    return r6(FeatureEngineer(Settings()).fit_transform(machines_with_gaps(spark, sf_dir)).select("uid", *SENSORS, "physical__temperature_gap_k"))


@query(
    "SELECT * FROM (SELECT event_id AS seq, lag(value) OVER w AS lag__value__lag_1, " + sql_round("avg(value) OVER f AS rolling__value__mean_3")
    + " FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id), f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) WHERE seq = (SELECT event_id FROM events ORDER BY user_id DESC, ts DESC, event_id DESC LIMIT 1)"
)
def observation_by_batch(spark, sf_dir):
    """One observation after all stored rows, through the batch engine."""
    df = telemetry(spark, sf_dir).drop("event_type")
    last = df.agg(F.max(F.struct("machine_id", "timestamp", "seq")).alias("x")).first().x.seq
    settings = Settings(timestamp="timestamp", machine="machine_id", tiebreak=("seq",), lags=(1,), windows=(3,), statistics=("mean",), spans=(3,), periods=(1,), z_windows=(5,), missing_indicators=False)
    past = df.where(F.col("seq") != last)
    return r6(FeatureEngineer(settings).fit(past).online(df.where(F.col("seq") == last), past).select("seq", "lag__value__lag_1", "rolling__value__mean_3"))


@query(SPLIT + "SELECT split, count(*) AS n_rows, " + sql_round("max(torque_nm * rotational_speed_rpm) AS most_interaction", "min(process_temperature_k - air_temperature_k) AS least_gap") + " FROM p GROUP BY split")
def engineered_splits(spark, sf_dir):
    """Fit on one split and transform three, by the functional interface."""
    parts = split.stratified(machines(spark, sf_dir), "uid")
    _, frames = engineer(*[parts.where(F.col("split") == s).drop("split") for s in split.PARTS], settings=Settings(missing_indicators=False))
    out = None
    for name, frame in zip(split.PARTS, frames):
        row = frame.agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n_rows"), F.max("physical__torque_speed_interaction").alias("most_interaction"), F.min("physical__temperature_gap_k").alias("least_gap"))
        out = row if out is None else out.union(row)
    return r6(out)


@query("SELECT user_id::VARCHAR AS machine_key, count(*) AS observations, least(count(*), 128)::INTEGER AS held, round(epoch_us(max(ts)) / 1e6, 6) AS last, least(count(value), 128)::INTEGER AS values_held FROM events GROUP BY user_id")
def machine_states(spark, sf_dir):
    """What stored rows leave in each machine's state, for a warm start."""
    s = snapshots.summaries(online.states_after(arrivals(spark, sf_dir), ONLINE))
    return r6(s.select("machine_key", "observations", "held", "last", F.col("values_held")["value"].alias("values_held")))


@query("SELECT count(DISTINCT user_id) AS machines, count(*) AS observations, (SELECT max(least(n, 128)) FROM (SELECT count(*) AS n FROM events GROUP BY user_id))::INTEGER AS largest_history, round(epoch_us(max(ts)) / 1e6, 6) AS last FROM events")
def engine_state(spark, sf_dir):
    """An engine that saw the second half after a snapshot of the first, merged, in one row."""
    rows = arrivals(spark, sf_dir)
    earlier, whole = online.states_after(rows.where("seq % 2 = 0"), ONLINE), online.states_after(rows, ONLINE)
    return r6(snapshots.engine_summary(snapshots.merged(earlier, whole)))


def _histogram_sql(table: str, x: str) -> str:
    return f"SELECT least(floor(({x} - lo) * 30 / (hi - lo)), 29)::INTEGER AS bin, count(*) AS n_rows FROM {table}, (SELECT min({x}) AS lo, max({x}) AS hi FROM {table}) GROUP BY bin"


@query(M + _histogram_sql("m", "(process_temperature_k - air_temperature_k)"))
def gap_histogram(spark, sf_dir):
    return plots.histogram(machines(spark, sf_dir).withColumn("gap", F.col("process_temperature_k") - F.col("air_temperature_k")), "gap")


@query(M + _histogram_sql("m", "(torque_nm * rotational_speed_rpm)"))
def power_histogram(spark, sf_dir):
    return plots.histogram(machines(spark, sf_dir).withColumn("power", F.col("torque_nm") * F.col("rotational_speed_rpm")), "power")


@query(G + " UNION ALL ".join(f"SELECT '{c}' AS feature, bin, n_rows FROM (" + _histogram_sql(f"(SELECT {c} FROM g WHERE {c} IS NOT NULL)", c) + ")" for c in SENSORS))
def histogram_grid(spark, sf_dir):
    """Histograms of all sensors in one plan."""
    return plots.histograms(machines_with_gaps(spark, sf_dir), SENSORS).select("feature", "bin", "n_rows")


@query(G + "SELECT column_name AS feature, missing FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) - count({c}) AS missing FROM g" for c in SENSORS) + ") ORDER BY missing DESC, feature LIMIT 3")
def most_missing(spark, sf_dir):
    """The quality overview's bars: the columns that miss most."""
    table = validation.missing_summary(machines_with_gaps(spark, sf_dir).select(*SENSORS)).withColumnRenamed("column_name", "feature")
    return plots.top_rows(table, "missing", 3).select("feature", "missing")


@query(G + "SELECT feature, " + ", ".join(f"c{i}" for i in range(len(SENSORS))) + " FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, " + sql_round(*[f"CASE WHEN '{a}' = '{b}' THEN 1 ELSE corr({a}, {b}) END AS c{i}" for i, b in enumerate(SENSORS)]) + " FROM g" for a in SENSORS) + ")")
def correlation_heatmap(spark, sf_dir):
    df = machines_with_gaps(spark, sf_dir)
    matrix = quality.correlation_matrix(quality.correlation_pairs(df, SENSORS), SENSORS)
    return r6(matrix.select("feature", *[F.get("correlations", i).alias(f"c{i}") for i in range(len(SENSORS))]))


@query(
    G + f"SELECT 'fixed' AS feature, 'REMOVE_CONSTANT' AS recommendation, 'it has one value only' AS reason FROM g HAVING count(*) > 0 UNION ALL "
    "SELECT 'sparse', CASE WHEN count(*) FILTER (torque_nm < 20) < 0.7 * count(*) THEN 'IMPUTE' ELSE 'KEEP' END, CASE WHEN count(*) FILTER (torque_nm < 20) < 0.7 * count(*) THEN 'many values are missing' ELSE 'nothing stands out' END FROM g UNION ALL "
    "SELECT 'machine_failure_copy', CASE WHEN count(*) FILTER (machine_failure IS NOT NULL) = count(*) THEN 'REVIEW_LEAKAGE' END, 'it may give the target away' FROM g"
)
def recommendation_reasons(spark, sf_dir):
    table = quality.audit(_audited(spark, sf_dir), "machine_failure", ["uid"])["recommendations"]
    return table.where(F.col("feature").isin("fixed", "sparse", "machine_failure_copy"))
