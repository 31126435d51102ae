"""Machine-shaped views of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``machine_id, timestamp, seq, event_type, value``: a sensor reading per event."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id AS machine_id", "ts AS timestamp", "event_id AS seq", "event_type", "value")


AI4I_COLUMNS = [
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), cast(cast(round(l_extendedprice * 100) as bigint) as string)) AS uid",
    "CASE l_returnflag WHEN 'N' THEN 'L' WHEN 'R' THEN 'M' ELSE 'H' END AS type",
    "295 + 100 * l_discount AS air_temperature_k",
    "304 + 100 * l_tax AS process_temperature_k",
    "1200 + l_extendedprice / 100 AS rotational_speed_rpm",
    "l_quantity AS torque_nm",
    "cast(l_partkey % 254 as double) AS tool_wear_min",
    "CASE WHEN l_linestatus = 'F' AND l_quantity > 45 THEN 1 ELSE 0 END AS machine_failure",
]
#: The same view for DuckDB.
AI4I_SQL = "SELECT " + ", ".join(AI4I_COLUMNS).replace(" as string)", " as varchar)") + " FROM lineitem"


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cross-sectional table of machine states, from ``lineitem``."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(*AI4I_COLUMNS)


def machines_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``machines`` with some readings missing, by rule."""
    return machines(spark, sf_dir).selectExpr(*GAP_COLUMNS)


GAP_COLUMNS = [
    "uid", "type",
    "CASE WHEN tool_wear_min % 17 <> 0 THEN air_temperature_k END AS air_temperature_k",
    "process_temperature_k",
    "CASE WHEN tool_wear_min % 23 <> 0 THEN rotational_speed_rpm END AS rotational_speed_rpm",
    "CASE WHEN torque_nm <> 13 THEN torque_nm END AS torque_nm",
    "tool_wear_min", "machine_failure",
]
GAP_SQL = "SELECT " + ", ".join(GAP_COLUMNS) + f" FROM ({AI4I_SQL})"
