"""Files in and out: CSV with byte-order marks and encodings, Parquet, JSON summaries."""

from __future__ import annotations

import json
import math
from datetime import date, datetime
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefeat.functions.names import canonical_names


def detected_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 if all lines of the files are, else Latin-1, from one scan of their bytes. FileNotFoundError
    for a path that isn't there, ValueError for files without a line or that can't be read."""
    try:
        row = spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.count_if(~F.is_valid_utf8("value")).alias("bad")).first()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or "") or "does not exist" in str(error):
            raise FileNotFoundError(f"there is no {path}") from error
        raise ValueError(f"{path} can't be read as text") from error
    if not row.lines:
        raise ValueError(f"{path} is empty")
    return "ISO-8859-1" if row.bad else "UTF-8"


def load_csv(spark: SparkSession, path: str, encoding: str | None = None, infer: bool = True) -> DataFrame:
    """A CSV with a header, in the encoding given or found in its bytes. A byte-order mark before the first
    name goes; a file without rows is an error."""
    encoding = encoding or detected_encoding(spark, path)
    df = spark.read.csv(path, header=True, inferSchema=infer, encoding=encoding)
    df = df.toDF(*[c.replace("\ufeff", "").replace("ï»¿", "") for c in df.columns])
    if df.isEmpty():
        raise ValueError(f"{path} has no rows")
    return df


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, ORC, JSON or CSV by the path's ending."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return load_csv(spark, path)
    return spark.read.format(kind if kind in ("orc", "json") else "parquet").load(path)


def normalized(df: DataFrame, snake: bool = False) -> DataFrame:
    """Canonical column names, those of unknown columns in snake case if asked for; rows that are null
    throughout are dropped."""
    return df.toDF(*canonical_names(df.columns, snake)).na.drop("all")


def save_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def save_tables(tables: dict[str, DataFrame], folder: str, prefix: str, kind: str = "csv") -> dict[str, str]:
    """Each table under ``folder/prefix_name``; returns the paths."""
    paths = {name: f"{folder.rstrip('/')}/{prefix}_{name}" for name in tables}
    for name, df in tables.items():
        save_table(df, paths[name], kind)
    return paths


def json_safe(value: Any) -> Any:
    """Plain JSON values; NaN and infinities become null, dates ISO strings."""
    if isinstance(value, dict):
        return {str(k): json_safe(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [json_safe(v) for v in value]
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def save_json(spark: SparkSession, value: Any, path: str) -> None:
    """One small JSON document, through Spark's writer, so any store that Spark writes will do."""
    text = json.dumps(json_safe(value), indent=2, ensure_ascii=False)
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])
