"""From a path, a package or an address to a checked table in one call."""

from __future__ import annotations

import io
import urllib.request
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefeat.functions.names import LABELS, SENSORS, TARGET, leak_columns, machine_column
from pulsefeat.operators import validation
from pulsefeat.sources.ordering import Diagnostics, ordered
from pulsefeat.sources.tables import load_table, normalized

#: Fixed value: the number of the public machine-failure dataset in its repository.
UCI_NUMBER = 601


@dataclass
class Loaded:
    data: DataFrame
    mode: str
    timestamp: str | None
    machine: str | None
    warnings: list[str]
    profile: DataFrame | None = None
    diagnostics: Diagnostics | None = None


def download(url: str, timeout: float = 60) -> bytes:
    """A small file, by the driver; for tables that fit there only."""
    request = urllib.request.Request(url, headers={"User-Agent": "pulsefeat"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


def csv_in(content: bytes, prefer: str = "ai4i2020") -> bytes:
    """The content itself, or the CSV of a ZIP archive, the preferred member first."""
    if not zipfile.is_zipfile(io.BytesIO(content)):
        return content
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        members = [m for m in archive.namelist() if m.lower().endswith(".csv")]
        if not members:
            raise ValueError("no CSV in the archive")
        return archive.read(min(members, key=lambda m: (prefer not in m.lower(), m)))


def from_url(spark: SparkSession, url: str, timeout: float = 60) -> DataFrame:
    """A downloaded CSV. The rows go to Spark as text lines, so no executor needs the driver's disk."""
    lines = csv_in(download(url, timeout)).decode("utf-8-sig").splitlines()
    return spark.read.csv(spark.createDataFrame([(x,) for x in lines], "value string").rdd.map(lambda r: r[0]), header=True, inferSchema=True)


def from_package(spark: SparkSession) -> DataFrame:
    """The public dataset through its repository's package, where that is installed."""
    try:
        from ucimlrepo import fetch_ucirepo
    except ImportError as missing:
        raise RuntimeError("the package ucimlrepo isn't installed") from missing
    data = fetch_ucirepo(id=UCI_NUMBER).data
    frame = data.original if getattr(data, "original", None) is not None else data.features.join(data.targets)
    return spark.createDataFrame(frame)


def resolve(spark: SparkSession, path: str | None = None, urls: tuple[str, ...] = (), use_package: bool = True, cache: str | None = None) -> DataFrame:
    """The first source that answers: the path, the package, the addresses. ``cache``: where to keep it."""
    attempts = [("path", lambda: load_table(spark, path))] if path else []
    attempts += [("package", lambda: from_package(spark))] if use_package else []
    attempts += [(u, lambda u=u: from_url(spark, u)) for u in urls]
    failures = []
    for name, attempt in attempts:
        try:
            df = attempt()
            df.schema  # noqa: B018  a path that isn't there fails here
        except Exception as error:
            failures.append(f"{name}: {str(error).splitlines()[0]}")
            continue
        if cache and name != "path":
            df.write.mode("overwrite").option("header", True).csv(cache)
        return df
    raise ValueError("no source answers: " + "; ".join(failures))


def load_dataset(spark: SparkSession, path: str | None = None, mode: str = "auto", sort: bool = True, **sources) -> Loaded:
    """Read a table and prepare it (see ``prepared``)."""
    return prepared(resolve(spark, path, **sources), mode, sort)


def prepared(raw: DataFrame, mode: str = "auto", sort: bool = True) -> Loaded:
    """Name, drop empty rows, detect the mode, check; sensors become numbers, and a time series is put in
    order, which also gives its diagnostics. With a profile. Only a mode asked for by name needs all columns
    of the known kind; one that is found may lack some."""
    df, asked = normalized(raw), mode
    mode = validation.data_mode(df, mode)
    target = TARGET if TARGET in df.columns else None
    if problems := validation.schema_problems(df, target, ai4i=asked == "ai4i"):
        raise ValueError("; ".join(problems))
    df = validation.convert_numeric(df, [c for c in SENSORS if c in df.columns])
    timestamp, machine, diagnostics = validation.timestamp_column(df) if mode == "timeseries" else None, machine_column(df.columns), None
    if timestamp:
        df = validation.convert_timestamp(df, timestamp)
    warnings = [f"label column {c}" for c in leak_columns(df.columns) if c != target]
    if timestamp and sort:
        df, diagnostics = ordered(df, machine, timestamp)
        found = {"rows without a time": diagnostics.untimed, "rows of a machine and time seen before": diagnostics.repeated_keys, "repeated rows": diagnostics.repeated_rows}
        warnings += [f"{n} {text}" for text, n in found.items() if n]
    if mode == "ai4i":
        out_of_range = validation.range_diagnostics(df).where("violations > 0").select("column_name", "violations").collect()
        warnings += [f"{r.column_name}: {r.violations} values out of range" for r in out_of_range]
    profile = validation.profile(df, target) if target else None
    return Loaded(df, mode, timestamp, machine, warnings, profile, diagnostics)


def printed_summary(loaded: Loaded) -> str:
    """The loaded table in a few lines."""
    df = loaded.data
    n = df.agg(F.count(F.lit(1))).first()[0]
    lines = [f"{n} rows, {len(df.columns)} columns, mode {loaded.mode}", "columns: " + ", ".join(df.columns)]
    if loaded.timestamp:
        lines.append(f"time: {loaded.timestamp}, machine: {loaded.machine}")
    lines += [f"labels: {', '.join(c for c in df.columns if c in LABELS) or 'none'}", *loaded.warnings]
    return "\n".join(lines)

