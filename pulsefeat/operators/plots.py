"""The data behind plots, as small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefeat.functions.safe import finite, safe_divide
from pulsefeat.operators.order import quantile_table
from pulsefeat.operators.quality import long_form


def histogram(df: DataFrame, column: str, bins: int = 30, by: str | None = None) -> DataFrame:
    """``bin, n_rows`` (and ``by``) of equal-width bins between the least and the largest value; the
    last bin holds the largest."""
    x = finite(F.col(f"`{column}`").cast("double"))
    span = df.agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"))
    with_span = df.withColumn("__x", x).where("__x IS NOT NULL").crossJoin(F.broadcast(span))
    place = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col("__x") - F.col("__lo")) * bins / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))), F.lit(bins - 1))).otherwise(0)
    keys = [F.col(by).alias(by)] if by else []
    return with_span.groupBy(*keys, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """``feature, bin, n_rows, lo, hi`` of all columns in one plan: their ends are one aggregate, and rows are
    counted per column and bin in another."""
    columns = list(columns)
    clean = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(columns)])
    ends = clean.agg(*[e.alias(f"{k}{i}") for i in range(len(columns)) for k, e in (("lo", F.min(f"x{i}")), ("hi", F.max(f"x{i}")))])
    entries = ", ".join(f"{i}, x{i}, lo{i}, hi{i}" for i in range(len(columns)))
    rows = clean.crossJoin(F.broadcast(ends)).selectExpr(f"stack({len(columns)}, {entries}) AS (of, x, lo, hi)").where("x IS NOT NULL")
    counted = rows.groupBy("of", "lo", "hi", F.expr(f"CAST(IF(hi > lo, least(floor((x - lo) * {bins} / nullif(hi - lo, 0D)), {bins - 1}), 0) AS INT) AS bin")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("of") + 1).alias("feature"), "bin", "n_rows", "lo", "hi")


def standardized_boxes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles and ends of each column in units of its deviation (divisor n - 1); constants give NULL."""
    basics = []
    for i, c in enumerate(columns):
        x = finite(F.col(f"`{c}`").cast("double"))
        basics += [F.avg(x).alias(f"mean__{i}"), F.stddev_samp(x).alias(f"std__{i}"), F.min(x).alias(f"lo__{i}"), F.max(x).alias(f"hi__{i}")]
    table = long_form(df.agg(*basics), columns, ["mean", "std", "lo", "hi"], "feature")
    clean = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])
    q = quantile_table(clean, columns, (0.25, 0.5, 0.75))
    z = lambda c: safe_divide(c - F.col("mean"), F.col("std"), 1e-300)
    return table.join(q, "feature").select("feature", z(F.col("lo")).alias("z_min"), *[z(F.get("q", i)).alias(n) for i, n in enumerate(("z_q1", "z_median", "z_q3"))], z(F.col("hi")).alias("z_max"))


def rolling_trace(df: DataFrame, column: str, machine: str, ts: str, tiebreak: Sequence[str], window: int = 10) -> DataFrame:
    """Mean and deviation (divisor n - 1) over the last rows up to the current one, from max(2, w // 2)."""
    w = Window.partitionBy(machine).orderBy(ts, *tiebreak).rowsBetween(-(window - 1), 0)
    enough = F.count(column).over(w) >= max(2, window // 2)
    return df.select(machine, ts, *tiebreak, column, F.when(enough, F.avg(column).over(w)).alias("rolling_mean"), F.when(enough, F.stddev_samp(column).over(w)).alias("rolling_std"))


def class_rates(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(F.col(target).alias("target")).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("percent", F.col("n_rows") * 100.0 / F.sum("n_rows").over(Window.partitionBy()))


def anomaly_share(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """How many values lie ``limit`` deviations or more from the mean."""
    x = finite(F.col(f"`{column}`").cast("double"))
    basics = df.agg(F.avg(x).alias("__mean"), F.stddev_samp(x).alias("__std"))
    z = safe_divide(x - F.col("__mean"), F.col("__std"))
    far = F.abs(z) >= limit
    return df.crossJoin(F.broadcast(basics)).agg(F.count(x).alias("n_values"), F.count_if(far).alias("n_anomalous"), (F.count_if(far) * 100.0 / F.nullif(F.count(x), F.lit(0))).alias("percent_anomalous"))


def sensor_trend(df: DataFrame, column: str, machine: str, ts: str, tiebreak: Sequence[str], points: int = 50, window: int = 5) -> DataFrame:
    """Evenly spaced rows of each machine, with the mean of the last ``window`` rows."""
    order = Window.partitionBy(machine).orderBy(ts, *tiebreak)
    n = F.count(F.lit(1)).over(Window.partitionBy(machine))
    numbered = df.select(machine, ts, *tiebreak, column, F.row_number().over(order).alias("place"), n.alias("n"), F.avg(column).over(order.rowsBetween(-(window - 1), 0)).alias("trend"))
    # Row k of n is shown if the k-th share of the points begins in it.
    shown = F.floor((F.col("place") * points + F.col("n") - 1) / F.col("n")) > F.floor(((F.col("place") - 1) * points + F.col("n") - 1) / F.col("n"))
    return numbered.where((F.col("n") <= points) | shown).select(machine, ts, *tiebreak, column, "trend")


def top_correlations(target_correlations: DataFrame, n: int = 10) -> DataFrame:
    return target_correlations.where("abs_correlation IS NOT NULL").orderBy(F.desc("abs_correlation"), "feature").limit(n)


def relation_sample(df: DataFrame, columns: Sequence[str], key: str, n: int = 10_000, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, those of smallest hash; a top-n, so no full sort."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n).select(*columns)


def machines_shown(df: DataFrame, machine: str, n: int = 8) -> DataFrame:
    return df.select(machine).distinct().orderBy(machine).limit(n)


def top_rows(df: DataFrame, measure: str, n: int = 20, name: str = "feature") -> DataFrame:
    """The ``n`` rows of largest measure: given feature importances, missing shares, unique ratios."""
    return df.where(F.col(measure).isNotNull()).orderBy(F.desc(measure), name).limit(n)
