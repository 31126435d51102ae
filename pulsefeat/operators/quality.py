"""Quality audit of a feature table: statistics, duplicates, correlations, outliers, leakage, advice.

A table's statistics are aggregates turned into a row per column with ``stack``; nothing but such
summaries is collected. Tables are lazy, but for exact quantiles (three scans of the columns) and the search
for equal columns, which run when a table that needs them is built.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefeat.functions.safe import finite
from pulsefeat.operators.order import quantile_table
from pulsefeat.operators.engineer import duplicate_columns, numeric_columns
from pulsefeat.operators.validation import long_form

MISSING, NEAR_CONSTANT, HIGH_CORRELATION, TARGET_CORRELATION, UNIQUE_RATIO = 0.30, 0.995, 0.95, 0.80, 0.98
LEAK_CORRELATION = 0.99


def skewness(c: Column) -> Column:
    """Bias-corrected; NULL under three values and for constants."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.var_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def _finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(c) for c in columns])


def numeric_inputs(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [c for c in numeric_columns(df) if c not in set(exclude)]


def unpivoted(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).unpivot([], list(columns), "feature", "value")


#: A frequent-items sketch of so many counters surely holds every value with a share of HEAVY of the rows.
COUNTERS, HEAVY = 4096, 1e-3


def top_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, top_share``: the most frequent value's share of rows, nulls counting as a value. Mergeable
    frequent-items sketches find the candidates, a second pass counts these, so that no row per distinct
    value is shuffled; columns without a value of HEAVY of the rows are counted value by value."""
    columns, spark = list(columns), df.sparkSession
    clean = _finite(df, columns).toDF(*[f"x{i}" for i in range(len(columns))])
    if not columns:
        return spark.createDataFrame([], "feature string, top_share double")
    row = clean.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(x{i}, {round(1 / HEAVY)}, {COUNTERS})").alias(f"k{i}") for i in range(len(columns))]).first()
    found = [(i, item.item) for i in range(len(columns)) for item in row[f"k{i}"] or []]
    stacked = clean.selectExpr(f"stack({len(columns)}, " + ", ".join(f"{i}, x{i}" for i in range(len(columns))) + ") AS (of, x)")
    best: dict[int, int] = {}
    if found:
        candidates = F.broadcast(spark.createDataFrame(found, "number int, value double"))  # 1 / HEAVY values a column at most
        counted = stacked.join(candidates, (F.col("of") == F.col("number")) & F.col("x").eqNullSafe(F.col("value"))).groupBy("of", "x").count()
        best = {r.of: r.n for r in counted.groupBy("of").agg(F.max("count").alias("n")).collect()}
    sure = [(columns[i], n / row.n) for i, n in best.items() if n >= HEAVY * row.n]
    table = spark.createDataFrame(sure, "feature string, top_share double")
    light = [i for i in range(len(columns)) if best.get(i, 0) < HEAVY * row.n]
    if not light or not row.n:
        return table
    counts = stacked.where(F.col("of").isin(light)).groupBy("of", "x").count().groupBy("of").agg((F.max("count") / row.n).alias("top_share"))
    return table.union(counts.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("of") + 1), "top_share"))


def near_constants(df: DataFrame, limit: float = NEAR_CONSTANT, exclude: Sequence[str] = ()) -> DataFrame:
    """``feature, top_share`` of the columns whose most frequent value has ``limit`` of the rows, but not all."""
    columns = numeric_inputs(df, exclude)
    clean = _finite(df, columns)
    same = clean.agg(*[F.coalesce(F.min(f"`{c}`") == F.max(f"`{c}`"), F.lit(True)).alias(f"same__{i}") for i, c in enumerate(columns)])
    return top_shares(clean, columns).join(long_form(same, columns, ["same"], "feature"), "feature").where(~F.col("same") & (F.col("top_share") >= limit)).select("feature", "top_share")


def value_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, n_unique, top_share``: distinct values and the most frequent one's share of rows,
    nulls counting as a value for the share. Counts are pre-aggregated per value."""
    counts = unpivoted(df, columns).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg(F.count("value").alias("n_unique"), (F.max("n") / F.sum("n")).alias("top_share"))


def feature_statistics(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """The profile of every numeric column. Infinities are counted first and then treated as missing."""
    columns = numeric_inputs(df, exclude)
    aggregates = []
    for i, c in enumerate(columns):
        raw = F.col(f"`{c}`").cast("double")
        x = finite(raw)
        measures = {
            "n_rows": F.count(F.lit(1)), "non_null": F.count(x), "infinite": F.count_if(F.abs(raw) == float("inf")),
            "mean": F.avg(x), "std": F.stddev_samp(x), "variance": F.var_samp(x), "min": F.min(x), "max": F.max(x), "skew": skewness(x),
            "zeros": F.count_if(x == 0), "negatives": F.count_if(x < 0), "positives": F.count_if(x > 0),
        }
        aggregates += [m.alias(f"{k}__{i}") for k, m in measures.items()]
    table = long_form(df.agg(*aggregates), columns, ["n_rows", "non_null", "infinite", "mean", "std", "variance", "min", "max", "skew", "zeros", "negatives", "positives"], "feature")
    clean = _finite(df, columns)
    q = quantile_table(clean, columns, (0.25, 0.5, 0.75)).select("feature", *[F.get("q", i).alias(n) for i, n in enumerate(("q1", "median", "q3"))])
    table = table.join(q, "feature").join(value_shares(clean, columns), "feature")
    rows = F.nullif(F.col("n_rows"), F.lit(0))
    return table.withColumns(
        {
            "missing": F.col("n_rows") - F.col("non_null"),
            "missing_ratio": (F.col("n_rows") - F.col("non_null")) / rows,
            "unique_ratio": F.col("n_unique") / F.nullif(F.col("non_null"), F.lit(0)),
            "iqr": F.col("q3") - F.col("q1"),
            "is_constant": F.col("n_unique") <= 1,
            "is_near_constant": F.col("top_share") >= NEAR_CONSTANT,
            "possible_identifier": F.coalesce(F.col("n_unique") / F.nullif(F.col("non_null"), F.lit(0)) >= UNIQUE_RATIO, F.lit(False)) & (F.col("n_unique") > 10),
        }
    )


def missing_features(statistics: DataFrame, limit: float = MISSING) -> DataFrame:
    return statistics.where(F.col("missing_ratio") > limit).select("feature", "missing", "missing_ratio")


def constant_features(statistics: DataFrame) -> DataFrame:
    return statistics.where("is_constant").select("feature")


def near_constant_features(statistics: DataFrame) -> DataFrame:
    return statistics.where("is_near_constant AND NOT is_constant").select("feature", "top_share")


def identifier_like(statistics: DataFrame) -> DataFrame:
    return statistics.where("possible_identifier").select("feature", "n_unique", "unique_ratio")


def duplicate_pairs(df: DataFrame, row_key: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """``kept, duplicate``: all pairs of equal columns, from the groups that fingerprints found."""
    columns = [c for c in df.columns if c not in {*exclude, *row_key}]
    groups: dict[str, list[str]] = {}
    for kept, other in duplicate_columns(df, columns, [f"`{c}`" for c in row_key]):
        groups.setdefault(kept, [kept]).append(other)
    rows = [(g[i], g[j]) for g in groups.values() for i in range(len(g)) for j in range(i + 1, len(g))]
    return df.sparkSession.createDataFrame(rows, "kept string, duplicate string")


def infinite_values(df: DataFrame) -> DataFrame:
    columns = numeric_inputs(df)
    inf = float("inf")
    aggregates = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggregates += [F.count_if(x == inf).alias(f"positive__{i}"), F.count_if(x == -inf).alias(f"negative__{i}")]
    return long_form(df.agg(*aggregates), columns, ["positive", "negative"], "feature").where("positive + negative > 0")


#: Columns of a tile; a worker holds six matrices of two tiles at most, whatever the number of columns.
TILE = 256
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tile_sums(clean: DataFrame, left: Sequence[int], right: Sequence[int]) -> DataFrame:
    """Per partition and pair of columns of two tiles, the sums of a correlation over rows that have both."""
    both = sorted({*left, *right})
    # About the means, so that squares don't swallow small deviations.
    some = clean.select(*[f"x{i}" for i in both])
    centre = np.array([v or 0.0 for v in some.agg(*[F.avg(f"x{i}") for i in both]).first()])
    a, b = [both.index(i) for i in left], [both.index(i) for i in right]

    def partial(batches):
        total = None
        for batch in batches:
            z = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(both))]).astype(float) - centre
            known = (~np.isnan(z)).astype(float)
            z = np.nan_to_num(z)
            x, y, m, k = z[:, a], z[:, b], known[:, a], known[:, b]
            sums = (m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y)
            if total is None:
                total = list(sums)
            else:
                for old, new in zip(total, sums):
                    old += new
        for row, i in enumerate(left if total is not None else ()):
            use = [c for c, j in enumerate(right) if j > i]
            if use:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(use), pa.int32()), pa.array([right[c] for c in use], pa.int32()), *[pa.array(v[row, use]) for v in total]], names=["i", "j", *SUMS])

    return some.mapInArrow(partial, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS))


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature_a, feature_b, n, correlation`` of every pair of columns over rows where both have a
    value. Columns are cut into tiles; each pair of tiles is a scan of their columns alone, in which
    partitions add up products with matrix arithmetic. The partial sums, a row per pair, are combined by an
    aggregate."""
    columns = list(columns)
    clean = _finite(df, columns).toDF(*[f"x{i}" for i in range(len(columns))])
    tiles = [range(lo, min(lo + TILE, len(columns))) for lo in range(0, len(columns), TILE)]
    parts = [_tile_sums(clean, tiles[t], tiles[u]) for t in range(len(tiles)) for u in range(t, len(tiles))]
    if not parts:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, n long, correlation double")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    total = rows.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r = F.when((F.col("n") > 1) & (vx > 1e-12 * F.col("sxx")) & (vy > 1e-12 * F.col("syy")), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))
    names = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(columns)), "k int, name string"))  # a row per column
    named = total.where("n > 0").join(names.select(F.col("k").alias("i"), F.col("name").alias("feature_a")), "i").join(names.select(F.col("k").alias("j"), F.col("name").alias("feature_b")), "j")
    return named.select("feature_a", "feature_b", F.col("n").cast("long").alias("n"), r.alias("correlation"))


def correlation_matrix(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``feature, correlations``: a heat map's rows in order of ``columns``, 1 on the diagonal, NULL where
    there is no correlation; from the pairs, a row per column."""
    columns = list(columns)
    sides = pairs.select(F.col("feature_a").alias("feature"), F.col("feature_b").alias("other"), "correlation").union(pairs.select("feature_b", "feature_a", "correlation"))
    by_name = sides.groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("other", "correlation"))).alias("of"))
    spark = pairs.sparkSession
    named = spark.createDataFrame(list(enumerate(columns)), "place int, name string").join(by_name, F.col("name") == F.col("feature"), "left")
    order = F.broadcast(spark.createDataFrame([(columns,)], "names array<string>"))
    value = F.transform("names", lambda c: F.when(c == F.col("name"), F.lit(1.0)).otherwise(F.col("of")[c]))
    return named.crossJoin(order).orderBy("place").select(F.col("name").alias("feature"), value.alias("correlations"))


def high_correlations(pairs: DataFrame, limit: float = HIGH_CORRELATION) -> DataFrame:
    return pairs.where(F.abs("correlation") >= limit).withColumn("abs_correlation", F.abs("correlation")).orderBy(F.desc("abs_correlation"), "feature_a", "feature_b")


def guarded_corr(a: Column, b: Column) -> Column:
    """Pearson's r over pairs; NULL if fewer than two or if a side doesn't vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    covariance, spread = F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(varies, covariance / F.nullif(spread, F.lit(0.0)))


def target_correlations(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    columns = numeric_inputs(df, [target, *exclude])
    y = F.col(target).cast("double")
    row = df.agg(*[guarded_corr(finite(F.col(f"`{c}`").cast("double")), y).alias(f"correlation__{i}") for i, c in enumerate(columns)])
    table = long_form(row, columns, ["correlation"], "feature")
    return table.withColumn("abs_correlation", F.abs("correlation")).orderBy(F.desc_nulls_last("abs_correlation"), "feature")


def distribution_summary(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    names = ["feature", "non_null", "mean", "std", "min", "q1", "median", "q3", "max", "iqr", "skew", "zeros", "negatives", "positives"]
    return feature_statistics(df, exclude).select(*names).orderBy("feature")


def iqr_outliers(df: DataFrame, multiplier: float = 1.5, exclude: Sequence[str] = ()) -> DataFrame:
    """Values beyond the fences, per column. The quartiles are an aggregate of one row per column and
    are broadcast to the counting pass."""
    columns = numeric_inputs(df, exclude)
    clean = _finite(df, columns)
    q = quantile_table(clean, columns, (0.25, 0.75)).select("feature", F.get("q", 0).alias("q1"), F.get("q", 1).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    fences = q.withColumns({"lower": F.col("q1") - multiplier * iqr, "upper": F.col("q3") + multiplier * iqr})
    marked = unpivoted(clean, columns).where("value IS NOT NULL").join(F.broadcast(fences), "feature")
    counts = marked.groupBy("feature", "lower", "upper").agg(F.count_if(F.col("value") < F.col("lower")).alias("below"), F.count_if(F.col("value") > F.col("upper")).alias("above"), F.count(F.lit(1)).alias("valid"))
    return counts.withColumn("outlier_ratio", (F.col("below") + F.col("above")) / F.col("valid")).orderBy(F.desc("outlier_ratio"), "feature")


def bare(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch not in "_- ")


def leakage_report(df: DataFrame, target: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns that carry the target's name, copy it or correlate with it almost fully, with reasons."""
    columns = numeric_inputs(df, [target, *exclude])
    y = F.col(target).cast("double")
    aggregates = []
    for i, c in enumerate(columns):
        x = finite(F.col(f"`{c}`").cast("double"))
        aggregates += [(F.count_if(~x.eqNullSafe(y)) == 0).alias(f"is_copy__{i}"), guarded_corr(x, y).alias(f"correlation__{i}")]
    table = long_form(df.agg(*aggregates), columns, ["is_copy", "correlation"], "feature")
    named = [c for c in columns if bare(c) in bare(target) or bare(target) in bare(c)]
    table = table.withColumns({"has_name": F.col("feature").isin(named) if named else F.lit(False), "is_high": F.coalesce(F.abs("correlation") >= LEAK_CORRELATION, F.lit(False))})
    reasons = F.array_join(F.filter(F.array(F.when(F.col("has_name"), "named like the target"), F.when(F.col("is_copy"), "copies the target"), F.when(F.col("is_high"), "correlates almost fully")), lambda x: x.isNotNull()), "; ")
    return table.where("has_name OR is_copy OR is_high").withColumn("reason", reasons).orderBy(F.desc("has_name"), F.desc("is_copy"), F.desc("is_high"), "feature")


def recommendations(statistics: DataFrame, leaks: DataFrame, high: DataFrame, to_target: DataFrame) -> DataFrame:
    """``feature, recommendation, reason``: the first rule that holds."""
    flagged = leaks.select("feature", F.lit(True).alias("leaks"))
    pairs = high.select(F.col("feature_a").alias("feature")).union(high.select("feature_b")).distinct().withColumn("paired", F.lit(True))
    table = statistics.join(flagged, "feature", "left").join(pairs, "feature", "left").join(to_target.select("feature", "abs_correlation"), "feature", "left")
    # The labels.
    rules = [
        (F.col("is_constant"), "REMOVE_CONSTANT", "it has one value only"),
        (F.col("leaks"), "REVIEW_LEAKAGE", "it may give the target away"),
        (F.col("missing_ratio") > MISSING, "IMPUTE", "many values are missing"),
        (F.col("possible_identifier"), "REVIEW_IDENTIFIER", "almost every value is another"),
        (F.col("is_near_constant"), "REVIEW", "almost all rows have one value"),
        (F.col("paired"), "REVIEW", "it says almost the same as another feature"),
        (F.col("abs_correlation") >= TARGET_CORRELATION, "REVIEW", "it goes strongly with the target"),
    ]
    label, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for rule, name, text in rules:
        label, reason = label.when(rule, name), reason.when(rule, text)
    return table.select("feature", label.otherwise("KEEP").alias("recommendation"), reason.otherwise("nothing stands out").alias("reason")).orderBy("feature")


def check_input(df: DataFrame, target: str | None = None, name: str = "table") -> None:
    """TypeError for what is no DataFrame, ValueError for one without rows, with names that repeat or
    without the target."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name} must be a Spark DataFrame, not {type(df).__name__}")
    if len(set(df.columns)) < len(df.columns):
        raise ValueError(f"column names of {name} repeat")
    if target is not None and target not in df.columns:
        raise ValueError(f"{name} has no column {target}")
    if df.isEmpty():
        raise ValueError(f"{name} has no rows")


def audit(df: DataFrame, target: str, row_key: Sequence[str], exclude: Sequence[str] = (), only: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """The eleven tables of an audit, or those of them named in ``only``. ``row_key`` names columns that identify a row."""
    check_input(df, target)
    skip = [target, *row_key, *exclude]
    statistics = feature_statistics(df, skip)
    columns = numeric_inputs(df, skip)
    pairs = correlation_pairs(df, columns)
    high, to_target, leaks = high_correlations(pairs), target_correlations(df, target, [*row_key, *exclude]), leakage_report(df, target, [*row_key, *exclude])
    tables = {
        "statistics": lambda: statistics,
        "missing": lambda: missing_features(statistics),
        "constant": lambda: constant_features(statistics),
        "near_constant": lambda: near_constant_features(statistics),
        "duplicates": lambda: duplicate_pairs(df, row_key, [target, *exclude]),
        "infinite": lambda: infinite_values(df),
        "high_correlations": lambda: high,
        "target_correlations": lambda: to_target,
        "outliers": lambda: iqr_outliers(df, exclude=skip),
        "leakage": lambda: leaks,
        "recommendations": lambda: recommendations(statistics, leaks, high, to_target),
    }
    return {name: table() for name, table in tables.items() if only is None or name in only}


def summary(statistics: DataFrame, recommended: DataFrame, duplicates: DataFrame) -> DataFrame:
    """``metric, value``: an audit in nine numbers, from its tables."""
    s = statistics.agg(
        F.max("n_rows").alias("rows"), F.count(F.lit(1)).alias("features"), F.sum("missing").alias("missing_cells"), F.sum("infinite").alias("infinite_cells"),
        F.count_if(F.col("is_constant")).alias("constant_features"), F.count_if(F.col("is_near_constant") & ~F.col("is_constant")).alias("near_constant_features"), F.count_if(F.col("possible_identifier")).alias("identifier_like_features"),
    )
    r = recommended.agg(F.count_if(F.col("recommendation") == "KEEP").alias("kept_features"))
    pairs = duplicates.agg(F.count(F.lit(1)).alias("duplicate_pairs"))
    wide = s.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(pairs))
    return wide.select(*[F.col(c).cast("double").alias(c) for c in wide.columns]).unpivot([], wide.columns, "metric", "value")
