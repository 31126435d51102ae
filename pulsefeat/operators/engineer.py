"""Fit and transform: which features a training split has, and what is learned from it.

``fit`` learns medians, means and deviations of numeric inputs, the maximal wear, whether time is real,
and which derived columns are constant or duplicates; all in aggregates over the training rows.
``transform`` applies the same plan to any split; it is lazy, but that it counts the rows of the longest
sequence, and writes a table whose sequences are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.functions.names import IDENTIFIERS, LABELS, SENSORS, TARGET
from pulsefeat.functions.safe import EPSILON, finite, numeric
from pulsefeat.operators import families as fam
from pulsefeat.operators.order import exact_quantiles

NUMERIC = ("double", "float", "int", "bigint", "smallint", "tinyint")
PARSED_SHARE = 0.95


@dataclass(frozen=True)
class Settings:
    timestamp: str | None = None
    machine: str | None = None
    tiebreak: tuple[str, ...] = ()
    lags: tuple[int, ...] = fam.LAGS
    windows: tuple[int, ...] = fam.WINDOWS
    statistics: tuple[str, ...] = fam.STATISTICS
    spans: tuple[int, ...] = fam.SPANS
    periods: tuple[int, ...] = fam.PERIODS
    z_windows: tuple[int, ...] = fam.Z_WINDOWS
    z_limit: float = fam.Z_LIMIT
    missing_indicators: bool = True
    keep_identifiers: bool = True
    parity_wear: bool = True
    chunk_rows: int | None = None  # rows of a chunk of a long sequence; None: by its length, 0: never cut

    def __post_init__(self) -> None:
        for name in ("lags", "windows", "spans", "periods", "z_windows"):
            values = getattr(self, name)
            if not values or any(not isinstance(v, int) or v <= 0 for v in values):
                raise ValueError(f"{name} must be positive whole numbers, not {values}")
        if not set(self.statistics) <= set(fam.STATISTICS):
            raise ValueError(f"statistics must be among {fam.STATISTICS}")
        if self.z_limit <= 0:
            raise ValueError("z_limit must be positive")


@dataclass
class Learned:
    """What a fit has learned; plain values that JSON can hold."""

    inputs: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    max_wear: float | None = None
    has_time: bool = False
    constant: list[str] = field(default_factory=list)
    duplicate: list[str] = field(default_factory=list)
    retained: list[str] = field(default_factory=list)


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in NUMERIC or kind.startswith("decimal")]


def constant_columns(df: DataFrame, columns: Sequence[str], exempt: Sequence[str] = (TARGET,)) -> list[str]:
    """Columns with one value or none, nulls counting as a value; found in one aggregate."""
    columns = [c for c in columns if c not in exempt]
    if not columns:
        return []
    # Two values differ if the smallest and the largest do; no distinct count is needed.
    tests = [((F.min(f"`{c}`").eqNullSafe(F.max(f"`{c}`"))) & ((F.count(f"`{c}`") == 0) | (F.count(f"`{c}`") == F.count(F.lit(1))))).alias(f"c{i}") for i, c in enumerate(columns)]
    row = df.agg(*tests).first()
    return [c for c, same in zip(columns, row) if same]


def duplicate_columns(df: DataFrame, columns: Sequence[str], row_key: Sequence[str]) -> list[tuple[str, str]]:
    """(kept, duplicate) pairs of equal columns. Order-free fingerprints bound to the rows' keys find
    candidates in one aggregate; a second one confirms them value by value."""
    kinds = dict(df.dtypes)
    prints = [F.sum(F.xxhash64(*row_key, F.col(f"`{c}`"), F.col(f"`{c}`").isNull()).cast("decimal(38,0)")).alias(f"c{i}") for i, c in enumerate(columns)]
    if not prints:
        return []
    row = df.agg(*prints).first()
    first: dict[tuple, str] = {}
    pairs = []
    for c, value in zip(columns, row):
        kept = first.setdefault((kinds[c], value), c)
        if kept != c:
            pairs.append((kept, c))
    if not pairs:
        return []
    differ = df.agg(*[F.count_if(~F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for p, n in zip(pairs, differ) if n == 0]


class FeatureEngineer:
    """``fit(train)`` then ``transform(split)``. ``extra`` adds families of one's own: functions from a
    prepared DataFrame to a list of features."""

    def __init__(self, settings: Settings | None = None, extra: Sequence[Callable[[DataFrame], list[fam.Feature]]] = ()):
        self.settings = settings or Settings()
        self.extra = list(extra)
        self.learned: Learned | None = None
        self.features: list[fam.Feature] = []

    # --- plan ---
    def prepare(self, df: DataFrame) -> DataFrame:
        """Sensors as finite doubles, timestamps parsed; order is left to the windows."""
        if len(set(df.columns)) < len(df.columns):
            raise ValueError("column names repeat")
        s = self.settings
        kinds = dict(df.dtypes)
        out = []
        for c in df.columns:
            column = F.col(f"`{c}`")
            if c in SENSORS:
                column = numeric(column)
            elif kinds[c] in ("double", "float"):
                column = finite(column)
            elif c == s.timestamp and kinds[c] == "string":
                column = column.try_cast("timestamp")
            out.append(column.alias(c))
        return df.select(*out)

    def sequence_sources(self, df: DataFrame) -> list[str]:
        skip = {*LABELS, *IDENTIFIERS, self.settings.timestamp, self.settings.machine, *self.settings.tiebreak}
        known = [c for c in SENSORS if c in df.columns]
        return known + [c for c in numeric_columns(df) if c not in skip and c not in known and "__" not in c]

    def generate(self, df: DataFrame, has_time: bool, max_wear: float | None) -> DataFrame:
        s = self.settings
        inputs = self.sequence_sources(df)
        features: list[fam.Feature] = []
        if s.missing_indicators:
            features += fam.missingness(df, exclude=[c for c in (s.timestamp, s.machine, *s.tiebreak) if c])
        if has_time:
            features += fam.calendar(s.timestamp) + fam.cyclical(s.timestamp)
        features += fam.physical(df) + fam.tool_wear(df, None if s.parity_wear else max_wear) + fam.differences(df) + fam.ratios(df) + fam.interactions(df) + fam.operating(df)
        for more in self.extra:
            features += more(df)
        out = fam.add(fam.with_top_wear(df) if s.parity_wear else df, features).drop(fam.TOP_WEAR)
        if has_time:
            out = fam.elapsed(out, s.timestamp, s.machine, s.tiebreak)
            features.append(fam.Feature("time__elapsed_seconds", "time", (s.timestamp,), "elapsed", F.col("time__elapsed_seconds")))
            past = lambda w: [f for c in inputs for f in fam.lag(c, w, s.lags) + fam.rolling(c, w, s.windows, s.statistics) + fam.rate_of_change(c, w, s.periods) + fam.anomaly(c, w, s.z_windows, s.z_limit)]
            reach = max(*s.lags, *s.windows, *s.periods, *s.z_windows)
            out, made = fam.with_history(out, s.machine, s.timestamp, s.tiebreak, past, reach, inputs, s.spans, s.chunk_rows)
            features += made
        self.features = features
        return fam.cleaned(out, features)

    # --- fit ---
    def fit(self, train: DataFrame) -> FeatureEngineer:
        s = self.settings
        df = self.prepare(train)
        if df.isEmpty():
            raise ValueError("nothing to fit: no rows")
        numbers = [c for c in numeric_columns(df) if c not in s.tiebreak]
        statistics = []
        for i, c in enumerate(numbers):
            column = F.col(f"`{c}`").cast("double")
            statistics += [F.avg(column).alias(f"a{i}"), F.stddev_pop(column).alias(f"d{i}")]
        statistics += [F.count(F.lit(1)).alias("rows"), F.count(F.col(s.timestamp) if s.timestamp else F.lit(None)).alias("timed")]
        row = df.agg(*statistics).first()
        medians = exact_quantiles(df, numbers, [0.5])
        learned = Learned(inputs=df.columns)
        for i, c in enumerate(numbers):
            if medians[c] is not None:
                learned.medians[c], learned.means[c] = medians[c][0], row[f"a{i}"]
                learned.deviations[c] = row[f"d{i}"] if row[f"d{i}"] > EPSILON else 1.0
        learned.has_time = bool(s.timestamp) and s.timestamp.lower() not in ("uid", "udi") and row["timed"] >= PARSED_SHARE * row["rows"]
        if "tool_wear_min" in numbers:
            learned.max_wear = df.agg(F.max("tool_wear_min")).first()[0]
        matrix = self.generate(df, learned.has_time, learned.max_wear)
        context = {c for c in (s.timestamp, s.machine, *s.tiebreak) if c} | {*IDENTIFIERS, *LABELS}
        candidates = [c for c in matrix.columns if c not in context]
        learned.constant = constant_columns(matrix, candidates)
        key = [f"`{c}`" for c in df.columns]
        learned.duplicate = [b for _, b in duplicate_columns(matrix, [c for c in candidates if c not in learned.constant], key)]
        gone = {*learned.constant, *learned.duplicate}
        learned.retained = [c for c in candidates if c not in gone]
        self.learned = learned
        return self

    def context_columns(self) -> list[str]:
        s, inputs = self.settings, self.learned.inputs
        identifiers = [c for c in IDENTIFIERS if c in inputs] if s.keep_identifiers else []
        return [*identifiers, *[c for c in (s.machine, s.timestamp, *s.tiebreak) if c and c in inputs], *[c for c in LABELS if c in inputs]]

    def transform(self, split: DataFrame) -> DataFrame:
        """Context columns first, then the retained features in fitted order; columns that the split
        lacks are NULL, raw numeric inputs are filled with the training medians after derivation."""
        if self.learned is None:
            raise RuntimeError("fit first")
        learned = self.learned
        df = self.prepare(split)
        missing = [c for c in learned.inputs if c not in df.columns]
        df = df.select("*", *[F.lit(None).cast("double" if c in learned.medians or c in SENSORS else "string").alias(c) for c in missing])
        matrix = self.generate(df, learned.has_time, learned.max_wear)
        fill = {c: m for c, m in learned.medians.items() if c in matrix.columns and c not in (TARGET, self.settings.timestamp)}
        matrix = matrix.fillna(fill)
        wanted = self.context_columns() + [c for c in learned.retained if c not in self.context_columns()]
        return matrix.select(*[F.col(f"`{c}`") if c in matrix.columns else F.lit(None).cast("double").alias(c) for c in wanted])

    def fit_transform(self, train: DataFrame) -> DataFrame:
        return self.fit(train).transform(train)

    def online(self, observation: DataFrame, past: DataFrame) -> DataFrame:
        """Features of the last row, in (machine, time) order, of history and observation together."""
        s = self.settings
        both = past.unionByName(observation, allowMissingColumns=True)
        order = [F.col(c).desc_nulls_first() for c in (s.machine, s.timestamp, *s.tiebreak) if c]
        return self.transform(both).orderBy(*order).limit(1)

    # --- state ---
    def state(self) -> dict:
        return {"settings": asdict(self.settings), "learned": asdict(self.learned) if self.learned else None}

    @classmethod
    def from_state(cls, state: dict) -> FeatureEngineer:
        settings = {k: tuple(v) if isinstance(v, list) else v for k, v in state["settings"].items()}
        out = cls(Settings(**settings))
        out.learned = Learned(**state["learned"]) if state["learned"] else None
        return out

    def leaks(self) -> dict:
        """Whether a feature is a label, is named after one or is derived from one."""
        names = set(self.learned.retained) if self.learned else {f.name for f in self.features}
        exact = sorted(names & set(LABELS))
        named = sorted(n for n in names if any(part in LABELS for part in n.split("__")) and n not in exact)
        derived = sorted(f.name for f in self.features if set(f.sources) & set(LABELS) and f.name in names)
        return {"exact": exact, "named": named, "derived": derived, "passed": not (exact or named or derived)}


def group_counts(metadata: DataFrame) -> DataFrame:
    return metadata.groupBy("feature_group").agg(F.count(F.lit(1)).alias("features")).orderBy(F.desc("features"), "feature_group")


def engineer(train: DataFrame, *others: DataFrame, settings: Settings | None = None) -> tuple[FeatureEngineer, list[DataFrame]]:
    """Fit on train, transform train and the other splits; raises if a label leaks into the features."""
    model = FeatureEngineer(settings).fit(train)
    frames = [model.transform(x) for x in (train, *others)]
    leaks = model.leaks()
    if not leaks["passed"]:
        raise ValueError(f"labels leak into features: {leaks}")
    return model, frames
