"""Splits of a table, checks of them, and the frame a model may see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefeat.functions.names import IDENTIFIERS, LABELS, TARGET
from pulsefeat.sources.shared import written

PARTS = ("train", "validation", "test")
#: Hexadecimal digits of a hash by which rows are counted in a round.
PREFIX = 3
#: Rows that one task may rank; a border prefix of more is counted by PREFIX further digits.
RANKED = 1 << 17
#: Classes up to which the cuts are broadcast.
MAX_CLASSES = 100_000


def check_sizes(sizes: Sequence[float]) -> None:
    if any(not 0 < s < 1 for s in sizes) or abs(sum(sizes) - 1) > 1e-8:
        raise ValueError(f"sizes must lie between 0 and 1 and add up to 1, not {sizes}")


def stratified(df: DataFrame, key: str, target: str = TARGET, sizes: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Adds ``split``. Rows of each class are ordered by a hash of key and seed and cut by exact shares;
    rows of one key stay together, on the side of the first of them.

    No class is sorted. Rows are counted per class and prefix of the hash; those of the prefixes in which
    the two cuts of a class fall are counted by longer prefixes, round by round, until few enough are left
    to be ranked, and the hashes at the cuts are joined to all rows. A round counts one border in PREFIX
    digits, so no task sees more than 16 ** PREFIX counts or RANKED rows of it.
    """
    check_sizes(sizes)
    # Shares in per cent, so that the borders are those of whole-number arithmetic.
    shares = round(100 * sizes[0]), round(100 * (sizes[0] + sizes[1]))
    order = F.coalesce(F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed)))), F.lit(""))
    hashed_rows = df.select(F.col(target).alias("__class"), order.alias("__order"))
    of_class = df.groupBy(F.col(target).alias("__of")).agg(F.count(F.lit(1)).alias("__rows"))
    cut = F.explode(F.array(*[F.struct(F.lit(i).alias("cut"), F.floor(F.col("__rows") * s / 100).alias("rank")) for i, s in enumerate(shares)]))
    borders = of_class.select("__of", "__rows", cut.alias("__at")).select("__of", F.lit("").alias("__in"), "__at.cut", F.col("__at.rank").alias("__rank"), "__rows").where("__rank > 0")
    digits = 0
    while True:
        borders = written(borders, "borders")
        size = borders.agg(F.count(F.lit(1)).alias("n"), F.max("__rows").alias("most")).first()
        few = size.n <= 2 * MAX_CLASSES
        near = hashed_rows.withColumn("__start", F.substring("__order", 1, digits))
        near = near.join(F.broadcast(borders) if few else borders, F.col("__class").eqNullSafe(F.col("__of")) & (F.col("__start") == F.col("__in")))
        if (size.most or 0) <= RANKED or digits >= 32:
            break
        digits += PREFIX
        counts = near.groupBy("__of", "cut", "__rank", F.substring("__order", 1, digits).alias("__next")).agg(F.count(F.lit(1)).alias("__rows"))
        upto = F.sum("__rows").over(Window.partitionBy("__of", "cut").orderBy("__next"))
        counts = counts.withColumn("__upto", upto).where((F.col("__rank") <= F.col("__upto")) & (F.col("__rank") > F.col("__upto") - F.col("__rows")))
        borders = counts.select("__of", F.col("__next").alias("__in"), "cut", (F.col("__rank") - F.col("__upto") + F.col("__rows")).alias("__rank"), "__rows")
    if digits >= 32:  # the border is a whole hash
        cuts = borders.select(F.col("__of").alias("__class"), "cut", F.col("__in").alias("__order"))
    else:
        place = F.row_number().over(Window.partitionBy("__class", "cut").orderBy("__order"))
        cuts = near.withColumn("__place", place).where("__place = __rank")
    cuts = cuts.groupBy(F.col("__class").alias("__of")).agg(*[F.max(F.when(F.col("cut") == i, F.col("__order"))).alias(f"__cut{i}") for i in (0, 1)])
    cuts = F.broadcast(cuts) if few else cuts
    joined = df.join(cuts, F.col(target).eqNullSafe(F.col("__of")), "left")
    part = F.when(order <= F.col("__cut0"), "train").when(order <= F.col("__cut1"), "validation").otherwise("test")
    return joined.withColumn("split", part).drop("__of", "__cut0", "__cut1")


def hashed(df: DataFrame, key: str, sizes: Sequence[float] = (0.70, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """Adds ``split`` by a uniform hash of the key alone; rows of one key stay together."""
    check_sizes(sizes)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(10**9)) / F.lit(1e9)
    return df.withColumn("split", F.when(u < sizes[0], "train").when(u < sizes[0] + sizes[1], "validation").otherwise("test"))


def split_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Per split: rows, missing cells and their rate, rows of class 1, positive rate."""
    columns = [c for c in df.columns if c != "split"]
    missing = sum((F.col(f"`{c}`").isNull().cast("int") for c in columns), F.lit(0))
    table = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(missing).alias("missing_cells"), F.sum(F.col(target)).cast("long").alias("positives"))
    return table.withColumns({"missing_rate": F.col("missing_cells") / (F.col("n_rows") * len(columns)), "positive_rate": F.col("positives") / F.col("n_rows")}).orderBy("split")


def overlaps(df: DataFrame, key: str) -> DataFrame:
    """``pair, shared_ids`` of the three pairs of splits, from one aggregate per id."""
    of_id = df.groupBy(F.col(key).alias("id")).agg(*[F.max((F.col("split") == p).cast("int")).alias(p) for p in PARTS])
    pairs = [("train", "validation"), ("train", "test"), ("validation", "test")]
    row = of_id.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    return row.unpivot([], [f"{a}_{b}" for a, b in pairs], "pair", "shared_ids")


def predictive_frame(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Without target, failure modes and identifiers."""
    return df.drop(*[c for c in df.columns if c in {*LABELS, *IDENTIFIERS, "machine_id", "timestamp", *extra}])


def safety_report(df: DataFrame) -> dict:
    forbidden = [c for c in df.columns if c.lower() in {*LABELS, *IDENTIFIERS}]
    return {"forbidden_columns_present": forbidden, "feature_count": len(df.columns), "passed": not forbidden}
