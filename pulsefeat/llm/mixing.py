"""Mixing sources to target weights (DataFrame functions only).

Words are aggregated per source, targets come from a capped proportional share, and the
repetition rate of a source is ``target / size``. A document is emitted ``floor(rate)`` times, plus
once more if its hash-seeded uniform number lies below the fraction of the rate.

Defined edge cases
  * null text and empty text have size 0; a source of size 0 has target 0 and takes nothing
  * a null source is a source of its own, ranked last
  * the draw depends on the seed and ``doc_id`` only: reruns agree, repeated rows of one id share
    their draw, rows with a null id share the draw of the id "null"
  * an empty table gives an empty mix; other columns are carried along untouched
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsefeat.llm.storage import bounded_broadcast, cut

WORD = r"[^\x20\x09-\x0D]+"
DRAW_BITS = 48
#: A broadcast of rates holds at most this many sources (about 100 bytes each).
MAX_BROADCAST_SOURCES = 100_000
SALTS = 32


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """Uniform in [0, 1), the same in any engine that has md5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, DRAW_BITS // 4), 16, 10).cast("double") / F.lit(float(2**DRAW_BITS))


def source_rates(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """One row per source: ``mix_source, source_size, target, rate``.

    Sharing by weight and resharing what lies over the caps ends at ``min(cap * size, weight * level)``
    for one level. Sources sorted by ``cap * size / weight`` fill up in that order, so the level is the
    first quotient of what is left that the next source does not exceed. The windows run over one
    row per source, after documents have been aggregated.
    """
    per_source = sizes.groupBy("mix_source").agg(F.sum("mix_size").alias("source_size"))
    ranked = per_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("mix_source").asc_nulls_last())) - 1)
    choice = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", choice).withColumn("fill", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    before = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(float(cap))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / weight_left)
    level = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "place", "level"))).over(everything)["level"]
    size = F.col("source_size")
    target = F.when(level.isNull(), size * F.lit(float(cap))).otherwise(F.least(size * F.lit(float(cap)), F.col("weight") * level))
    return (
        levels.withColumn("target", target)
        .withColumn("rate", F.when(size > 0, F.col("target") / size).otherwise(F.lit(0.0)))
        .select("mix_source", "source_size", "target", "rate")
    )


def mix_plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 20240601,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Every document as ``row`` (a struct of its columns, or of those in ``carry``) with ``size,
    source_size, target, copies``. The struct keeps clashing column names apart."""
    keep = docs.columns if carry is None else carry
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row")
    sized = docs.select(row, F.col("source").alias("mix_source"), F.col("doc_id").alias("mix_id"), words(F.col("text")).alias("mix_size"))
    by_source = docs.select(F.col("source").alias("mix_source"), words(F.col("text")).alias("mix_size"))
    rates = cut(source_rates(by_source, weights, share, cap), "mix-rates").withColumnRenamed("mix_source", "rate_source")
    few = bounded_broadcast(rates, MAX_BROADCAST_SOURCES)
    same = F.col("mix_source").eqNullSafe(F.col("rate_source"))
    if few is rates:
        # Too many sources to broadcast: shuffle, with documents of a hot source dealt over SALTS keys.
        few = rates.withColumn("rate_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = sized.withColumn("mix_salt", F.pmod(F.xxhash64("mix_id"), F.lit(SALTS)).cast("int"))
        same = same & (F.col("mix_salt") == F.col("rate_salt"))
    joined = sized.join(few, same)
    whole = F.floor("rate")
    extra = (draw(F.col("mix_id"), seed) < F.col("rate") - whole).cast("long")
    return joined.select("row", F.col("mix_size").alias("size"), "source_size", "target", (whole + extra).alias("copies"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken."""
    plan = mix_plan(docs, **how).where(F.col("copies") > 0)
    return plan.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM s
), w AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r
), f AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS fill FROM w
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce((sum(source_size) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0.0::DOUBLE) * 2.0::DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM f
), t AS (
  SELECT source, source_size,
         least(source_size * 2.0::DOUBLE, weight * (SELECT level FROM l WHERE level <= fill ORDER BY fill, place LIMIT 1)) AS target
  FROM l
), x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         (('0x' || substr(md5('20240601:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 12))::BIGINT)::DOUBLE / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
