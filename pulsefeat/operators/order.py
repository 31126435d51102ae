"""Exact order statistics of columns of any length in three scans.

The first scan keeps a mergeable quantile sketch per column, whose error bound gives a bracket around each
wanted rank. The second counts what lies below each bracket, one row of counts. The third counts each value
within the brackets, a few thousandths of the values or a few that are frequent; the running sum over these is
the rank. No column is sorted and only values within brackets become rows of an aggregate; a scan is one job, and
what comes to the driver are a few numbers per column and share.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefeat.functions.safe import finite

#: Accuracy of the sketches: ranks are known to one part in BINS of the values.
BINS = 4096
#: Columns of one scan; a sketch of each is in a task's memory.
GROUP = 16


@dataclass
class _Place:
    """A wanted share of a column: its bracket and what is below that."""

    column: int
    rank: float
    lo: float
    hi: float
    below: int = 0

    def inside(self, x: str) -> str:
        return f"{x} BETWEEN {_number(self.lo)} AND {_number(self.hi)}"


def _brackets(clean: DataFrame, n_columns: int, shares: Sequence[float]) -> list[list[_Place]]:
    """Per column with values its places, in order of shares."""
    reach = 3 / BINS  # three times the sketch's error
    near = [min(max(s + side * reach, 0.0), 1.0) for s in shares for side in (-1, 1)]
    measures = [F.expr(e) for i in range(n_columns) for e in (f"count(x{i}) AS n{i}", f"min(x{i}) AS a{i}", f"max(x{i}) AS b{i}")]
    row = clean.agg(*measures, *[F.percentile_approx(f"x{i}", near, BINS).alias(f"p{i}") for i in range(n_columns)]).first()
    out = []
    for i in range(n_columns):
        n, least, most, ends = (row[f"{k}{i}"] for k in "nabp")
        few = n < 4 * BINS  # few values are a bracket as a whole
        out.append([_Place(i, s * (n - 1), least if few or s <= reach else ends[2 * j], most if few or s + reach >= 1 else ends[2 * j + 1]) for j, s in enumerate(shares)] if n else [])
    return out


def _case(cases: Sequence[str]) -> str:
    return f"CASE of {' '.join(f'WHEN {i} THEN {c}' for i, c in enumerate(cases))} END"


def _number(x: float) -> str:
    return f"{float(x)!r}D"


def _count(clean: DataFrame, columns: list[list[_Place]]) -> None:
    """Fill in what is below each bracket."""
    places = [p for some in columns for p in some]
    for place, n in zip(places, clean.agg(*[F.count_if(F.expr(f"x{p.column} < {_number(p.lo)}")) for p in places]).first()):
        place.below = n


def _values(values: DataFrame, columns: list[list[_Place]]) -> dict[tuple[int, int], float]:
    """The interpolated quantile of every place."""
    some = values.where(_case([" OR ".join(p.inside("x") for p in places) or "false" for places in columns]))
    # Equal values are one row before they are dealt to their places.
    counted = some.groupBy("of", "x").agg(F.count(F.lit(1)).alias("rows"))
    at = _case([f"array_compact(array({', '.join(f'IF({p.inside("x")}, {j}, NULL)' for j, p in enumerate(places)) or 'CAST(NULL AS INT)'}))" for places in columns])
    near = counted.selectExpr("of", "x", "rows", f"explode({at}) AS at")
    of_place = lambda get: _case(["CASE at " + " ".join(f"WHEN {j} THEN {get(p)}" for j, p in enumerate(places)) + " END" if places else "NULL" for places in columns])
    upto = Window.partitionBy("of", "at").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    placed = near.withColumn("earlier", F.coalesce(F.sum("rows").over(upto), F.lit(0))).withColumns({"start": F.expr(f"{of_place(lambda p: f'{p.below}L')} + earlier"), "rank": F.expr(of_place(lambda p: _number(p.rank)))})
    at_rank = "max(CASE WHEN {r} >= start AND {r} < start + rows THEN x END)"
    found = placed.groupBy("of", "at").agg(F.expr(at_rank.format(r="floor(rank)")).alias("p"), F.expr(at_rank.format(r="ceil(rank)")).alias("q")).collect()
    out = {}
    for row in found:
        rank = columns[row.of][row.at].rank
        if row.p is None or row.q is None:
            raise RuntimeError("a quantile sketch is off by more than its bound")
        out[row.of, row.at] = row.p + (row.q - row.p) * (rank - math.floor(rank))
    return out


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float] | None]:
    """Exact quantiles of finite values with linear interpolation between neighbours; None for columns without any."""
    ordered, out = sorted({float(s) for s in shares}), {}
    for lo in range(0, len(columns), GROUP):
        some = list(columns)[lo : lo + GROUP]
        clean = df.select(*[finite(F.col(f"`{c}`").cast("double")).alias(f"x{i}") for i, c in enumerate(some)])
        places = _brackets(clean, len(some), ordered)
        found = {}
        if any(places):
            values = clean.selectExpr(f"stack({len(some)}, " + ", ".join(f"{i}, x{i}" for i in range(len(some))) + ") AS (of, x)").where("x IS NOT NULL")
            _count(clean, places)
            found = _values(values, places)
        for i, c in enumerate(some):
            out[c] = [found[i, ordered.index(float(s))] for s in shares] if places[i] else None
    return out


def quantile_table(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """``feature, q`` (an array of exact quantiles, NULL for columns without values)."""
    found = exact_quantiles(df, columns, shares)
    return df.sparkSession.createDataFrame([(c, found[c]) for c in columns], "feature string, q array<double>")
