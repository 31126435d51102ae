"""Centroid clustering of integer vectors with exponion search.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to
any other. A round moves the bounds by as much as centroids moved; a vector whose upper bound stays below
is left alone. Others measure their own centroid and, if that isn't enough, the centroids in a ball of
radius 2 u + s around it (u the measured distance, s the distance to the next centroid), read off lists of
centroids sorted by distance from each; the ball holds the two nearest centroids whatever the vector. Its
radius is inclusive and bounds are rounded away from a decision, so ties are always compared in whole
numbers and go to the smaller centroid number.

A round reads and writes the table of vectors with their bounds in the shared folder, without a shuffle;
only vectors that changed their centroid are added to and taken from the sums, per task and then per
(centroid, component). What comes to the driver are the centroids, a size given by parameters.

Defined edge cases
  * vectors of another length, null vectors, null or non-finite components: not kept, no row
  * components beyond the range in which squared distances fit a long (2 ** 27 for 64 components, after
    scaling) count as the end of that range
  * rows that share an id count each; a null vec_id never starts a centroid, but is assigned
  * equal start hashes (repeated ids): the smaller components first; fewer vectors than centroids: fewer
    centroids; an empty table gives an empty result; extra columns are not read
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.storage import cut, drop_table

SLACK = 1e-9  # relative rounding of bounds, far above that of a double
STATE = "vec_id long, point binary, cluster int, was int, upper double, lower double"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
MOST = 2**63 - 1


def component_limit(dimension: int) -> int:
    """Largest component for which a squared distance is below 2 ** 62."""
    return math.isqrt(2**62 // dimension) // 2


def kept_points(vectors: DataFrame, dimension: int, scale: int) -> DataFrame:
    """``vec_id, point``: whole-number components, as little-endian 32-bit integers."""
    limit = min(component_limit(dimension), 2**31 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
            rows = np.flatnonzero(valid & (np.diff(offsets) == dimension))
            x = values[offsets[rows][:, None] + np.arange(dimension)]
            good = np.isfinite(x).all(axis=1)
            with np.errstate(over="ignore"):
                points = np.clip(np.floor(x[good] * scale), -limit, limit).astype("<i4")
            ids = batch.column("vec_id").take(pa.array(rows[good]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([p.tobytes() for p in points], pa.binary())], names=["vec_id", "point"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "vec_id long, point binary")


def as_matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i4").reshape(-1, dimension).astype(np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``x`` to every row of ``c``."""
    largest = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * largest * largest < 2**53:  # every step is a whole number that a double holds
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
    out = np.empty((len(x), len(c)), dtype=np.int64)
    for j, row in enumerate(c):
        step = x - row
        out[:, j] = (step * step).sum(axis=1)
    return out


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


@dataclass(frozen=True)
class Centroids:
    """Centroids with, for each, all of them in order of distance from it (itself first)."""

    points: np.ndarray
    order: np.ndarray
    distances: np.ndarray  # in that order, rounded down

    @classmethod
    def of(cls, points: np.ndarray) -> Centroids:
        between = np.sqrt(squared(points, points).astype(np.float64))
        np.fill_diagonal(between, -1.0)  # a centroid comes first in its own list, before equal ones
        order = np.argsort(between, axis=1, kind="stable")
        return cls(points, order, down(np.maximum(np.take_along_axis(between, order, axis=1), 0.0)))

    def next_distance(self) -> np.ndarray:
        """Rounded-down distance from each centroid to the next one."""
        return self.distances[:, 1] if len(self.points) > 1 else np.full(1, np.inf)

    def two_nearest(self, x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Among the centroids ``numbers``: the nearest (the smaller number at ties), its squared distance
        and the squared distance of the second nearest."""
        numbers = np.sort(numbers)
        d = squared(x, self.points[numbers])
        best = d.argmin(axis=1)
        rows = np.arange(len(x))
        least = d[rows, best]
        if len(numbers) == 1:
            return numbers[best], least, np.full(len(x), np.inf)
        d[rows, best] = MOST
        return numbers[best], least, d.min(axis=1).astype(np.float64)


def exponion(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, now: Centroids, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Assignments and bounds after centroids moved by ``moved``; also how many distances were measured."""
    far = np.argsort(moved)[::-1]
    others = np.where(own == far[0], moved[far[1]] if len(moved) > 1 else 0.0, moved[far[0]])
    own, upper, lower = own.copy(), up(upper + moved[own]), down(np.maximum(lower - up(others), 0.0))
    safe = np.maximum(lower, down(now.next_distance()[own] / 2))
    open_ = np.flatnonzero(~(upper < safe))
    exact = x[open_] - now.points[own[open_]]
    upper[open_] = up(np.sqrt((exact * exact).sum(axis=1).astype(np.float64)))
    measured = len(open_)
    open_ = open_[~(upper[open_] < safe[open_])]
    if len(now.points) == 1 or not len(open_):
        return own, upper, lower, measured
    radius = up(2 * upper[open_] + up(up(now.next_distance()[own[open_]])))
    reach = np.empty(len(open_), dtype=np.int64)
    for a in np.unique(own[open_]):
        mine = own[open_] == a
        reach[mine] = np.searchsorted(now.distances[a], radius[mine], side="right")
    # Rounded up to a power of two, so that few groups of vectors scan the same centroids.
    reach = np.minimum(2 ** np.ceil(np.log2(np.maximum(reach, 2))).astype(np.int64), len(now.points))
    groups = own[open_].astype(np.int64) * (len(now.points) + 1) + reach
    by_group = np.argsort(groups, kind="stable")
    for rows in np.split(by_group, np.flatnonzero(np.diff(groups[by_group])) + 1):
        at = open_[rows]
        nearest, least, second = now.two_nearest(x[at], now.order[own[at[0]], : reach[rows[0]]])
        own[at], upper[at], lower[at] = nearest, up(np.sqrt(least.astype(np.float64))), down(np.sqrt(second))
        measured += len(at) * int(reach[rows[0]])
    return own, upper, lower, measured


def first_assignment(points: DataFrame, start: Centroids) -> DataFrame:
    dimension = start.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, least, second = start.two_nearest(as_matrix(batch.column("point"), dimension), np.arange(len(start.points)))
            bounds = [up(np.sqrt(least.astype(np.float64))), down(np.sqrt(second))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("point"), pa.array(own, pa.int32()), pa.array(np.full(len(own), -1), pa.int32()), *map(pa.array, bounds)],
                names=["vec_id", "point", "cluster", "was", "upper", "lower"],
            )

    return points.mapInArrow(run, STATE)


def next_assignment(state: DataFrame, before: Centroids, now: Centroids) -> DataFrame:
    dimension = now.points.shape[1]
    step = (now.points - before.points).astype(np.float64)
    moved = up(np.sqrt((step * step).sum(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            was, upper, lower = (batch.column(c).to_numpy() for c in ("cluster", "upper", "lower"))
            own, upper, lower, _ = exponion(as_matrix(batch.column("point"), dimension), was, upper, lower, now, moved)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("point"), pa.array(own, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), pa.array(lower)],
                names=["vec_id", "point", "cluster", "was", "upper", "lower"],
            )

    return state.mapInArrow(run, STATE)


def change_of_sums(state: DataFrame, k: int, dimension: int) -> tuple[list[int], list[list[int]]]:
    """What the vectors that changed their centroid add to counts and component sums; ``k * (dimension +
    1)`` numbers, added up per task and then per (centroid, component)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, dimension + 1), dtype=np.int64)
        for batch in batches:
            x = as_matrix(batch.column("point"), dimension)
            x = np.concatenate([np.ones((len(x), 1), dtype=np.int64), x], axis=1)
            for name, sign in (("cluster", 1), ("was", -1)):
                of = batch.column(name).to_numpy()
                order = np.argsort(of, kind="stable")
                first = np.flatnonzero(np.diff(of[order], prepend=-2))
                if len(first):
                    total = np.add.reduceat(x[order], first, axis=0)
                    known = of[order][first] >= 0
                    sums[of[order][first][known]] += sign * total[known]
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], names=["i", "j", "n"])

    changed = state.where("cluster <> was").select("point", "cluster", "was")
    counts, sums = [0] * k, [[0] * dimension for _ in range(k)]
    for row in changed.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect():
        if row.j:
            sums[row.i][row.j - 1] = int(row.n)
        else:
            counts[row.i] = int(row.n)
    return counts, sums


def distances(state: DataFrame, now: Centroids) -> DataFrame:
    dimension = now.points.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("cluster").to_numpy()
            step = as_matrix(batch.column("point"), dimension) - now.points[own]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array((step * step).sum(axis=1))], names=["vec_id", "cluster", "distance"])

    return state.select("vec_id", "point", "cluster").mapInArrow(run, "vec_id long, cluster int, distance long")


def start_points(points: DataFrame, k: int, salt: str, dimension: int) -> np.ndarray:
    """The k vectors with the smallest hashes of their ids, in order of hash."""
    hashed = points.where("vec_id IS NOT NULL").select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256).alias("hash"), "point")
    texts = hashed.select("hash", "point").orderBy("hash", "point").limit(k).collect()
    return np.array([np.frombuffer(r.point, dtype="<i4") for r in texts], dtype=np.int64).reshape(-1, dimension)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """Per kept vector ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    spark = vectors.sparkSession
    points = cut(kept_points(vectors, dimension, scale), "points")
    start = start_points(points, k, salt, dimension)
    if not len(start):
        return spark.createDataFrame([], RESULT)
    now = Centroids.of(start)
    state = cut(first_assignment(points, now), "clusters")
    drop_table(points)
    counts, sums = [0] * len(start), [[0] * dimension for _ in start]
    for _ in range(rounds):
        more, added = change_of_sums(state, len(start), dimension)
        counts = [a + b for a, b in zip(counts, more)]
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, added)]
        means = np.array([[s // n for s in total] if n else list(old) for n, total, old in zip(counts, sums, now.points)], dtype=np.int64)
        if (means == now.points).all():
            break  # nothing moves any more in the rounds left
        before, now = now, Centroids.of(means)
        following = cut(next_assignment(state, before, now), "clusters")
        drop_table(state)
        state = following
    found = cut(distances(state, now), "distances")
    drop_table(state)
    by_cluster = {r.cluster: int(r.total) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    inertia = min(sum(by_cluster.values()), MOST)
    rows = [(i, min(n, MOST), hashlib.sha256(",".join(map(str, now.points[i].tolist())).encode()).hexdigest()) for i, n in by_cluster.items()]
    of_cluster = spark.createDataFrame(rows, "number int, cluster_inertia long, centroid_sha256 string")  # a row per centroid
    joined = found.join(F.broadcast(of_cluster), F.col("cluster") == F.col("number"))
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "centroid_sha256")


def oracle_sql(k: int = 8, rounds: int = 10, dimension: int = 64, scale: int = 1024, salt: str = "3:") -> str:
    """Plain rounds over all centroids, one pair of table expressions each."""
    limit = component_limit(dimension)
    square = "list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: greatest(least(floor({scale} * x::DOUBLE), {limit}), -{limit})::BIGINT) AS p FROM embeddings WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, p) - 1 AS j, p FROM (SELECT sha256('{salt}' || vec_id) AS h, p FROM v WHERE vec_id IS NOT NULL ORDER BY h, p LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT v.rid, c.j, {square} AS d FROM v CROSS JOIN c{r} c) GROUP BY rid)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT a.j, i, sum(v.p[i]) AS s, count(*) AS n FROM a{r} a JOIN v USING (rid) CROSS JOIN range(1, {dimension + 1}) t(i) GROUP BY a.j, i)")
            steps.append(f"m{r} AS (SELECT j, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS p FROM s{r} GROUP BY j)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN m{r} m USING (j))")
    last = f"SELECT v.vec_id, a.j::INTEGER AS cluster, a.d::BIGINT AS distance, sum(a.d) OVER (PARTITION BY a.j)::BIGINT AS cluster_inertia, sum(a.d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (rid) JOIN c{rounds} c USING (j)"
    return f"WITH {', '.join(steps)} {last}"
