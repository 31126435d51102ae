"""Connected components of a graph given as a table of edges.

Alternating large and small stars: every node hands its larger (then its smaller) neighbours to the
smallest node it knows, until nothing changes. Minima are pre-aggregated before the shuffle, a round
is written to the shared folder, and neither nodes nor edges come to the driver.

Hubs. Of n edges, fewer than MAX_HUBS nodes have more than 2 n / MAX_HUBS, whatever the graph: the minima
of these are broadcast to the large star, and their edges stay where they are. The others' edges are
dealt by node, as are those of the small star, whose larger nodes have few smaller ones after a round.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.storage import cut, drop_table


MAX_HUBS = 100_000
LEAST_HUB = 1000  # edges of a node that are never worth a broadcast


def _star(edges: DataFrame, large: bool, count: int = 0) -> DataFrame:
    """``edges``: u > v, ``count`` rows. Links (node, smallest known) in the same form."""
    if large:
        sides = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"), "n")
    own = F.col("u") == F.col("at")
    if large:
        is_hub = F.col("n") > max(LEAST_HUB, 2 * count // MAX_HUBS)
        hubs = F.broadcast(least.where(is_hub))
        joined = sides.join(hubs, own, "left_anti").join(least.where(~is_hub), own).union(sides.join(hubs, own))
    else:
        joined = sides.join(least, own)
    if large:
        links = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        links = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("at").alias("u"), F.col("m").alias("v")))
    return links.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` of two integer columns; returns ``node, component`` (the smallest node reachable) for
    all nodes that have an edge to another. Nulls and loops are no edges; no edges, no rows."""
    a, b = edges.columns
    ordered = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    current = cut(ordered.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct(), "edges")
    seen, count = None, current.count()
    while True:
        following = cut(_star(_star(current, large=True, count=count), large=False), "edges")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(current)
        current, count = following, state[0]
        if state == seen or not state[0]:
            break
        seen = state
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def dealt_blocks(rows: DataFrame, group: str, item: str, shares: Column) -> DataFrame:
    """``rows`` with ``task``, ``own`` and ``cross``. ``shares``: a group's size over that of a block. A
    group of up to one block is one task; a larger one is dealt over blocks by a hash of ``item``, and
    each pair of blocks (and each block by itself) is a task. ``own`` is the row's block; ``cross`` marks
    tasks of two different blocks."""
    parts = F.ceil(shares).cast("int")
    own = F.pmod(F.xxhash64(F.lit(3), F.col(item)), parts).cast("int")
    with_own = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    pair = F.struct(F.least("own", "other"), F.greatest("own", "other"))
    return with_own.withColumn("task", F.xxhash64(group, pair)).withColumn("cross", F.col("own") != F.col("other")).drop("other")


def spanning_edges(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that connect what is connected among items 0 to n - 1. ``near(x, left)`` says which of the
    items ``left`` link to x; items already reached are not compared again."""
    edges: list[tuple[int, int]] = []
    left = np.arange(n)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            linked = near(x, left)
            reached = left[linked].tolist()
            edges += [(x, y) for y in reached]
            queue += reached
            left = left[~linked]
    return edges
