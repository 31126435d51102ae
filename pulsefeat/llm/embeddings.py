"""Embedding near-dedup with randomised-rotation binary codes.

Codes. A unit vector is turned by random orthogonal matrices; a code is the signs of its coordinates,
stored with a correction factor per rotation, the inner product of the turned vector and its code. The
inner product of a code and another turned vector, over the factor, estimates the cosine without bias;
its error has a known scale, so a pair ``SIGMAS`` deviations below the threshold is no link.

Candidates. Bands of sign bits, as many bits as grow with the logarithm of the number of vectors, put
vectors at the threshold into a common bucket with probability 1 - MISS. In a bucket, pairs whose upper
confidence bound reaches the threshold need exact recomputation; they tie vectors together into families.

Links. Families are disjoint; each is compared exactly, in double precision, in pairs of blocks of
bounded size. Only link counts per vector and connecting edges leave a task, no list of pairs. Equal
vectors are one node with a multiplicity throughout.

Defined edge cases
  * null, empty or zero vectors, null or non-finite components: linked with nothing, kept
  * vectors of different lengths never link; multiples of a vector do (cosine 1)
  * a null vec_id: no links, component_id null, kept; rows that share an id count as rows
  * an empty table gives an empty result; extra columns are not read
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.components import connected_components, dealt_blocks, spanning_edges
from pulsefeat.llm.storage import cut, small_batches
from pulsefeat.llm.wordblocks import ROLES, mix, sorted_groups

MISS = 1e-3
SIGMAS = 4.0
CODE_BITS = 256
BUCKET_BLOCK = 4096
FAMILY_BLOCK = 2048


@lru_cache(maxsize=64)
def rotation(dimension: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng([dimension, number]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def rotated(x: np.ndarray, count: int) -> np.ndarray:
    """Rows turned by ``count`` rotations: (rows, count, dimension)."""
    return np.stack([x @ rotation(x.shape[1], i) for i in range(count)], axis=1)


def prepared(vectors: DataFrame) -> DataFrame:
    """``vec_id, key, vec``: a digest and the bytes of each usable vector, nulls for the others."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def run(batches):
        for batch in batches:
            keys, raw = [], []
            for v in batch.column("embedding"):
                values = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid else np.empty(0)
                usable = len(values) and np.isfinite(values).all() and values.any() and not v.values.null_count
                raw.append((values + 0.0).astype(kind).tobytes() if usable else None)
                keys.append(hashlib.blake2b(raw[-1], digest_size=16).digest() if usable else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "vec"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, key binary, vec binary")


def units(column: pa.ChunkedArray | pa.Array, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors, in double precision, of the vectors of each length."""
    raw = column.to_pylist()
    lengths = np.array([len(r) for r in raw])
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        x = np.frombuffer(b"".join(raw[i] for i in rows), dtype=kind).reshape(len(rows), -1).astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow in the norm
        yield rows, x / np.linalg.norm(x, axis=1, keepdims=True)


def plan_bands(n: int, cosine: float) -> tuple[int, int]:
    """Bits of a band and number of bands for n vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(48, max(8, math.ceil(math.log2(max(n, 2))) + 2))
    return bits, math.ceil(math.log(MISS) / math.log(1 - agree**bits))


def coded(classes: DataFrame, kind: str, bits: int, bands: int) -> DataFrame:
    """``rep, code, factors, buckets`` of every distinct vector."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            codes, factors, buckets = [None] * n, [None] * n, [None] * n
            for rows, x in units(batch.column("vec"), kind):
                d = x.shape[1]
                turned = rotated(x, math.ceil(max(bits * bands, CODE_BITS) / d))
                signs = turned >= 0
                used = math.ceil(CODE_BITS / d)
                factor = np.abs(turned[:, :used]).sum(axis=2) / math.sqrt(d)
                packed = np.packbits(signs[:, :used].reshape(len(rows), -1), axis=1)
                weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
                own = signs.reshape(len(rows), -1)[:, : bits * bands].reshape(len(rows), bands, bits) @ weights
                own = mix(own * ROLES[0] + (np.arange(bands, dtype=np.uint64) + np.uint64(d << 32)) * ROLES[1]).view(np.int64)
                for i, row in enumerate(rows):
                    codes[row], factors[row], buckets[row] = packed[i].tobytes(), factor[i].astype("<f4").tobytes(), own[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep"), pa.array(codes, pa.binary()), pa.array(factors, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                names=["rep", "code", "factors", "buckets"],
            )

    return classes.select("rep", "vec").mapInArrow(run, "rep long, code binary, factors binary, buckets array<long>")


def deviation(factors: np.ndarray, d: int, cosine: float) -> np.ndarray:
    """Standard deviation of the estimate from each code, for vectors at the threshold.

    A code has the component ``factor`` along its vector; the rest points in a random direction, of
    which only the part of the other vector that is orthogonal to the first sees anything."""
    squared = (factors * factors).mean(axis=1)
    return np.sqrt((1 - squared) / squared / (max(d - 1, 1) * factors.shape[1]) * (1 - cosine * cosine))


def estimates(signs: np.ndarray, factors: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the cosine between each coded vector and one turned vector."""
    inner = np.einsum("lrd,rd->lr", signs, turned) / math.sqrt(turned.shape[1])
    return (inner / factors).mean(axis=1)


def _families(batches: Iterator[pa.RecordBatch], kind: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Edges that tie together the vectors of each bucket whose confidence bound reaches the threshold."""
    for group in sorted_groups(batches, "task"):
        ids = group.column("rep").to_numpy()
        for rows, x in units(group.column("vec"), kind):
            factors = np.frombuffer(b"".join(group.column("factors").to_pylist()), dtype="<f4").reshape(len(ids), -1)[rows]
            code = np.frombuffer(b"".join(group.column("code").to_pylist()), dtype=np.uint8).reshape(len(ids), -1)[rows]
            turned = rotated(x, factors.shape[1])
            signs = np.unpackbits(code, axis=1)[:, : turned[0].size].reshape(turned.shape).astype(np.float32) * 2 - 1
            least = cosine - SIGMAS * deviation(factors, x.shape[1], cosine)
            pairs = spanning_edges(len(rows), lambda i, left: estimates(signs[left], factors[left], turned[i]) >= least[left])
            at = rows[np.asarray(pairs, dtype=np.int64).reshape(-1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])


def _exact(batches: Iterator[pa.RecordBatch], kind: str, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows (a, null, n): n vectors link to a in this task; rows (a, b, 0): edges that connect."""
    for group in sorted_groups(batches, "task"):
        ids, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "own"))
        cross = group.column("cross")[0].as_py()
        for rows, x in units(group.column("vec"), kind):
            block, many, id_ = own[rows], copies[rows], ids[rows]
            linked = np.empty((len(rows), len(rows)), dtype=bool)
            for lo in range(0, len(rows), 512):
                linked[lo : lo + 512] = x[lo : lo + 512] @ x.T >= cosine
                # Within a block pairs count in the block's own task, across blocks in the pair's.
                linked[lo : lo + 512] &= (block[lo : lo + 512, None] != block) == cross
            np.fill_diagonal(linked, False)
            linked |= linked.T
            number = linked @ many
            pairs = np.array(spanning_edges(len(rows), lambda i, left: linked[i, left]), dtype=np.int64).reshape(-1, 2)
            some = np.flatnonzero(number)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([id_[some], id_[pairs[:, 0]]])),
                    pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(id_[pairs[:, 1]])]),
                    pa.array(np.concatenate([number[some], np.zeros(len(pairs), dtype=np.int64)])),
                ],
                names=["a", "b", "n"],
            )


def near_duplicates(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """Per vector ``vec_id, n_links, component_id, kept``."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    small_batches(vectors.sparkSession)
    given = cut(prepared(vectors), "vectors")
    usable = given.where(F.col("key").isNotNull() & F.col("vec_id").isNotNull())
    classes = cut(usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "classes")
    bits, bands = plan_bands(classes.count(), cosine)
    codes = cut(coded(classes, kind, bits, bands), "codes")
    entries = codes.select("rep", F.explode("buckets").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    tasks = dealt_blocks(entries.join(sizes, "bucket"), "bucket", "rep", F.col("members") / BUCKET_BLOCK).select("task", "rep")
    near = tasks.join(codes.select("rep", "code", "factors"), "rep").join(classes.select("rep", "vec"), "rep")
    loose = near.repartition("task").sortWithinPartitions("task").mapInArrow(lambda it: _families(it, kind, cosine), "a long, b long")
    families = cut(connected_components(loose), "families")
    members = families.join(families.groupBy("component").agg(F.count("*").alias("members")), "component")
    tasks = dealt_blocks(members, "component", "node", F.col("members") / FAMILY_BLOCK)
    rows = tasks.join(classes, F.col("node") == F.col("rep")).select("task", "own", "cross", "rep", "copies", "vec")
    found = cut(rows.repartition("task").sortWithinPartitions("task").mapInArrow(lambda it: _exact(it, kind, cosine), "a long, b long, n long"), "links")
    links = found.where("b IS NULL").groupBy(F.col("a").alias("linked")).agg(F.sum("n").alias("n"))
    connected = connected_components(found.where("b IS NOT NULL").select("a", "b"))
    of_class = classes.join(links, F.col("rep") == F.col("linked"), "left").join(connected, F.col("rep") == F.col("node"), "left")
    of_class = of_class.where((F.col("copies") > 1) | F.col("n").isNotNull()).select(
        F.col("key").alias("class_key"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    mine = F.col("vec_id").isNotNull()
    result = given.select("vec_id", "key").join(of_class, F.col("key") == F.col("class_key"), "left")
    result = result.select("vec_id", F.when(mine, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(mine, F.coalesce("component", "vec_id")).alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
