"""MinHash near-dedup with fast similarity sketches.

Sketch. A set throws its elements into ``COORDINATES`` bins, round after round with a new hash; a
bin keeps its smallest value of the first round that reaches it. From round ``COORDINATES`` on, round
i throws everything into bin i - COORDINATES, so every coordinate is filled after twice as many
rounds, whatever the set. Two sets agree in a coordinate with probability equal to their Jaccard
similarity, and the agreements concentrate as those of independent coordinates do.

Candidates. Sets that agree on a band of ``ROWS`` coordinates share a bucket; ``BANDS`` bands miss a
pair of similarity 0.85 with probability 1e-6. Within a bucket, documents whose sketches agree in at
least ``threshold - SLACK`` of all coordinates (SLACK is over four standard deviations) are put into
one loose family; all links lie within families.

Verification. Within a family, full shingle sets are made again from the whole texts and compared, in
a breadth-first search that compares each document reached with those not yet reached. Families over
a number of documents or of shingles, and buckets over a number of sketches, are dealt as pairs of
blocks, each pair to a task, so no group is capped.
Documents of equal sets are one node throughout, so copies cost nothing.

Defined edge cases
  * null, empty or blank text: an empty set (n_shingles 0), linked with nothing, kept
  * fewer words than the shingle: the whole sequence is the only shingle
  * a null doc_id: linked with nothing, component_id null, kept
  * rows that share a doc_id are one document: they share their component
  * an empty table gives an empty result; extra columns are not read (``deduplicate`` carries them)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefeat.llm.components import connected_components, dealt_blocks, spanning_edges
from pulsefeat.llm.storage import bounded_broadcast, cut, small_batches
from pulsefeat.llm.wordblocks import as_bytes, chunks, mix, shingle_sets, sorted_groups, words

ROWS, BANDS = 7, 36
COORDINATES = ROWS * BANDS
SLACK = 0.10
BUCKET_BLOCK = 4096  # sketches of a bucket in one block
FAMILY_BLOCK = 1024  # documents of a family in one block
FAMILY_ELEMENTS = 1 << 20  # shingles of a family in one block, but for a longer document alone
#: Members of families are broadcast to the scan of the texts up to this count (16 bytes each).
MAX_BROADCAST_MEMBERS = 500_000


def sketches(elements: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
    """One row of COORDINATES bytes per owner, from the elements of all sets laid end to end. A byte
    stands for the round and the value its bin kept; an owner without elements has an undefined row."""
    t = COORDINATES
    empty = np.uint64(2**64 - 1)
    best = np.full(owners * t, empty, dtype=np.uint64)
    code = np.zeros(owners * t, dtype=np.uint8)
    filled = np.zeros(owners * t, dtype=bool)
    active = np.zeros(owners, dtype=bool)
    active[owner] = True
    base = owner * t
    for i in range(2 * t):
        if not len(elements):
            break
        h = mix(elements + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = h >> np.uint64(12)
        place = base + ((h & np.uint64(0xFFF)) * np.uint64(t) >> np.uint64(12)).astype(np.int64) if i < t else base + (i - t)
        np.minimum.at(best, place, value)
        fresh = (best != empty) & ~filled
        code[fresh] = (mix(best[fresh] + np.uint64(i)) & np.uint64(0xFF)).astype(np.uint8)
        filled |= fresh
        best[filled] = 0  # nothing of a later round is smaller
        open_ = active & ~filled.reshape(owners, t).all(axis=1)
        if not open_.any():
            break
        if (go_on := open_[owner]).sum() < len(owner):
            elements, owner, base = elements[go_on], owner[go_on], base[go_on]
    return code.reshape(owners, t)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, sketch``: a digest of the set and its sketch, of every document."""

    def run(batches):
        for batch in batches:
            texts = as_bytes(batch.column("text"))
            counts, keys, codes = [], [], []
            for lo, hi in chunks([len(t) for t in texts]):
                elements, owner = shingle_sets(words(texts[lo:hi], fold_case=True), k)
                sketch = sketches(elements, owner, hi - lo)
                bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
                for i in range(hi - lo):
                    own = elements[bounds[i] : bounds[i + 1]]
                    counts.append(len(own))
                    keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    codes.append(sketch[i].tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(codes, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "sketch"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sketch binary")


def _edges(ids: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = np.asarray(pairs, dtype=np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], names=["a", "b"])


def _loose(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Edges that tie together the members of each bucket whose sketches are near, transitively."""
    for group in sorted_groups(batches, "task"):
        ids = group.column("rep").to_numpy()
        code = np.frombuffer(b"".join(group.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(ids), COORDINATES)
        sizes = group.column("n_shingles").to_numpy()

        def near(x, left):
            alike = (code[left] == code[x]).mean(axis=1) >= least
            return alike & (np.minimum(sizes[left], sizes[x]) >= least * np.maximum(sizes[left], sizes[x]))

        yield _edges(ids, spanning_edges(len(ids), near))


def _verified(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Edges between documents of one family whose full sets overlap enough, as many as connect them."""
    least = percent / 100 - SLACK
    for group in sorted_groups(batches, "task"):
        if group.num_rows < 2:
            continue
        ids = group.column("doc_id").to_numpy()
        texts = as_bytes(group.column("text").combine_chunks())
        sets: list[np.ndarray] = []
        code = np.empty((len(ids), COORDINATES), dtype=np.uint8)
        for lo, hi in chunks([len(t) for t in texts]):
            elements, owner = shingle_sets(words(texts[lo:hi], fold_case=True), k)
            code[lo:hi] = sketches(elements, owner, hi - lo)
            bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
            sets += [elements[bounds[i] : bounds[i + 1]] for i in range(hi - lo)]
        sizes = np.array([len(s) for s in sets])

        def near(x, left):
            own = sets[x]
            linked = np.zeros(len(left), dtype=bool)
            if not len(own):
                return linked
            maybe = (code[left] == code[x]).mean(axis=1) >= least
            maybe &= 100 * np.minimum(sizes[left], sizes[x]) >= percent * np.maximum(sizes[left], sizes[x])
            which = np.flatnonzero(maybe)
            for lo in range(0, len(which), 256):
                some = which[lo : lo + 256]
                others = left[some]
                joined = np.concatenate([sets[y] for y in others])
                found = np.searchsorted(own, joined)
                found[found == len(own)] = 0
                common = np.add.reduceat(own[found] == joined, np.concatenate([[0], np.cumsum(sizes[others])[:-1]]), dtype=np.int64)
                linked[some] = 100 * common >= percent * (len(own) + sizes[others] - common)
            return linked

        yield _edges(ids, spanning_edges(len(ids), near))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id, kept``."""
    small_batches(docs.sparkSession)
    least = percent / 100 - SLACK
    signed = cut(signatures(docs, k), "signatures")
    nodes = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = cut(nodes.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")), "classes")
    band = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("sketch", i * ROWS + 1, F.lit(ROWS))))
    bands = classes.select("rep", F.explode(band).alias("bucket"))
    sizes = bands.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    shared = bands.join(sizes, "bucket")
    tasks = dealt_blocks(shared, "bucket", "rep", F.col("members") / BUCKET_BLOCK).select("task", "rep")
    near = tasks.join(classes.select("rep", "n_shingles", "sketch"), "rep")
    loose = near.repartition("task").sortWithinPartitions("task").mapInArrow(lambda it: _loose(it, least), "a long, b long")
    families = cut(connected_components(loose), "families")
    sized = families.join(classes.select("rep", "n_shingles"), F.col("node") == F.col("rep"))
    totals = sized.groupBy("component").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("elements"))
    shares = F.greatest(F.col("members") / FAMILY_BLOCK, F.col("elements") / FAMILY_ELEMENTS)
    tasks = dealt_blocks(families.join(totals, "component"), "component", "node", shares).select("task", "node")
    few = bounded_broadcast(tasks, MAX_BROADCAST_MEMBERS)
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(few, F.col("doc_id") == F.col("node")).select("task", "doc_id", "text")
    links = texts.repartition("task").sortWithinPartitions("task").mapInArrow(lambda it: _verified(it, k, percent), "a long, b long")
    linked = connected_components(links)
    of_class = classes.join(linked, F.col("rep") == F.col("node"), "left").where((F.col("copies") > 1) | F.col("node").isNotNull())
    of_class = of_class.select("set_key", F.coalesce("component", "rep").alias("component"))
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(of_class, "set_key", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), component))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )


def own_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__own``: the doc_id, but where an id has several texts a hash of both, over 2 ** 62."""
    own = F.col("doc_id").cast("long")
    texts = docs.select(own.alias("__shared"), F.xxhash64("text").alias("k")).where("__shared IS NOT NULL")
    shared = cut(texts.groupBy("__shared").agg((F.min("k") < F.max("k")).alias("several")).where("several").select("__shared"), "shared-ids")
    marked = docs.join(bounded_broadcast(shared, MAX_BROADCAST_MEMBERS), own == F.col("__shared"), "left")
    hashed = F.shiftrightunsigned(F.xxhash64("__shared", F.coalesce("text", F.lit("")), F.col("text").isNull()), 2) + F.lit(1 << 62)
    return marked.withColumn("__own", F.when(F.col("__shared").isNull(), own).otherwise(hashed)).drop("__shared")


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: all but the documents that a smaller doc_id stands for. Rows that share
    an id but not a text are documents of their own, after all others in the order of ids."""
    own = own_ids(docs)
    judged = near_duplicates(own.select(F.col("__own").alias("doc_id"), "text"), k, percent)
    out = cut(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return own.join(out, F.col("__own") == F.col("__gone"), "left_anti").select(*[f"`{c}`" for c in docs.columns])
