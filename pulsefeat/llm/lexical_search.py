"""Ranked lexical search with hierarchical max trees over document ranges.

Index. Texts are read once, whole. Each block of up to BLOCK_DOCUMENTS neighbouring documents becomes one
row: ids, lengths in terms, and the postings of the queries' terms, by term and document. The rows are
written to the shared folder; no posting is shuffled. Document counts, lengths and document frequencies
are aggregates over these rows.

Search. In a block every term has a tree of maxima of its score over ranges of documents: leaves of
LEAF documents, FANOUT nodes under one. A query starts at the block's root with the sum of its terms'
maxima and always opens the range with the highest summed bound; in a leaf, documents are scored in
whole numbers. A range whose bound is below the k-th best score is never opened; one whose bound is equal
to it is, as ties are settled by id. The best k of a query stay from block to block of a task, so that
later blocks are mostly closed at their roots. A task hands on k rows for a query, and the best of these
are found in two steps.

Queries are taken in blocks whose terms and bytes are bounded (QUERY_ROWS, QUERY_BYTES), each against all
documents; a block's terms are what goes to the tasks.

Defined edge cases
  * null or empty texts, texts without a term: count for nothing and are never found
  * a query without terms, or whose terms occur nowhere: no rows; a term counts once for a query
  * query rows that share an id are one query with the terms of all; a null id is a query of its own
  * documents that share an id are ranked as rows of their own; a null doc_id comes after all ids in ties
  * empty tables give an empty result; extra columns are not read
"""

from __future__ import annotations

import heapq
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefeat.llm.storage import cut, drop_table, small_batches

BLOCK_DOCUMENTS = 4096
LEAF = 64
FANOUT = 8
QUERY_ROWS = 2000
QUERY_BYTES = 1 << 20
SEGMENT = 1 << 20
SALTS = 64

#: Bytes of UTF-8 that no term has become spaces; A-Z are lower-cased.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

INDEX = "ids array<long>, known array<boolean>, lengths array<long>, terms array<int>, ends array<int>, at array<int>, tf array<long>"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a segment at a time; segments end between terms."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > SEGMENT:
            gap = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]").search(text, at + SEGMENT)
            end = gap.start() if gap else end
        yield text[at:end].translate(FOLD).split()
        at = end


def term_counts(text: bytes, wanted: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms, and occurrences of the wanted ones by their number."""
    n, found = 0, Counter()
    for part in terms_of(text):
        n += len(part)
        found.update(t for t in part if t in wanted)
    return n, {wanted[t]: c for t, c in found.items()}


class _Block:
    """A block of documents in the making."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths, self.terms, self.at, self.tf = array("q"), array("q"), array("q"), array("q")

    def add(self, doc_id: int | None, n: int, found: dict[int, int]) -> None:
        self.terms.extend(found)
        self.tf.extend(found.values())
        self.at.extend([len(self.ids)] * len(found))
        self.ids.append(doc_id)
        self.lengths.append(n)

    def row(self) -> pa.RecordBatch:
        order = np.argsort(np.frombuffer(self.terms, dtype=np.int64), kind="stable")  # documents stay in order
        terms, first = np.unique(np.frombuffer(self.terms, dtype=np.int64)[order], return_index=True)
        ends = np.append(first[1:], len(order))[: len(terms)]
        columns = {
            "ids": ([i or 0 for i in self.ids], pa.int64()), "known": ([i is not None for i in self.ids], pa.bool_()), "lengths": (np.frombuffer(self.lengths, dtype=np.int64), pa.int64()),
            "terms": (terms, pa.int32()), "ends": (ends, pa.int32()), "at": (np.frombuffer(self.at, dtype=np.int64)[order], pa.int32()), "tf": (np.frombuffer(self.tf, dtype=np.int64)[order], pa.int64()),
        }
        return pa.RecordBatch.from_arrays([pa.array([values], pa.list_(kind)) for values, kind in columns.values()], names=list(columns))


def index_blocks(documents: DataFrame, wanted: dict[bytes, int]) -> DataFrame:
    """Blocks of documents with the postings of the wanted terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary())):
                n, found = term_counts(text.as_py() or b"", wanted)
                if n:
                    block.add(doc_id, n, found)
                if len(block.ids) == BLOCK_DOCUMENTS:
                    yield block.row()
                    block = _Block()
        if block.ids:
            yield block.row()

    small_batches(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def collection_statistics(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the document frequency of each of the queries' terms."""
    row = index.agg(F.sum(F.size("lengths").cast("long")).alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("l")).first()
    count = F.transform("terms", lambda t, i: F.struct(t.alias("term"), (F.element_at("ends", i + 1) - F.when(i > 0, F.get("ends", i - 1)).otherwise(0)).alias("n")))
    frequency = index.select(F.inline(count)).groupBy("term").agg(F.sum(F.col("n").cast("long")).alias("df"))
    return row.n or 0, row.l or 0, {r.term: r.df for r in frequency.collect()}  # a row per term of the query block


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def length_factors(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document, in whole numbers."""
    if 90 * n * int(lengths.max(initial=0)) < 2**63:
        return 10 + 90 * lengths * n // total
    return np.array([10 + 90 * int(x) * n // total for x in lengths], dtype=np.int64)


class BlockTrees:
    """The postings of a block, scored, with a tree of maxima per term."""

    def __init__(self, row: dict, weights: np.ndarray, n: int, total: int):
        self.ids, self.known = np.asarray(row["ids"], dtype=np.int64), np.asarray(row["known"], dtype=bool)
        self.terms = np.asarray(row["terms"], dtype=np.int64)
        ends, self.at, tf = (np.asarray(row[k], dtype=np.int64) for k in ("ends", "at", "tf"))
        m = length_factors(np.asarray(row["lengths"], dtype=np.int64), n, total)
        counts = np.diff(ends, prepend=0)
        of = np.repeat(np.arange(len(self.terms)), counts)
        self.score = weights[self.terms][of] * (1_000_000_000 * tf // (1000 * tf + 8 * m[self.at]))
        leaves = -(-len(self.ids) // LEAF)
        # Postings of a term are in order of documents, so those of a (term, leaf) are neighbours.
        self.leaf_at = np.searchsorted(of * leaves + self.at // LEAF, np.arange(len(self.terms) * leaves + 1)).astype(np.int32)
        self.leaves = leaves
        level = np.zeros(len(self.terms) * leaves, dtype=np.int64)
        some = np.flatnonzero(np.diff(self.leaf_at))
        if len(some):
            level[some] = np.maximum.reduceat(self.score, self.leaf_at[some])
        self.levels = [level.reshape(len(self.terms), leaves)]
        while self.levels[-1].shape[1] > 1:
            below = self.levels[-1]
            starts = np.arange(0, below.shape[1], FANOUT)
            self.levels.append(np.maximum.reduceat(below, starts, axis=1))

    def root_bounds(self, queries: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
        """For each query, the rows of its terms in this block and the sum of their maxima."""
        root = self.levels[-1][:, 0]
        rows = []
        for q in queries:
            place = np.searchsorted(self.terms, q)
            place[place == len(self.terms)] = 0
            rows.append(place[self.terms[place] == q] if len(self.terms) else place[:0])
        return rows, [int(root[r].sum()) for r in rows]

    def leaf_scores(self, rows: np.ndarray, leaf: int) -> np.ndarray:
        scores = np.zeros(LEAF, dtype=np.int64)
        for r in (rows * self.leaves + leaf).tolist():
            lo, hi = self.leaf_at[r], self.leaf_at[r + 1]
            scores[self.at[lo:hi] - leaf * LEAF] += self.score[lo:hi]  # a document occurs once per term
        return scores

    def search(self, rows: np.ndarray, bound: int, best: list[tuple], k: int, seen: list[int]) -> None:
        """Add this block's documents to ``best``, a heap of (score, id is known, -id, -arrival) of k at most."""
        open_ = [(-bound, len(self.levels) - 1, 0)]
        while open_:
            bound, level, node = heapq.heappop(open_)
            if -bound <= 0 or (len(best) == k and -bound < best[0][0]):
                return  # all ranges left are bounded by this one
            if level:
                lo = node * FANOUT
                below = self.levels[level - 1][rows, lo : lo + FANOUT].sum(axis=0).tolist()
                for i, b in enumerate(below):
                    if b > 0 and (len(best) < k or b >= best[0][0]):
                        heapq.heappush(open_, (-b, level - 1, lo + i))
                continue
            scores = self.leaf_scores(rows, node)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= max(least, 1)).tolist():
                seen[0] += 1
                at = node * LEAF + i
                entry = (int(scores[i]), bool(self.known[at]), -int(self.ids[at]), -seen[0])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)


def block_winners(index: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """``query, doc_id, score``: the best k of each query in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]
        seen = [0]
        for batch in batches:
            for i in range(batch.num_rows):
                trees = BlockTrees({c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in batch.schema.names}, weights, n, total)
                rows, bounds = trees.root_bounds(queries)
                for q, (r, b) in enumerate(zip(rows, bounds)):
                    if b > 0 and (len(best[q]) < k or b >= best[q][0][0]):
                        trees.search(r, b, best[q], k, seen)
        found = [(q, -i if known else None, s) for q, heap in enumerate(best) for s, known, i, _ in heap]
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query int, doc_id long, score long")


def query_blocks(items: DataFrame, item: str) -> Iterator[dict]:
    """Terms of the queries by id, in blocks of bounded rows and bytes. Rows of one id are in one block."""
    keyed = items.select(F.col(item).alias("item"), F.col("text")).where("text IS NOT NULL")
    sized = keyed.groupBy("item").agg(F.sum(F.octet_length("text") + 64).alias("bytes"))
    total = sized.agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).first()
    parts = max(1, math.ceil((total.n or 0) / QUERY_ROWS), math.ceil((total.b or 0) / QUERY_BYTES))
    for part in range(parts):
        queries: dict = {}
        for row in keyed.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toLocalIterator():
            queries.setdefault(row.item, set()).update(t for ts in terms_of(row.text.encode()) for t in ts)
        if queries:
            yield queries


def ranked(winners: DataFrame, k: int) -> DataFrame:
    """The best k rows of a query, first per salt, then over all."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    salted = winners.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 10, item: str = "item_id") -> DataFrame:
    """Per item its k best documents: ``item_id, rank, doc_id, score``."""
    spark = documents.sparkSession
    kind = items.schema[item].dataType
    result = None
    for queries in query_blocks(items, item):
        wanted = {t: i for i, t in enumerate(sorted(set().union(*queries.values())))}
        index = cut(index_blocks(documents, wanted), "lexical")
        n, total, df = collection_statistics(index)
        weights = np.array([weight(n, df.get(i, 0)) for i in range(len(wanted))], dtype=np.int64)
        numbers = [np.array(sorted(wanted[t] for t in terms), dtype=np.int64) for terms in queries.values()]
        names = spark.createDataFrame([(i, name) for i, name in enumerate(queries)], f"number int, item_id {kind.simpleString()}")  # QUERY_ROWS rows or so
        # What is shuffled are k rows at most for each (task, query).
        best = ranked(block_winners(index, numbers, weights, n, total, k), k).join(F.broadcast(names), F.col("query") == F.col("number"))
        best = cut(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        drop_table(index)
        result = best if result is None else result.union(best)
    return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long") if result is None else result


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, {_TERMS} AS terms FROM documents WHERE text IS NOT NULL),
sized AS (SELECT row_id, doc_id, terms, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sized),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE text IS NOT NULL),
tf AS (SELECT row_id, term, count(*)::BIGINT AS tf FROM (SELECT row_id, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM q) GROUP BY row_id, term),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf CROSS JOIN totals GROUP BY term, n_docs),
m AS (SELECT row_id, doc_id, 10 + ((90 * n * n_docs) // n_terms) AS m FROM sized CROSS JOIN totals),
scores AS (SELECT q.item_id, m.doc_id, sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * m.m)))::BIGINT AS score
           FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row_id) GROUP BY q.item_id, m.row_id, m.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
