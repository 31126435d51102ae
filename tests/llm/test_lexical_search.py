import math
import re
from collections import Counter

import numpy as np
import pytest

from pulsefeat.llm import lexical_search as lex

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_force(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(n for _, _, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    queries = {}
    for i, t in items:
        if t is not None:
            queries.setdefault(i, set()).update(terms(t))
    out = set()
    for item, query in queries.items():
        found = []
        for doc_id, bag, n in bags:
            m = 100 - 90 + 90 * n * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in query if bag[t])
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        out |= {(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.mark.parametrize("block,leaf,fanout,partitions", [(4096, 64, 8, 1), (37, 4, 2, 3), (8, 8, 2, 7), (100, 1, 3, 4)])
def test_equals_brute_force(spark, monkeypatch, block, leaf, fanout, partitions):
    for name, value in (("BLOCK_DOCUMENTS", block), ("LEAF", leaf), ("FANOUT", fanout), ("SEGMENT", 40)):
        monkeypatch.setattr(lex, name, value)
    rng = np.random.default_rng(5)
    words = ["the", "OF", "ña", "Ünder", "x1", "42", "rare", "日本", "tie", "z"]
    share = np.array([30, 20, 10, 8, 6, 4, 1, 1, 1, 1]) / 82
    docs = [(i, ", ".join(rng.choice(words, rng.integers(1, 60), p=share))) for i in range(400)]
    docs += [(1000 + i, "tie tie rare") for i in range(30)] + [(2000, None), (2001, ""), (2002, "?! ..."), (None, "tie tie rare"), (1003, "tie tie rare"), (5, "Z z"), (2003, "rare " * 3000)]
    items = [(1, "tie"), (2, "The rare THE"), (3, "ÑA ña x1, 42"), (4, "nowhere"), (5, None), (6, ""), (7, "z"), (7, "tie"), (None, "日本 of"), (8, " ".join(words))]
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in docs], "doc_id long, text string, source string, score int").repartition(partitions)
    queries = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    got = lex.search(df, queries, 10)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == brute_force(docs, items, 10) and len(rows) == len(set(rows))


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(lex, "QUERY_ROWS", 3)
    docs = [(i, f"w{i % 7} w{i % 3} all") for i in range(50)]
    items = [(f"q{i}", f"w{i}") for i in range(10)]
    df, queries = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id string, text string")
    assert {tuple(r) for r in lex.search(df, queries, 4).collect()} == brute_force(docs, items, 4)


def test_empty_tables(spark):
    no_docs, no_items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lex.search(no_docs, some).collect() == [] and lex.search(some.withColumnRenamed("item_id", "doc_id"), no_items).collect() == []


def test_ranges_below_the_best_are_not_opened():
    """A block of 4,096 documents of which one leaf holds the ten best: few leaves are scored."""
    lengths = np.full(4096, 20, dtype=np.int64)
    tf = np.ones(4096, dtype=np.int64)
    tf[640:660] = 9
    row = {"ids": np.arange(4096), "known": np.ones(4096, dtype=bool), "lengths": lengths, "terms": np.array([0]), "ends": np.array([4096]), "at": np.arange(4096), "tf": tf}
    trees = lex.BlockTrees(row, np.array([500]), 4096, 4096 * 20)
    opened = []
    original = trees.leaf_scores
    trees.leaf_scores = lambda rows, leaf: opened.append(leaf) or original(rows, leaf)
    rows, bounds = trees.root_bounds([np.array([0])])
    best = []
    trees.search(rows[0], bounds[0], best, 10, [0])
    assert opened == [10] and sorted(-d for _, _, d, _ in best) == list(range(640, 650))
