import re
import random

import numpy as np
import pytest

from pulsefeat.llm import components, minhash
from pulsefeat.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < k:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute_force(rows, k, percent):
    sets = [(i, word_set(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), root(i)) for i, s in sets}


def chains(seed, n=60):
    """Groups of documents edited word by word, so that neighbours are near and ends are far."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    rows = []
    for _ in range(n // 6):
        text = [word() for _ in range(rng.randint(4, 160))]
        for _ in range(6):
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_equals_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    monkeypatch.setattr(minhash, "FAMILY_BLOCK", 3)
    rows = chains(k)
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one"), (905, "two words"), (906, "Two\twords"), (907, rows[0][1].upper())]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, k, percent).collect()}
    assert got == brute_force(rows, k, percent)


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (1, text), (1, text), (2, text + " end"), (3, None)]
    df = spark.createDataFrame([(i, t, "x", "y", 1, 2, b"z") for i, t in rows], SCHEMA + ", component_id long, set_key binary")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)
    assert out == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)], key=str)
    kept = minhash.deduplicate(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 1, 1, 3], key=str)


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    """Each text stays once, whatever ids its copies share with other texts."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(80)) for c in "wvu")
    rows = [(1, one), (2, one + " end"), (2, two), (2, None), (3, two), (4, three), (4, three)]
    kept = [tuple(r) for r in minhash.deduplicate(spark.createDataFrame(rows, "doc_id int, text string")).collect()]
    texts = [t for _, t in kept]
    assert sum(t is not None and t.startswith("w0") for t in texts) == texts.count(two) == 1 and texts.count(three) == 2 and (2, None) in kept and len(kept) == 5


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_estimates_similarity_and_fills_every_coordinate():
    rng = np.random.default_rng(5)
    for n, shared in ((1, 1), (3, 2), (40, 30), (3000, 1500)):
        errors = []
        for _ in range(40):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 2**63, n - shared, dtype=np.uint64)])
            s = minhash.sketches(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
            errors.append((s[0] == s[1]).mean() - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.15


def test_long_texts_are_dealt_by_their_length(spark, monkeypatch):
    """Blocks of one document or two, though the family has few: results stay those of brute force."""
    monkeypatch.setattr(minhash, "FAMILY_ELEMENTS", 9000)
    rng = random.Random(8)
    text = [str(rng.randrange(50_000)) for _ in range(6000)]
    rows = []
    for i in range(8):
        rows.append((i, " ".join(text)))
        for _ in range(60):
            text[rng.randrange(len(text))] = "new"
    verified = minhash._verified

    def watched(batches, k, percent):
        for group in minhash.sorted_groups(batches, "task"):
            if sum(len((t or "").split()) for t in group.column("text").to_pylist()) >= 8 * 6000:
                raise AssertionError("a task holds the whole family")
            yield from verified(iter(group.to_batches()), k, percent)

    monkeypatch.setattr(minhash, "_verified", watched)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, 5, 80).collect()}
    assert got == brute_force(rows, 5, 80) and {c for _, _, c in got} == {0}


@pytest.mark.parametrize("least_hub", [1, 1000])
def test_components_with_hubs(spark, monkeypatch, least_hub):
    monkeypatch.setattr(components, "LEAST_HUB", least_hub)
    rng = random.Random(9)
    edges = [(0, i) for i in range(1, 60)] + [(999, i) for i in range(500, 560)] + [(rng.randrange(100, 160), rng.randrange(100, 400)) for _ in range(200)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, root(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (None, 3)]
    got = {(r.node, r.component) for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)}
