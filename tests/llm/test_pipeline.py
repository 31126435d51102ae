"""Each stage on its own input, held against plain Python."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from pulsefeat.llm.storage import cut
from tests_llm_helpers import brute_components, repeated_runs

SF = "/root/testdata/sf0.001"


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(cut(stage(spark, seen[-1], SF), name))
    raw, good, unique, cleaned, mixed, coded = [[r.asDict() for r in d.collect()] for d in seen]
    assert all(d.columns == columns for d in seen[:-1])

    by_id = {r["doc_id"]: r for r in raw}
    assert all(by_id[r["doc_id"]] == r for r in good)
    assert all(len(split(r["text"])) >= 50 for r in good)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fine = [r for r in raw if labels.get(r["doc_id"]) == 1 and len(split(r["text"])) >= 50]
    assert sum(r["doc_id"] in {g["doc_id"] for g in good} for r in fine) >= 0.95 * len(fine)

    component = brute_components([(r["doc_id"], r["text"]) for r in good], 5, 80)
    assert {r["doc_id"] for r in unique} == {i for i, c in component.items() if i == c}

    left = {r["doc_id"]: r for r in cleaned}
    assert left.keys() == {r["doc_id"] for r in unique}
    repeated = repeated_runs({r["doc_id"]: split(r["text"]) for r in unique}, 50)
    for r in unique:
        if r["doc_id"] not in repeated:
            continue
        gone = len(split(r["text"])) - len(split(left[r["doc_id"]]["text"]))
        assert gone >= repeated[r["doc_id"]]
    assert not repeated_runs({i: split(r["text"]) for i, r in left.items()}, 50)
    untouched = [r for r in unique if left[r["doc_id"]]["text"] == r["text"]]
    assert len(untouched) >= 0.8 * len(unique)

    sizes = defaultdict(int)
    for r in cleaned:
        sizes[r["source"]] += len(split(r["text"]))
    copies = Counter(r["doc_id"] for r in mixed)
    assert max(copies.values()) <= 2 and all(left[r["doc_id"]] == r for r in mixed)
    assert 1.2 * sum(sizes.values()) < sum(len(split(r["text"])) for r in mixed) < 1.8 * sum(sizes.values())

    assert Counter(r["doc_id"] for r in coded) == copies
    assert all(r["decoded_equal"] and r["n_tokens"] == len(r["ids"]) for r in coded)


def test_edges_of_every_stage(spark, tmp_path):
    """Nulls, repeats, ties, a long text, clashing names, and empty tables, through all stages."""
    say = lambda seed, n: " ".join(f"w{seed}x{i}" for i in range(n))
    texts = [(1, say(1, 80)), (2, say(1, 80)), (2, say(2, 90)), (None, say(3, 70)), (4, None), (5, ""), (6, "short"), (7, say(4, 60)), (7, say(4, 60)), (8, say(5, 40_000))]
    rows = [(i, t, None if i == 7 else "s", "x", b"y", 3.0, 1) for i, t in texts]
    schema = "doc_id long, text string, source string, text_key string, ids binary, score double, kept int"
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for name, table in (("some", spark.createDataFrame(rows, schema)), ("none", spark.createDataFrame([], schema))):
        folder = str(tmp_path / name)
        labels.write.parquet(f"{folder}/labels.parquet")
        docs, seen = table, {}
        for stage, function in corpus_pipeline.STAGES:
            docs = cut(function(spark, docs, folder), stage)
            seen[stage] = docs
            assert stage == "bpe_encode" or docs.columns == table.columns
        assert docs.columns == ["doc_id", "source", "ids", "n_tokens", "decoded_equal"]
        if name == "none":
            assert all(d.isEmpty() for d in seen.values())
            continue
        key = lambda d: sorted((str(r.doc_id), r.text) for r in d.collect())
        assert key(seen["quality_rules"]) == sorted((str(i), t) for i, t in texts if t and len(t) > 100)
        assert key(seen["minhash_near_dedup"]) == sorted((str(i), t) for i, t in texts if t and len(t) > 100 and (i, t) != (2, texts[0][1]))
        assert all(r.decoded_equal for r in docs.collect())
        # Every stage but the first takes nulls and empty texts as well.
        for stage, function in corpus_pipeline.STAGES[1:]:
            out = function(spark, table.where("text IS NULL OR length(text) < 10 OR doc_id IS NULL"), folder)
            assert stage == "mix_sources" or out.where("doc_id IN (4, 5, 6)").count() == 3, stage
