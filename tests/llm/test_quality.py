import random
import re
from collections import Counter

import numpy as np

from pulsefeat.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = list(zip(words, words[1:], words[2:]))
    found = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if found[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def corpus(rng):
    word = lambda: "".join(rng.choice("aeioubcdfg") for _ in range(rng.randint(1, 8)))
    rows, labels = [], []
    for i in range(800):
        words = [word() for _ in range(rng.randint(55, 200))]
        bad = i % 16 == 0
        text = " ".join(w.upper() + "!!" if bad and i % 32 else w + "***" if bad else w for w in words)
        rows.append((i, text + "\n" + rng.choice(["end", "The end."]), "en", "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_counts_equal_plain_python(spark):
    texts = ["", " \n", None, "one", "a b c a b c a b c", "é ü\n\né ü\nz# $%|<>&*", "x\x0by\x0cz \x85 nbsp\xa0 w", "l\n l\nl\n", "A a A a A a " * 30, "w " * 70000]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    got = quality.document_verdicts(df, spark.createDataFrame([], LABELS)).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        want = plain_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)  # no labels, so no score is rejected


def test_forest_rejects_junk_and_keeps_the_rest(spark):
    rows, labels = corpus(random.Random(3))
    odd = [(None, rows[1][1], None, None, None), rows[2], (900, None, None, None, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    graded = spark.createDataFrame(labels[:600] + [(5, None, None), (None, 0, 0), labels[9]], LABELS)
    verdict = {r.doc_id: r.kept for r in quality.document_verdicts(df, graded).collect()}
    unseen = labels[600:]
    assert np.mean([verdict[i] for i, q, _ in unseen if q]) >= 0.97 and np.mean([not verdict[i] for i, q, _ in unseen if not q]) >= 0.8
    kept = quality.filter_documents(df, graded)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(i for i in [r[0] for r in rows + odd] if verdict[i])


def test_path_lengths_single_out_an_outlier():
    x = np.random.default_rng(0).standard_normal((500, 3))
    x[7] = 12
    score = quality.Forest.fit(x).score(x)
    assert score.argmax() == 7 and score[7] > 0.6 and np.median(score) < 0.5


def test_empty_table(spark):
    assert quality.document_verdicts(spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)).collect() == []


def test_forest_on_held_out_labels_of_the_real_table(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    counted = quality.with_counts(docs, ["doc_id"]).selectExpr("row.doc_id", *quality.COUNTS)
    verdicts = quality.judge(counted.withColumn("score", (rules := quality.fit(counted, labels.where("doc_id % 2 = 0"))).score()), rules)
    unseen = verdicts.where("NOT base_failed").join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality").agg({"*": "count", "kept": "count_if"}).collect()
    kept = {r.quality: r["count_if(kept)"] / r["count(1)"] for r in unseen}
    assert kept[0] <= 0.1 and kept[1] >= 0.985, kept


def test_clashing_columns(spark):
    rows, labels = corpus(random.Random(5))
    df = spark.createDataFrame([(*r, 1, "s", True, 0) for r in rows], SCHEMA + ", n_words long, score string, kept boolean, quality int")
    kept = quality.filter_documents(df, spark.createDataFrame([(*x, "t") for x in labels], LABELS + ", text string"))
    assert kept.columns == df.columns and 600 < kept.count() < 800 and kept.first().score == "s"
