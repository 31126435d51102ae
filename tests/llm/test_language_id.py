import math
import zlib

import numpy as np
import pytest

from pulsefeat.llm import language_id as lid
from pulsefeat.llm.queries import op12_language_mixture

WORDS = {"aa": "the of and thing other with that from have not", "bb": "der und nicht eine schrift auch ueber werden macht", "cc": "le des une pour dans avec être où leur même", "dd": "это что как для они при наш все"}


def sentences(lang, n, seed):
    return " ".join(np.random.default_rng([seed, ord(lang[0])]).choice(WORDS[lang].split(), n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(sentences(lang, 60, s), lang) for lang in WORDS for s in range(20 if lang == "aa" else 8)]
    rows += [(None, "aa"), ("", "bb"), ("x", None), ("12 34", "cc")]
    return lid.learn(spark.createDataFrame(rows, "text string, lang string"))


def test_single_and_mixed(model):
    assert model.languages == ("aa", "bb", "cc", "dd")
    mixed = sentences("bb", 60, 99) + " " + sentences("dd", 25, 99)
    texts = [sentences("aa", 40, 50), sentences("cc", 3, 51), mixed, "", "12 !", sentences("dd", 9000, 7)]
    got = lid.infer(texts, model)
    assert [g[0] for g in got] == ["aa", "cc", "bb", "und", "und", "dd"] and all(0 <= g[1] <= 1 for g in got)
    assert got[0][2] == ["aa"] and got[2][2] == ["bb", "dd"] and 0.55 < got[2][3][0] < 0.85 and got[3][1:] == (0.0, [], [])


def test_expectation_maximisation_equals_a_plain_loop(model):
    for text in (sentences("bb", 30, 3) + " " + sentences("cc", 10, 4), sentences("aa", 2, 5)):
        cells, n = lid.cell_counts(text, model.cells)
        p = np.exp(model.logs[cells].astype(float))
        share = [0.25] * 4
        for _ in range(400):
            new = [lid.PRIOR] * 4
            for row, many in zip(p, n):
                z = sum(a * b for a, b in zip(row, share))
                for j in range(4):
                    new[j] += many * row[j] * share[j] / z
            share = [x / sum(new) for x in new]
        language, score, _, _ = lid.infer([text], model)[0]
        assert math.isclose(score, share[model.languages.index(language)], abs_tol=0.02)


def test_batches_give_what_single_texts_give(model):
    texts = [sentences(lang, n, n) for lang in WORDS for n in (1, 2, 5, 30)] + ["", "a", "Ä" * 50, sentences("aa", 30, 1) + sentences("bb", 30, 1)]
    together = lid.infer(texts, model)
    for text, got in zip(texts, together):
        alone = lid.infer([text], model)[0]
        assert alone[0] == got[0] and alone[2] == got[2] and math.isclose(alone[1], got[1], abs_tol=0.01)


def test_grams_of_segments_are_those_of_the_whole(monkeypatch):
    text = " ".join(f"wörd{chr(97 + i % 26)}, {i}" for i in range(500))
    whole = lid.cell_counts(text, 1 << 12)
    monkeypatch.setattr(lid, "SEGMENT", 64)
    parts = lid.cell_counts(text, 1 << 12)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()
    assert sum(len(x) for x in lid.gram_cells("é" * 1000, 1 << 12)) == 1000


def test_models_stay_bounded():
    assert lid.cells_for(4) == lid.MOST_CELLS and lid.cells_for(1000) * 1000 * 4 <= lid.MODEL_BYTES
    with pytest.raises(ValueError):
        lid.cells_for(10**6)


def test_table_edges(spark):
    schema = "doc_id long, text string, lang string, score int, lang_pred string"
    assert lid.identify_held_out(spark.createDataFrame([], schema)).collect() == []
    nothing = lid.identify_held_out(spark.createDataFrame([(1, "abc", None, 1, "x")], schema)).collect()
    assert [tuple(r)[:4] for r in nothing] == [(1, False, "und", 0.0)]
    rows = [(i, sentences(lang, 40, i), lang, 0, "zz") for i in range(40) for lang in ("aa", "cc")]
    rows += [(None, sentences("cc", 40, 1), "aa", 0, None), (700, None, "aa", 0, None), (701, "7", "cc", 0, None), (702, sentences("aa", 40000, 1), None, 0, None), rows[0]]
    got = lid.identify_held_out(spark.createDataFrame(rows, schema).repartition(3))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score", "languages", "proportions"]
    got = got.collect()
    assert len(got) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[None].lang_pred == "cc" and by_id[700].lang_pred == by_id[701].lang_pred == "und" and by_id[702].lang_pred == "aa"


def test_held_out_documents_are_told(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = op12_language_mixture(spark, "/root/testdata/sf0.01").where("held_out").collect()
    judged = [r.lang_pred == truth[r.doc_id] for r in got if r.lang_pred != "und" and truth[r.doc_id] is not None]
    assert len(judged) > 150 and np.mean(judged) >= 0.97
