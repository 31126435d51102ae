from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pulsefeat.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shared(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    """Targets by resharing the excess over and over."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, 0.0)
    rest, open_ = share * sum(sizes.values()), set(order)
    while open_ and rest > 1e-9:
        part = rest / sum(weight[s] for s in open_)
        rest = 0.0
        for s in sorted(open_, key=str):
            target[s] += part * weight[s]
            if target[s] >= cap * sizes[s]:
                rest += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                open_ = open_ - {s}
    return target


def corpus(spark):
    rows = [(i, "w " * (i % 90), "en", ["a", "B", "é", "z", None][i % 7 % 5], i) for i in range(3000)] + [(None, "x y", None, "a", 1), (3001, None, None, "empty", 0), (3002, "", None, "empty", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def test_targets_and_copies(spark):
    df = corpus(spark)
    plan = [r.asDict(recursive=True) for r in mixing.mix_plan(df).collect()]
    assert len(plan) == df.count()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in plan:
        s = r["row"]["source"]
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        target[s] = r["target"]
        assert 0 <= r["copies"] <= 2 and r["size"] == len((r["row"]["text"] or "").split())
    want = shared(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == pytest.approx(want[s], rel=0.15, abs=1)
    again = Counter((r.row.doc_id, r.copies) for r in mixing.mix_plan(df.repartition(7)).collect())
    assert again == Counter((r["row"]["doc_id"], r["copies"]) for r in plan)


def test_salted_join_gives_the_same_plan(spark, monkeypatch):
    df = corpus(spark)
    one = Counter(map(str, mixing.mix_plan(df).collect()))
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", 0)
    assert Counter(map(str, mixing.mix_plan(df).collect())) == one


def test_mix_emits_rows_with_clashing_columns(spark):
    df = corpus(spark).withColumns({"size": F.lit(1), "copies": F.lit("x"), "row": F.lit(2)})
    mixed = mixing.mix_sources(df)
    assert mixed.columns == df.columns
    assert mixed.count() == mixing.mix_plan(df).agg(F.sum("copies")).first()[0]


def test_empty_table_and_no_words(spark):
    assert mixing.mix_plan(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [r.copies for r in mixing.mix_plan(spark.createDataFrame([(1, None, None, None, None)], SCHEMA)).collect()] == [0]


def test_equals_sql(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = sorted(tuple(r) for r in mixing.mix_plan(df, carry=["doc_id"]).select("row.doc_id", "size", "source_size", "target", F.col("size") * F.col("copies")).where("doc_id IS NOT NULL").collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    assert got == sorted(r for r in c.execute(mixing.ORACLE_SQL).fetchall() if r[0] is not None)
