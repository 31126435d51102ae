import numpy as np

from pyspark.sql import functions as F

from pulsefeat.operators import quality, split


def test_most_frequent_shares_are_exact(spark):
    rng = np.random.default_rng(2)
    n = 30000
    table = {
        "heavy": np.where(rng.random(n) < 0.4, 3.0, np.arange(n)), "light": np.arange(n) // 2 * 1.0, "unique": np.arange(n) * 1.0, "same": np.full(n, 2.0),
        "holes": np.where(rng.random(n) < 0.6, np.nan, 1.0 * (np.arange(n) % 5)), "even": np.arange(n) % 700 * 1.0,
    }
    df = spark.createDataFrame(list(zip(*[v.tolist() for v in table.values()])), ", ".join(f"{c} double" for c in table)).repartition(6)
    got = {r.feature: r.top_share for r in quality.top_shares(df, df.columns).collect()}
    want = {}
    for c, v in table.items():
        _, counts = np.unique(v[~np.isnan(v)], return_counts=True)
        want[c] = max(counts.max(), np.isnan(v).sum()) / n
    assert got == want
    assert {r.feature: r.top_share for r in quality.value_shares(df, df.columns).collect() if r.feature != "holes"} == {c: v for c, v in want.items() if c != "holes"}
    assert {r.feature for r in quality.near_constants(df, 0.4).collect()} == {c for c in want if want[c] >= 0.4 and c != "same"}
    assert quality.top_shares(df.limit(0), df.columns).collect() == [] and quality.top_shares(df, []).collect() == []


def test_no_row_per_value_is_shuffled(spark):
    """A column of 20,000 values, one of them frequent: only candidates are grouped."""
    df = spark.range(40000).selectExpr("IF(id % 2 = 0, 1D, CAST(id AS DOUBLE)) AS x")
    seen = []
    original = type(df).groupBy
    try:
        type(df).groupBy = lambda self, *keys: seen.append((keys, self)) or original(self, *keys)
        assert quality.top_shares(df, ["x"]).collect()[0].top_share == 20001 / 40000  # 1 is among the others too
    finally:
        type(df).groupBy = original
    assert [original(rows, *keys).count().count() for keys, rows in seen if keys == ("of", "x")] == [1]


def test_correlations_in_tiles(spark, monkeypatch):
    """Three tiles of a table with gaps: the pairs and the heat map of one."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 3))
    data = np.column_stack([base @ rng.standard_normal(3) + 0.3 * rng.standard_normal(400) + 1e6 for _ in range(8)])
    data[rng.random(data.shape) < 0.1] = np.nan
    columns = [f"c {i}" for i in range(8)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in data], ", ".join(f"`{c}` double" for c in columns)).repartition(5)
    whole = {(r.feature_a, r.feature_b): (r.n, r.correlation) for r in quality.correlation_pairs(df, columns).collect()}
    monkeypatch.setattr(quality, "TILE", 3)
    pairs = quality.correlation_pairs(df, columns)
    tiled = {(r.feature_a, r.feature_b): (r.n, r.correlation) for r in pairs.collect()}
    assert len(tiled) == 28 and set(tiled) == set(whole)
    for (a, b), (n, r) in tiled.items():
        x, y = data[:, columns.index(a)], data[:, columns.index(b)]
        use = ~np.isnan(x) & ~np.isnan(y)
        assert n == use.sum() == whole[a, b][0] and abs(r - np.corrcoef(x[use], y[use])[0, 1]) < 1e-9 > abs(r - whole[a, b][1])
    matrix = quality.correlation_matrix(pairs, columns).collect()
    assert [r.feature for r in matrix] == columns and all(matrix[i].correlations[i] == 1.0 for i in range(8))
    assert matrix[2].correlations[5] == matrix[5].correlations[2] == tiled["c 2", "c 5"][1]


def test_two_thousand_columns(spark):
    """A worker holds sums of two tiles, not of all columns."""
    columns = [f"c{i}" for i in range(2000)]
    df = spark.range(12).select(*[((F.col("id") * (i + 3)) % 7 + i % 5).cast("double").alias(c) for i, c in enumerate(columns)])
    written = df.repartition(2)
    some = quality._tile_sums(quality._finite(written, columns).toDF(*[f"x{i}" for i in range(2000)]), range(0, 256), range(1792, 2000))
    assert some.groupBy("i", "j").count().count() == 256 * 208
    assert max(6 * 256 * 256 * 8, 0) < 4 << 20


def test_split_by_ever_longer_prefixes(spark, monkeypatch):
    df = spark.range(5000).selectExpr("id AS k", "IF(id % 3 = 0, 'a', IF(id % 7 = 0, NULL, 'b')) AS y")
    want = sorted(map(tuple, split.stratified(df, "k", "y").collect()), key=str)
    monkeypatch.setattr(split, "PREFIX", 1)
    monkeypatch.setattr(split, "RANKED", 3)
    assert sorted(map(tuple, split.stratified(df, "k", "y").collect()), key=str) == want
    monkeypatch.setattr(split, "MAX_CLASSES", 0)
    assert sorted(map(tuple, split.stratified(df, "k", "y").collect()), key=str) == want


def test_one_key_may_hold_most_of_a_class(spark, monkeypatch):
    monkeypatch.setattr(split, "RANKED", 5)
    df = spark.range(300).selectExpr("IF(id < 250, 7L, id) AS k", "1 AS y")
    parts = {(r.k, r.split) for r in split.stratified(df, "k", "y").collect()}
    assert len(parts) == len({k for k, _ in parts}) and {s for _, s in parts} >= {"train"}


def test_summary_counts_equal_columns(spark, tmp_path):
    """The pairs that the audit finds were left out of its summary, in the SQL too: 0 whatever the table."""
    import duckdb

    from pulsefeat.plans.catalog import ORACLES, QUERIES

    rows = spark.range(200).selectExpr(
        "id AS l_orderkey", "1L AS l_linenumber", "20 + id % 20 AS l_partkey", "id AS l_suppkey", "CAST(20 + id % 20 AS DOUBLE) AS l_quantity", "CAST(id * 7 AS DOUBLE) AS l_extendedprice",
        "(id % 11) / 100 AS l_discount", "(id % 9) / 100 AS l_tax", "IF(id % 2 = 0, 'N', 'R') AS l_returnflag", "IF(id % 3 = 0, 'F', 'O') AS l_linestatus",
    )
    for partkey, pairs in (("l_partkey", 1), ("l_partkey + id", 0)):
        folder = f"{tmp_path}/{pairs}"
        rows.withColumn("id", rows.l_orderkey % 3).withColumn("l_partkey", F.expr(partkey)).drop("id").write.parquet(f"{folder}/lineitem.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
        got, want = ({m: v for m, v in found} for found in (QUERIES["quality_summary"](spark, folder).collect(), c.execute(ORACLES["quality_summary"]).fetchall()))
        assert got["duplicate_pairs"] == want["duplicate_pairs"] == pairs
        assert got.keys() == want.keys() and got["missing_cells"] == want["missing_cells"]
