import pytest
from pyspark.sql import functions as F

from pulsefeat.functions.names import canonical_names
from pulsefeat.sources import loading, ordering
from pulsefeat.sources.tables import detected_encoding, load_csv


def test_encodings(spark, tmp_path):
    files = {"plain": "name,x\nA,1\n".encode(), "bom": b"\xef\xbb\xbf" + "näme,x\nÄ,1\n".encode(), "latin": "näme,x\nÄ,1\nb,2\n".encode("latin-1")}
    for name, data in files.items():
        (tmp_path / f"{name}.csv").write_bytes(data)
    assert [detected_encoding(spark, str(tmp_path / f"{n}.csv")) for n in files] == ["UTF-8", "UTF-8", "ISO-8859-1"]
    bom, latin = load_csv(spark, str(tmp_path / "bom.csv")), load_csv(spark, str(tmp_path / "latin.csv"))
    assert bom.columns == latin.columns == ["näme", "x"] and bom.first()[0] == latin.first()[0] == "Ä" and latin.count() == 2


def test_files_that_cannot_be_read(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_csv(spark, str(tmp_path / "nowhere.csv"))
    (tmp_path / "empty.csv").write_bytes(b"")
    (tmp_path / "header.csv").write_bytes(b"a,b\n")
    for name, text in (("empty", "empty"), ("header", "no rows")):
        with pytest.raises(ValueError, match=text):
            load_csv(spark, str(tmp_path / f"{name}.csv"))


def test_unknown_names_in_snake_case():
    assert canonical_names(["Torque [Nm]", "Vibration Level (mm/s)", "%"], snake=True) == ["torque_nm", "vibration_level_mm_s", "%"]
    assert canonical_names(["Vibration Level (mm/s)"]) == ["Vibration Level (mm/s)"]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_and_diagnostics(spark, parts):
    rows = [("b", 100, 1.0), ("a", 300, 2.0), ("a", 100, 3.0), ("a", 100, 3.0), ("a", 100, 4.0), (None, 50, 5.0), ("b", None, 6.0), ("b", None, 6.0), ("c", 900, 7.0)]
    df = spark.createDataFrame(rows, "m string, s long, x double").select("m", F.timestamp_seconds("s").alias("t"), "x").repartition(parts)
    table, d = ordering.ordered(df, "m", "t", row="place")
    table = table.orderBy("place").drop("place")
    assert (d.rows, d.machines, d.untimed, d.repeated_keys, d.repeated_rows, d.longest_gap_seconds) == (9, 4, 2, 3, 2, 200.0)
    assert d.first_time.second == 50 and [r.m for r in table.collect()] == ["a"] * 4 + ["b"] * 3 + ["c", None]
    assert [r.x for r in table.where("m = 'b'").collect()] == [1.0, 6.0, 6.0]
    empty, none = ordering.ordered(df.limit(0), "m", "t")
    assert empty.collect() == [] and none.rows == 0


def test_one_exchange_for_order_and_diagnostics(spark, monkeypatch):
    written = []
    original = ordering.written
    monkeypatch.setattr(ordering, "written", lambda df, label: written.append(df) or original(df, label))
    df = spark.range(500).select((F.col("id") % 5).cast("string").alias("machine_id"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("x"))
    loaded = loading.prepared(df, "timeseries")
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert plan(written[0]).count("Exchange rangepartitioning") == 1 and "Exchange" not in plan(loaded.data)
    assert loaded.diagnostics.machines == 5 and loaded.diagnostics.longest_gap_seconds == 5.0 and loaded.warnings == []


def test_ai4i_tables_need_all_their_columns(spark):
    df = spark.createDataFrame([(i, "p", "L", 300.0, 310.0, 1500.0, 40.0, float(i), i % 2) for i in range(4)], "uid int, product_id string, type string, air_temperature_k double, process_temperature_k double, rotational_speed_rpm double, torque_nm double, tool_wear_min double, machine_failure int")
    with pytest.raises(ValueError, match="missing column"):
        loading.prepared(df, "ai4i")
    assert loading.prepared(df).mode == "ai4i"
