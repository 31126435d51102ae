import json

from pulsefeat.__main__ import main
from pulsefeat.sources import tables
from pulsefeat.sources.views import machines


def test_whole_run_and_exit_codes(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    machines(spark, "/root/testdata/sf0.001").write.parquet(source)
    out = str(tmp_path / "out")
    assert main([source, out]) == 0
    assert tables.load_json(spark, f"{out}/summary_json")["safety"]["passed"]
    page = spark.read.text(f"{out}/report_html", wholetext=True).first()[0]
    assert page.startswith("<!DOCTYPE html>") and "Feature inventory" in page
    assert spark.read.parquet(f"{out}/predictive_test").columns == spark.read.parquet(f"{out}/predictive_train").columns
    assert main([source, out, "--target", "nothing"]) == 1
    assert main([str(tmp_path / "missing.parquet"), out]) == 2
    assert main([]) == 1


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("﻿UDI,Air temperature [K]\n1,298.5\n,\n".encode())
    df = tables.normalized(tables.load_csv(spark, str(path)))
    assert df.columns == ["uid", "air_temperature_k"] and df.count() == 1


def test_json_values():
    assert json.dumps(tables.json_safe({"a": float("nan"), "b": [float("inf"), 1]})) == '{"a": null, "b": [null, 1]}'


def test_load_dataset_from_the_first_source_that_answers(spark, tmp_path):
    import zipfile

    from pulsefeat.sources import loading

    header = "UDI,Product ID,Type,Air temperature [K],Process temperature [K],Rotational speed [rpm],Torque [Nm],Tool wear [min],Machine failure"
    text = header + "\n" + "\n".join(f"{i},P{i},L,{298 + i},{308 + i},{1500 + i},{40 + i},{999 * i},{i % 2}" for i in range(4))
    path = tmp_path / "data.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("other.csv", "a,b\n1,2\n")
        z.writestr("ai4i2020.csv", text)
    loaded = loading.load_dataset(spark, str(tmp_path / "absent.csv"), use_package=False, urls=(path.as_uri(),))
    assert loaded.mode == "ai4i" and loaded.data.columns[:3] == ["uid", "product_id", "type"] and loaded.data.count() == 4
    assert loaded.warnings == ["tool_wear_min: 2 values out of range"]
    assert loading.printed_summary(loaded).startswith("4 rows, 9 columns, mode ai4i")


def test_missing_packages_are_named(spark):
    import importlib.util

    import pytest

    from pulsefeat.plans import drawing

    if importlib.util.find_spec("matplotlib") is None:
        with pytest.raises(RuntimeError, match="matplotlib"):
            drawing.bars(spark.range(3).withColumnRenamed("id", "a"), "a", "a", "x.png")
