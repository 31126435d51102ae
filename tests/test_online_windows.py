"""The window columns of the online features compute an array's moments once, not in every branch and lambda."""

from pyspark.sql import functions as F

from pulsefeat.plans import catalog
from pulsefeat.streaming import online


def test_windows_of_one_array_share_its_evaluation(spark):
    df = spark.range(10).select(F.lit(1).alias("machine_id"), F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    columns = online.online_windows("value", catalog.events_window(), catalog.ONLINE)
    for wanted, most in ((["zscore", "anomaly_score"], 4), (["mean", "std"], 4)):
        plan = df.select(*[columns[f"value_rolling_12_{k}"].alias(k) for k in wanted])._jdf.queryExecution().optimizedPlan().toString()
        assert 0 < plan.count("aggregate(") <= most, plan
    got = df.select("seq", *[columns[f"value_rolling_3_{k}"].alias(k) for k in ("mean", "std", "min", "max", "median", "zscore", "anomaly_score")]).orderBy("seq").collect()
    assert tuple(got[9])[1:] == (7.0, 1.0, 6.0, 8.0, 7.0, 2.0, 2.0) and tuple(got[0])[1:] == (None,) * 7 and got[1]["min"] is None and got[2]["std"] == 0.5**0.5
