import math
import os
import tempfile

from revcast.operators.forecast import EXPORT_COLUMNS
from revcast.sources import sinks


def test_forecast_csv_roundtrip(spark, forecast_small):
    path = os.path.join(tempfile.mkdtemp(prefix="revcast-sink-"), "predictions")
    sinks.write_forecast(forecast_small, path)
    back = sinks.read_forecast(spark, path)
    assert back.columns == EXPORT_COLUMNS
    assert back.count() == forecast_small.count()
    keys = [(r["forecast_horizon"], r["granularity"], r["channel"], r["campaign_type"], r["campaign_name"])
            for r in back.collect()]
    assert keys == sorted(keys)                      # part files keep the global sort
    r = back.first()
    assert round(r["revenue_p50"], 2) == r["revenue_p50"] and round(r["roas_p50"], 4) == r["roas_p50"]


def test_json_clean(spark):
    df = spark.createDataFrame([(1, float("nan"), float("inf"), None, "x")], "h int, a double, b double, c bigint, s string")
    r = sinks.json_clean(df).first()
    assert (r["h"], r["a"], r["b"], r["c"], r["s"]) == (1, 0.0, 0.0, 0, "x")
    assert r["record_json"] == '{"h":1,"a":0.0,"b":0.0,"c":0,"s":"x"}'


def test_report_and_importance_sinks(spark):
    base = tempfile.mkdtemp(prefix="revcast-sink-")
    lines = spark.createDataFrame([(1, 5, "b"), (0, 1, "a"), (1, 2, "c")], "section int, ord bigint, line string")
    sinks.write_report(lines, os.path.join(base, "report"))
    text = [r["value"] for r in spark.read.text(os.path.join(base, "report")).collect()]
    assert text == ["a", "c", "b"]
    imp = spark.createDataFrame([("campaign", 0.5, "roas", 2.0), ("campaign", 0.5, "spend", 5.0)],
                                "granularity string, quantile double, feature string, importance double")
    sinks.write_importances(imp, os.path.join(base, "imp"))
    got = spark.read.option("header", True).csv(os.path.join(base, "imp")).collect()
    assert [r["feature"] for r in got] == ["spend", "roas"]
    assert not math.isnan(float(got[0]["importance"]))
