from pyspark.sql import functions as F

from revcast.functions.explain import explain_feature, explain_feature_short
from revcast.functions.expr import (
    anomaly_label, clamp_multiplier, compact_currency, finite_or_zero, map_campaign_type, meta_prefix_type,
    outlook_label, risk_label, roas_label, trend_label,
)


def col_values(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr).collect()]


def test_type_map(spark):
    got = col_values(spark, [("SEARCH",), ("Search",), ("PerformanceMax",), ("Audience",), ("search",), (None,)],
                     "t string", map_campaign_type(F.col("t")))
    assert got == ["SEARCH", "SEARCH", "PERFORMANCE_MAX", "AUDIENCE", "OTHER", "OTHER"]


def test_name_prefix(spark):
    got = col_values(spark, [("Generic_X",), ("Prospecting_DPA_1",), ("Remarketing_Brand_1",), ("Foo_1",), (None,)],
                     "n string", meta_prefix_type(F.col("n")))
    assert got == ["GENERIC", "PROSPECTING", "REMARKETING", "OTHER", "OTHER"]


def test_finite_or_zero(spark):
    got = col_values(spark, [(float("nan"),), (float("inf"),), (float("-inf"),), (None,), (2.5,)], "x double",
                     finite_or_zero(F.col("x")))
    assert got == [0.0, 0.0, 0.0, 0.0, 2.5]


def test_labels(spark):
    roas = col_values(spark, [(0.5,), (0.51,), (1.0,), (1.01,), (3.0,), (3.01,)], "r double", roas_label(F.col("r")))
    assert roas == ["UNDERPERFORMING", "MARGINAL", "MARGINAL", "PROFITABLE", "PROFITABLE", "HIGH PERFORMER"]
    trend = col_values(spark, [(5.0,), (5.01,), (-5.0,), (-5.01,)], "g double", trend_label(F.col("g")))
    assert trend == ["STABLE", "GROWING", "STABLE", "DECLINING"]
    outlook = col_values(spark, [(1.0 * 0.89,), (1.0 * 1.11,), (1.0,)], "f double",
                         outlook_label(F.col("f"), F.lit(1.0)))
    assert outlook == ["DECLINING", "IMPROVING", "STABLE"]
    anomaly = col_values(spark, [(10.0,), (10.5,), (-10.5,)], "c double", anomaly_label(F.col("c")))
    assert anomaly == ["STABLE", "UPLIFT", "DECLINE"]


def test_risk_label(spark):
    got = col_values(spark, [(0.0, 100.0, 300.0), (90.0, 100.0, 120.0), (60.0, 100.0, 160.0), (0.0, 0.0, 5.0)],
                     "a double, b double, c double", risk_label(F.col("a"), F.col("b"), F.col("c")))
    assert got == ["HIGH", "LOW", "MED", "LOW"]


def test_clamp_and_currency(spark):
    assert col_values(spark, [(0.01,), (1.5,), (9.0,)], "m double", clamp_multiplier(F.col("m"))) == [0.1, 1.5, 3.0]
    assert col_values(spark, [(1_234_567.0,), (12_345.0,), (950.0,)], "v double",
                      compact_currency(F.col("v"))) == ["$1.2M", "$12k", "$950"]


def test_explanations(spark):
    names = [("roas",), ("revenue_roll_7d_mean",), ("revenue_roll_30d_std",), ("spend_roll_14d_std",),
             ("roas_roll_7d_mean",), ("clicks_roll_30d_mean",), ("channel",), ("campaign_type",), ("campaign_name",),
             ("zzz",)]
    long = col_values(spark, names, "f string", explain_feature(F.col("f")))
    assert long[:6] == ["Historical return on ad spend (revenue per dollar spent)",
                        "Average daily revenue over 7d window", "Revenue volatility over 30d window",
                        "Spend volatility over 14d window", "Average ROAS over 7d window",
                        "Average daily clicks over 30d window"]
    assert long[6:] == ["Advertising channel (Google, Bing, Meta)", "Campaign type (Search, PMax, Display, etc.)",
                        "Individual campaign identifier", "Model feature"]
    short = col_values(spark, names, "f string", explain_feature_short(F.col("f")))
    assert short[:3] == ["Return on ad spend", "Rolling revenue metric", "Rolling revenue metric"]
    assert short[6:] == ["Ad channel", "Campaign identifier", "Campaign identifier", "Model feature"]
