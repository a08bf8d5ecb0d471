from pyspark.sql import functions as F

from revcast.operators import insights as ins

FC_SCHEMA = ("forecast_horizon int, granularity string, channel string, campaign_type string, campaign_name string, "
             "revenue_p10 double, revenue_p50 double, revenue_p90 double, roas_p10 double, roas_p50 double, "
             "roas_p90 double, projected_spend double, budget_multiplier double, historical_daily_revenue double, "
             "historical_daily_spend double, days_in_window int, nonzero_revenue_days int, low_confidence boolean")


def row(g, ch, p10, p50, p90, spend, roas=1.0, name="ALL", typ="ALL", h=30):
    return (h, g, ch, typ, name, float(p10), float(p50), float(p90), float(roas), float(roas), float(roas),
            float(spend), 1.0, 10.0, 5.0, 30, 30, False)


def test_uncertainty_rules(spark):
    fc = spark.createDataFrame([row("campaign", "g", 0.0, 0.0, 2.0, 10.0, name="zero", typ="T"),
                                row("campaign", "g", 10.0, 100.0, 300.0, 10.0, name="wide", typ="T"),
                                row("channel", "g", 1.0, 2.0, 3.0, 10.0)], FC_SCHEMA)
    hu = ins.high_uncertainty(fc).collect()
    assert [r["campaign_name"] for r in hu] == ["wide"] and hu[0]["high_uncertainty_total"] == 1
    rec = ins.recommendation_inputs(fc).first()
    assert rec["data_quality_campaigns"] == 2          # p50 = 0 with width > 1.5 counts here
    assert rec["zero_revenue_campaigns"] == 1


def test_budget_concentration(spark):
    at60 = spark.createDataFrame([row("channel", "google", 0, 1, 2, 60.0), row("channel", "bing", 0, 1, 2, 40.0)],
                                 FC_SCHEMA)
    at61 = spark.createDataFrame([row("channel", "google", 0, 1, 2, 61.0), row("channel", "bing", 0, 1, 2, 39.0)],
                                 FC_SCHEMA)
    a, b = ins.budget_concentration(at60).first(), ins.budget_concentration(at61).first()
    assert a["dominant_channel"] == "google" and not a["concentration_alert"]
    assert b["concentration_alert"]


def test_shares_sum_to_100(forecast_small, features_small):
    ct = ins.contribution_table(forecast_small, features_small, 30)
    total = ct.where(F.col("status") == "Active").agg(F.sum("contribution_pct")).first()[0]
    assert abs(total - 100.0) < 1e-6
    assert abs(ins.channel_analysis(forecast_small).agg(F.sum("share_pct")).first()[0] - 100.0) < 1e-6


def test_paused_disjoint_from_active(forecast_small, features_small):
    for h in (30, 60, 90):
        paused = {(r["channel"], r["campaign_type"]) for r in ins.paused_types(features_small, forecast_small, h).collect()}
        active = {(r["channel"], r["campaign_type"]) for r in ins.rows_at(forecast_small, "campaign_type", h).collect()}
        assert not paused & active
    assert ("bing", "AUDIENCE") in {(r["channel"], r["campaign_type"])
                                    for r in ins.paused_types(features_small, forecast_small, 30).collect()}


def test_recommendation_numbering(forecast_small):
    recs = ins.recommendations(forecast_small).orderBy("rec_num").collect()
    assert [r["rec_num"] for r in recs] == list(range(1, len(recs) + 1))
    assert recs[-1]["rule"] == "SCENARIO PLANNING"


def test_fan_series_shape(forecast_small):
    fs = ins.fan_series(forecast_small)
    per_h = {r["forecast_horizon"]: r["n"] for r in fs.groupBy("forecast_horizon").agg(F.count("*").alias("n")).collect()}
    assert per_h == {30: 11, 60: 21, 90: 31}
