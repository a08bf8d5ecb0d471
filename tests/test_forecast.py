from pyspark.sql import functions as F

from revcast.operators.forecast import cap_forecast, project_forecast, repair_quantiles
from revcast.operators.scenarios import apply_scenarios


def test_crossing_repair_order(spark):
    data = [(1, 100.0, 50.0, 200.0),   # p10 > p50 -> 0.8 p50
            (2, 10.0, 50.0, 40.0),     # p90 < p50 -> 1.2 p50
            (3, 80.0, 50.0, 30.0),     # both
            (4, 10.0, 50.0, 90.0),     # none
            (5, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(data, "id int, revenue_p10 double, revenue_p50 double, revenue_p90 double")
    got = {r["id"]: (r["revenue_p10"], r["revenue_p50"], r["revenue_p90"])
           for r in repair_quantiles(df).collect()}
    assert got[1] == (40.0, 50.0, 200.0)
    assert got[2] == (10.0, 50.0, 60.0)
    assert got[3] == (40.0, 50.0, 60.0)
    assert got[4] == (10.0, 50.0, 90.0)
    assert got[5] == (0.0, 0.0, 0.0)


def test_roas_cap(spark):
    data = [(1, 0.0, 10.0), (2, 100.0, 1990.0), (3, 100.0, 2000.0), (4, 100.0, 2500.0)]
    df = spark.createDataFrame(data, "id int, projected_spend double, revenue_p50 double") \
        .withColumns({"revenue_p10": F.col("revenue_p50"), "revenue_p90": F.col("revenue_p50")})
    got = {r["id"]: (r["roas_p50"], r["revenue_p50"]) for r in cap_forecast(df).collect()}
    assert got[1] == (0.0, 10.0)
    assert got[2] == (19.9, 1990.0)
    assert got[3] == (20.0, 2000.0)
    assert got[4] == (20.0, 2000.0)


def test_sparse_fallback(spark):
    base = spark.createDataFrame(
        [(30, "campaign", "g", "T", "a", 4, 4, 100.0, 10.0, [1.0, 2.0, 3.0]),
         (30, "campaign", "g", "T", "b", 5, 5, 100.0, 10.0, [1.0, 2.0, 3.0])],
        "forecast_horizon int, granularity string, channel string, campaign_type string, campaign_name string, "
        "days_in_window int, nonzero_revenue_days int, historical_daily_revenue double, "
        "historical_daily_spend double, daily_quantiles array<double>")
    got = {r["campaign_name"]: r for r in project_forecast(base).collect()}
    a, b = got["a"], got["b"]
    assert a["low_confidence"] and a["revenue_p10"] == a["revenue_p50"] == a["revenue_p90"] == 3000.0
    assert not b["low_confidence"] and (b["revenue_p10"], b["revenue_p50"], b["revenue_p90"]) == (30.0, 60.0, 90.0)
    assert b["projected_spend"] == 300.0


def test_forecast_invariants(forecast_small):
    rows = forecast_small.collect()
    assert rows
    for r in rows:
        assert r["revenue_p10"] <= r["revenue_p50"] <= r["revenue_p90"]
        assert r["roas_p90"] <= 20.0 + 1e-9
        assert r["revenue_p10"] >= 0.0
    counts = {(h, g) for h, g in ((r["forecast_horizon"], r["granularity"]) for r in rows)}
    assert {h for h, _ in counts} == {30, 60, 90}


def test_multiplier_keeps_roas(forecast_small):
    """D3: revenue and spend scale together, so ROAS does not move (capped or not)."""
    sc = apply_scenarios(forecast_small, [("base", None, 1.0), ("up", None, 1.7), ("g", "google", 0.5)])
    piv = {}
    for r in sc.collect():
        piv.setdefault((r["forecast_horizon"], r["granularity"], r["channel"], r["campaign_type"],
                        r["campaign_name"]), {})[r["scenario_id"]] = r
    for v in piv.values():
        assert abs(v["up"]["revenue_p50"] - 1.7 * v["base"]["revenue_p50"]) < 1e-6 * max(1.0, v["base"]["revenue_p50"])
        assert v["up"]["roas_p50"] == v["base"]["roas_p50"]
        m = 0.5 if v["g"]["channel"] == "google" else 1.0
        assert v["g"]["budget_multiplier"] == m
