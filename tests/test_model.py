import os
import tempfile

from pyspark.sql import functions as F

from revcast.operators import model as mo
from revcast.operators.encode import fit_dictionary


def test_forest_quantiles_ordered_and_reloadable(spark, features_small):
    d = fit_dictionary(features_small)
    train, names = mo.granularity_training_set(features_small, "channel", d)
    assert len(names) == 35
    m = mo.fit_forest(train, names, "channel", params={"numTrees": 5})
    keyed = train.withColumn("_k", F.monotonically_increasing_id())
    pred = m.predict(keyed, ["_k"]).collect()
    assert pred and all(r["q10"] <= r["q50"] <= r["q90"] for r in pred)
    path = tempfile.mkdtemp(prefix="revcast-model-")
    m.save(os.path.join(path, "channel"))
    back = mo.QuantileForest.load(spark, os.path.join(path, "channel"))
    assert back.features == names and back.leaves.count() == m.leaves.count()
    imp = m.importances()
    assert imp.count() == 3 * len(names)


def test_feature_counts_per_granularity(features_small):
    d = fit_dictionary(features_small)
    counts = [len(mo.granularity_training_set(features_small, g, d)[1])
              for g in ("channel", "campaign_type", "campaign")]
    assert counts == [35, 36, 37]


def test_forest_cross_validation(features_small):
    d = fit_dictionary(features_small)
    ev = mo.cross_validate(features_small, "channel", d, params={"numTrees": 3}).collect()
    assert {r["fold"] for r in ev} == {0, 1, 2, 3, 4}
    assert {r["quantile"] for r in ev} == {0.1, 0.5, 0.9}
    assert all(r["pinball_loss"] >= 0 and 0.0 <= r["coverage"] <= 1.0 for r in ev)


def test_lag_features(spark, features_small):
    from revcast.operators.features import lag_features
    lagged = lag_features(features_small).where(F.col("campaign_name") == "PROMO_Campaign_O") \
        .where(F.col("channel") == "google").orderBy("date").select("roas", "revenue_roll_7d_mean", "month").collect()
    orig = features_small.where(F.col("campaign_name") == "PROMO_Campaign_O").where(F.col("channel") == "google") \
        .orderBy("date").select("roas", "revenue_roll_7d_mean", "month").collect()
    assert lagged[0]["roas"] is None and lagged[1]["roas"] == orig[0]["roas"]
    assert lagged[2]["revenue_roll_7d_mean"] == orig[1]["revenue_roll_7d_mean"]
    assert lagged[1]["month"] == orig[1]["month"]          # calendar is known in advance: not lagged


def test_forest_forecast_linear_in_horizon(spark, features_small):
    """P50 comes from each group's latest row only, so uncapped, non-sparse groups scale 1:2:3."""
    from revcast.operators.forecast import forecast
    models, d = mo.train_all(features_small, granularities=("channel",))
    dq = mo.forest_daily_quantiles(features_small, models, d)
    fc = forecast(features_small, granularities=["channel"], daily_quantiles=dq).collect()
    by = {}
    for r in fc:
        if not r["low_confidence"] and r["roas_p50"] < 20.0:
            by.setdefault(r["channel"], {})[r["forecast_horizon"]] = r["revenue_p50"]
    checked = 0
    for ch, h in by.items():
        if 30 in h and 60 in h:
            assert abs(h[60] - 2 * h[30]) <= 1e-6 * max(1.0, h[60])
            checked += 1
        if 30 in h and 90 in h:
            assert abs(h[90] - 3 * h[30]) <= 1e-6 * max(1.0, h[90])
    assert checked > 0
