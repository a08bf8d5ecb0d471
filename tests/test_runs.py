import os
import tempfile

import pytest

from tests.conftest import SF0001


def test_train_then_predict_end_to_end(spark):
    from revcast.operators.boosting import BoostingParams
    from revcast.plans import runs, store
    from revcast.sources.sinks import read_forecast
    feats = runs.load_daily(spark, SF0001, kind="fixture")
    base = tempfile.mkdtemp(prefix="revcast-run-")
    models = runs.train(spark, feats, os.path.join(base, "models"), params=BoostingParams(rounds=2))
    assert set(models) == {"channel", "campaign_type", "campaign"}
    ev = spark.read.parquet(os.path.join(store.newest(spark, os.path.join(base, "models")), "evaluation")).collect()
    assert {(r["granularity"], r["fold"], r["quantile"]) for r in ev} == {(g, k, q) for g in models for k in range(5) for q in (0.1, 0.5, 0.9)}
    uri, _ = runs.load_models(spark, "file://" + os.path.join(base, "models"))
    assert set(uri) == set(models)
    with pytest.raises(Exception):
        runs.load_models(spark, os.path.join(base, "nowhere"))
    fc = runs.predict(spark, feats, os.path.join(base, "out"), os.path.join(base, "models"))
    exported = read_forecast(spark, os.path.join(base, "out", "predictions"))
    assert exported.count() == fc.count() > 0
    report = [r["value"] for r in spark.read.text(os.path.join(base, "out", "causal_summary")).collect()]
    assert report[1] == "PROBABILISTIC REVENUE FORECAST — CAUSAL SUMMARY"
    assert any(line.startswith("## ACTIONABLE RECOMMENDATIONS") for line in report)
    assert report[-2] == "End of Causal Summary Report"
    rows = fc.collect()
    assert all(r["revenue_p10"] <= r["revenue_p50"] <= r["revenue_p90"] for r in rows)
