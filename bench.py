"""Benchmark: headline plans at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each plan is executed end to end with the ``noop`` sink (full computation, no
driver collection).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revcast.plans.registry import REGISTRY  # noqa: E402
from revcast.session import local_session  # noqa: E402

HEADLINE = [
    "clean_daily", "rolling_features", "period_features", "daily_rollup_type",
    "forecast_channel", "forecast_type", "forecast_campaign", "forecast_all",
    "contribution_table", "budget_scenarios", "recommendations",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="revcast-bench")
    # warm the JVM and code generation for every plan on the smallest scale;
    # the cold (first-run) total is reported separately
    cold = time.perf_counter()
    for name in HEADLINE:
        if name in REGISTRY:
            REGISTRY[name].spark(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    cold = round(time.perf_counter() - cold, 3)
    timings = {}
    t0 = time.perf_counter()
    from revcast.plans.daily import feature_daily
    feature_daily(spark, sf_dir)          # land the cleaned and engineered daily tables once (shared below)
    timings["land_daily"] = round(time.perf_counter() - t0, 3)
    # cleaning and windows from the sources, not from a landed table
    from revcast.operators.clean import clean
    from revcast.operators.features import engineer_features
    from revcast.sources.fixture import ad_daily
    for name, plan in (("clean_from_sources", lambda: clean(ad_daily(spark, sf_dir))),
                       ("features_from_sources", lambda: engineer_features(clean(ad_daily(spark, sf_dir))))):
        t0 = time.perf_counter()
        plan().write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        t0 = time.perf_counter()
        REGISTRY[name].spark(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    # model path (the original's run path): train once then score with the stored models
    import tempfile
    from revcast.operators.boosting import BoostingParams
    from revcast.plans import runs
    from revcast.plans.daily import feature_daily
    feats = feature_daily(spark, sf_dir)
    model_dir = tempfile.mkdtemp(prefix="revcast-bench-models-")
    t0 = time.perf_counter()
    runs.train(spark, feats, model_dir, evaluate=False, kind="forest")
    timings["forest_train"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    runs.train(spark, feats, tempfile.mkdtemp(prefix="revcast-bench-boosted-"), evaluate=False, params=BoostingParams(rounds=10))
    timings["boosted_train_10_rounds"] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    runs.predict(spark, feats, tempfile.mkdtemp(prefix="revcast-bench-out-"), model_dir)
    timings["forest_predict_and_report"] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "warmup_sf0.001_sec": cold}))
    spark.stop()


if __name__ == "__main__":
    main()
