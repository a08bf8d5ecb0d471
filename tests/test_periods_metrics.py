"""Mergeable period states and quantiles of prefixes, against plain recomputations."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest

from revcast import constants as K
from revcast.operators.clean import clean
from revcast.operators.features import engineer_features
from revcast.operators.metrics import constant_quantile_cv, prefix_order_statistics, prefix_quantiles
from revcast.operators.periods import period_features
from revcast.operators.splits import cv_fold_bounds
from revcast.sources.fixture import ad_daily
from tests.conftest import SF0001


def indexed(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "idx long, revenue double").repartition(4)


@pytest.mark.parametrize("kind", ["normal", "ties", "far", "tiny", "near", "nulls", "one"])
def test_prefix_quantiles(spark, kind):
    rnd = np.random.default_rng(3)
    n = 700
    values = {"normal": rnd.standard_normal(n) * 100, "ties": rnd.integers(0, 4, n) * 0.1, "far": rnd.standard_normal(n) * 10.0 ** rnd.integers(-300, 300, n),
              "tiny": rnd.integers(0, 5, n) * 5e-324, "near": 1e15 + rnd.integers(0, 9, n) * 0.125, "nulls": rnd.standard_normal(n), "one": np.full(n, 7.5)}[kind].tolist()
    if kind == "far":
        values[10], values[650] = 1.7e308, -1.7e308
    if kind == "nulls":
        values = [None if i % 3 else v for i, v in enumerate(values)]
    starts = [1, 100, 350, 700, 900]
    df = indexed(spark, values)
    got = prefix_quantiles(df, starts)
    for s in starts:
        own = [v for v in values[:s] if v is not None]
        for q in K.QUANTILES:
            if kind == "far":
                assert got[s, q] == pytest.approx(float(np.quantile(own, q)), rel=1e-9)
            else:
                assert got[s, q] == pytest.approx(float(np.quantile(own, q)), rel=1e-12, abs=1e-300)
    ranks = [(s, r) for s in starts for r in {0, s // 2}]
    for (s, r), v in prefix_order_statistics(df, "revenue", ranks).items():
        assert v == sorted(v for v in values[:s] if v is not None)[r]


def test_prefix_quantiles_without_rows(spark):
    df = indexed(spark, [None, None])
    assert prefix_quantiles(df, [1, 2]) == {} and prefix_order_statistics(df, "revenue", [(2, 0)]) == {}
    assert prefix_order_statistics(indexed(spark, [1.0, 2.0]), "revenue", [(2, 1), (2, 2)]) == {(2, 1): 2.0}
    assert constant_quantile_cv(indexed(spark, []).limit(0)).count() == 0


def test_fold_scores(spark):
    rnd = np.random.default_rng(5)
    y = rnd.exponential(10, 400)
    got = {(r["fold"], r["quantile"]): r for r in constant_quantile_cv(indexed(spark, y.tolist())).collect()}
    assert len(got) == 15
    for fold, start, end in cv_fold_bounds(400):
        for q in K.QUANTILES:
            e = y[start:end] - np.quantile(y[:start], q)
            assert got[fold, q]["pinball_loss"] == pytest.approx(np.mean(np.where(e >= 0, q * e, (q - 1) * e)))
            assert got[fold, q]["coverage"] == pytest.approx(np.mean(e <= 0))


def shared_names(spark):
    """Names with several ids, names in several types, gaps, nulls, and values that lie far from zero but near each other."""
    rnd = random.Random(2)
    rows = []
    for name in ("a", "b", "c"):
        for kind in ("SEARCH", "VIDEO") if name != "c" else ("SEARCH",):
            for cid in range(1 + (name == "a")):
                for d in range(120):
                    if rnd.random() < 0.7:
                        rows.append((dt.date(2024, 1, 1) + dt.timedelta(days=d), "bing" if name == "b" else "google", kind, name, f"{name}{kind}{cid}", 1e8 + rnd.random(), rnd.randint(1, 9) * 1.5,
                                     rnd.randint(0, 5), rnd.randint(1, 50), None if d % 4 else 2.0, None if d % 5 else 30.0))
    return spark.createDataFrame(rows, "date date, channel string, campaign_type string, campaign_name string, campaign_id string, revenue double, spend double, clicks long, impressions long, conversions double, daily_budget double")


def test_period_states_merge_to_the_raw_rows(spark):
    feats = engineer_features(clean(shared_names(spark))).cache()
    rows = feats.collect()
    last = max(r["date"] for r in rows)
    got = {(p["forecast_horizon"], p["granularity"], p["channel"], p["campaign_type"], p["campaign_name"]): p for p in period_features(feats).collect()}
    groups = {}
    for r in rows:
        for h in K.HORIZONS:
            if r["date"] > last - dt.timedelta(days=h):
                for g, keys in K.GRANULARITIES.items():
                    groups.setdefault((h, g, *[r[k] if k in keys else K.ALL for k in K.CATEGORICAL_COLS]), []).append(r)
    assert got.keys() == groups.keys() and len(got) == 3 * 11
    for key, part in groups.items():
        p = got[key]
        mean = lambda c: statistics.fmean(r[c] for r in part if r[c] is not None)
        assert p["active_days"] == len({r["date"] for r in part}) and p["num_campaigns"] == len({r["campaign_name"] for r in part})
        assert p["total_revenue"] == pytest.approx(sum(r["revenue"] for r in part)) and p["total_clicks"] == sum(r["clicks"] for r in part)
        assert p["total_conversions"] == pytest.approx(sum(r["conversions"] or 0 for r in part))
        for ours, c in (("mean_daily_revenue", "revenue"), ("mean_roas", "roas"), ("mean_cvr", "cvr"), ("mean_daily_budget", "daily_budget"), ("weekend_ratio", "is_weekend")):
            assert p[ours] == pytest.approx(mean(c), rel=1e-12), (key, ours)
        for ours, c in (("std_daily_revenue", "revenue"), ("std_daily_spend", "spend")):
            want = statistics.stdev([r[c] for r in part]) if len(part) > 1 else 0.0
            assert p[ours] == pytest.approx(want, rel=1e-5), (key, ours)
        newest = max(part, key=lambda r: (r["campaign_name"], r["date"], r["campaign_type"], r["campaign_id"]))
        assert all(p[c] == newest[c] for c in K.CARRY_FORWARD_COLS)


def test_only_states_are_multiplied_by_grouping_sets(features_small):
    plan = period_features(features_small)._jdf.queryExecution().optimizedPlan().toString()
    expand = plan[plan.index("Expand"):]
    assert plan.count("Expand") == 1 and "Aggregate [forecast_horizon" in expand and "count(distinct" not in plan


def test_one_exchange_by_campaign_from_sources(spark):
    df = engineer_features(clean(ad_daily(spark, SF0001)))
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[0]
    by_campaign = [x for x in plan.splitlines() if "Exchange hashpartitioning(channel" in x and "date" not in x.split("Exchange")[1].split(")")[0]]
    assert len(by_campaign) == 1, by_campaign
