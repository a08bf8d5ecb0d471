import datetime as dt

from pyspark.sql import functions as F

from revcast.operators.clean import clean, cleaning_audit, fill_budget
from revcast.operators.features import engineer_features

SCHEMA = ("date date, channel string, campaign_type string, campaign_name string, campaign_id string, "
          "revenue double, spend double, clicks bigint, impressions bigint, conversions double, daily_budget double")


def day(i):
    return dt.date(2024, 1, 1) + dt.timedelta(days=i)


def rows(name, budgets, rev=10.0, spend=5.0):
    return [(day(i), "google", "SEARCH", name, name, rev, spend, 2, 10, 1.0, b) for i, b in enumerate(budgets)]


def test_budget_gaps(spark):
    data = (rows("lead", [None, 5.0, 6.0]) + rows("inner", [5.0, None, 7.0]) + rows("trail", [5.0, 6.0, None])
            + rows("none", [None, None]))
    out = fill_budget(spark.createDataFrame(data, SCHEMA)).orderBy("campaign_name", "date").collect()
    got = {}
    for r in out:
        got.setdefault(r["campaign_name"], []).append(r["daily_budget"])
    assert got == {"lead": [5.0, 5.0, 6.0], "inner": [5.0, 5.0, 7.0], "trail": [5.0, 6.0, 6.0], "none": [0.0, 0.0]}


def test_activity_filter_and_audit(spark):
    data = [(day(0), "google", "SEARCH", "a", "a", 0.0, 0.0, 0, 0, 0.0, 1.0),
            (day(1), "google", "SEARCH", "a", "a", 0.0, 5.0, 0, 0, 0.0, 1.0),
            (day(2), "google", "SEARCH", "a", "a", 5.0, 0.0, 0, 0, 0.0, 1.0),
            (day(3), "google", "SEARCH", "a", "a", None, 0.0, 0, 0, 0.0, None)]
    df = spark.createDataFrame(data, SCHEMA)
    kept = sorted(r["date"] for r in clean(df).collect())
    assert kept == [day(1), day(2), day(3)]
    a = cleaning_audit(df).first()
    assert a["rows_in"] == a["rows_out"] + a["zero_activity_rows"]
    assert (a["null_budgets"], a["still_null_budgets"], a["zero_activity_rows"]) == (1, 0, 1)


def test_rolling_and_momentum(spark):
    revs = [10.0, 20.0, 30.0, 40.0]
    data = [(day(i), "bing", "SEARCH", "c", "c", r, 0.0 if i == 0 else 10.0, 0 if i == 0 else 4, 1, None, 8.0)
            for i, r in enumerate(revs)]
    f = engineer_features(spark.createDataFrame(data, SCHEMA)).orderBy("date").collect()
    assert [r["revenue_roll_7d_mean"] for r in f] == [10.0, 15.0, 20.0, 25.0]
    assert f[0]["revenue_roll_7d_std"] == 0.0                       # one row: std NULL -> 0
    assert abs(f[1]["revenue_roll_7d_std"] - 7.0710678) < 1e-6
    assert f[0]["roas"] == 0.0 and f[1]["roas"] == 2.0               # guarded ratio
    assert f[0]["cpc"] == 0.0 and f[0]["cvr"] == 0.0                 # clicks 0 / conversions NULL
    assert [r["days_since_campaign_start"] for r in f] == [0, 1, 2, 3]
    assert all(r["revenue_momentum"] == 1.0 for r in f)              # 7-row == 30-row mean here
    assert f[0]["day_of_week"] == 0 and f[0]["week_of_year"] == 1    # 2024-01-01 is a Monday, ISO week 1


def test_feature_table_shape(features_small):
    assert len(features_small.columns) == 41
    assert features_small.where(F.col("revenue").eqNullSafe(0) & F.col("spend").eqNullSafe(0)).count() == 0
