from pyspark.sql import functions as F

from revcast.operators.chunked import clean_chunked, engineer_features_chunked
from revcast.operators.clean import clean
from revcast.operators.features import engineer_features
from revcast.sources.fixture import ad_daily
from tests.conftest import SF0001


def _rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(round(r[c], 6) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())


def test_chunked_equals_single_partition(spark):
    raw = ad_daily(spark, SF0001)
    # tiny chunks: every series is cut many times, halos and fill carries are exercised
    c1, c2 = clean(raw), clean_chunked(raw, 37)
    assert _rows(c1) == _rows(c2)
    f1, f2 = engineer_features(c1), engineer_features_chunked(c1, 41)
    assert f1.columns == f2.columns
    assert _rows(f1) == _rows(f2)


def test_chunked_fill_across_chunks(spark):
    import datetime as dt
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=i), "g", "T", "c", "c", 1.0, 1.0, 1, 1, None,
             7.0 if i == 5 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "date date, channel string, campaign_type string, campaign_name string, "
                                     "campaign_id string, revenue double, spend double, clicks bigint, "
                                     "impressions bigint, conversions double, daily_budget double")
    got = [r["daily_budget"] for r in clean_chunked(df, 3).orderBy("date").collect()]
    assert got == [7.0] * 12
    assert clean_chunked(df, 3).where(F.col("daily_budget").isNull()).count() == 0


def test_load_daily_of_vendor_files_equals_plain_windows(spark):
    import os
    import tempfile

    from revcast.plans import runs
    from revcast.sources.vendors import load_all_channels
    d = tempfile.mkdtemp(prefix="revcast-skew-")
    lines = ["TimePeriod,CampaignType,CampaignName,CampaignId,Revenue,Spend,Clicks,Impressions,Conversions,DailyBudget"]
    for i in range(120):   # one hot series: 3 ids share a name
        for cid in (1, 2, 3):
            lines.append(f"2024-01-{1 + i % 28:02d},Search,HOT,{cid}{i},{i % 7},{1 + i % 3},1,1,0,{'' if i % 5 else 10}")
    with open(os.path.join(d, "bing.csv"), "w") as f:
        f.write("\n".join(lines) + "\n")
    assert _rows(runs.load_daily(spark, d)) == _rows(engineer_features(clean(load_all_channels(spark, d))))
