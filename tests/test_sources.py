import os
import tempfile

import pytest

from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from revcast.sources.vendors import DATE_FORMATS, LAYOUTS, NoInputError, header_names, load_all_channels, parse_date, unified_of

GOOGLE = """,segments_date,campaign_advertising_channel_type,campaign_name,campaign_id,metrics_conversions_value,metrics_cost_micros,metrics_clicks,metrics_impressions,metrics_conversions,campaign_budget_amount
0,2024-01-01,SEARCH,G1,11,100.5,2500000,10,100,2.0,50
1,2024-01-02,DEMAND_GEN,G1,11,0,0,0,0,0,
"""
BING = """TimePeriod,CampaignType,CampaignName,CampaignId,Revenue,Spend,Clicks,Impressions,Conversions,DailyBudget
2024-01-01,PerformanceMax,B1,21,10,5,3,30,1,20
2024-01-01,Display,B2,22,1,1,1,1,0,
"""
META = """date_start,campaign_name,campaign_id,conversion,spend,clicks,impressions,daily_budget
2024-01-01,Prospecting_DPA_1,31,2000.0,100.0,12.7,340.9,150
2024-01-01,Odd_1,32,1.0,1.0,1.0,1.0,
"""


def write(d, name, text):
    with open(os.path.join(d, name), "w") as f:
        f.write(text)


def test_vendor_union(spark):
    d = tempfile.mkdtemp(prefix="revcast-src-")
    write(d, "Google_Ads_export.csv", GOOGLE)
    write(d, "ms_BING.csv", BING)
    write(d, "meta_ads.csv", META)
    write(d, "notes.csv", "a,b\n1,2\n")
    df = load_all_channels(spark, d)
    assert df.columns == ["date", "channel", "campaign_type", "campaign_name", "campaign_id", "revenue", "spend",
                          "clicks", "impressions", "conversions", "daily_budget"]
    rows = {(r["channel"], r["campaign_name"], str(r["date"])): r for r in df.collect()}
    g = rows[("google", "G1", "2024-01-01")]
    assert g["spend"] == 2.5 and g["campaign_type"] == "SEARCH" and g["campaign_id"] == "11"
    assert rows[("google", "G1", "2024-01-02")]["campaign_type"] == "DEMAND_GEN"
    assert rows[("google", "G1", "2024-01-02")]["daily_budget"] is None
    assert rows[("bing", "B1", "2024-01-01")]["campaign_type"] == "PERFORMANCE_MAX"
    assert rows[("bing", "B2", "2024-01-01")]["campaign_type"] == "OTHER"
    m = rows[("meta", "Prospecting_DPA_1", "2024-01-01")]
    assert (m["revenue"], m["clicks"], m["impressions"], m["conversions"]) == (2000.0, 12, 340, None)
    assert m["campaign_type"] == "PROSPECTING"
    assert rows[("meta", "Odd_1", "2024-01-01")]["campaign_type"] == "OTHER"


def test_missing_inputs(spark):
    empty = tempfile.mkdtemp(prefix="revcast-empty-")
    with pytest.raises(NoInputError):
        load_all_channels(spark, empty)
    write(empty, "other.csv", "a\n1\n")
    with pytest.raises(NoInputError):
        load_all_channels(spark, empty)


def test_two_files_of_a_vendor_with_other_columns(spark):
    d = tempfile.mkdtemp(prefix="revcast-two-")
    write(d, "bing_1.csv", BING)
    write(d, "BING_2.csv", "\ufeffidx,Spend,Revenue,TimePeriod,CampaignType,\"CampaignName\",CampaignId,Clicks,Impressions,Conversions,DailyBudget,Note\n"
          "7,5,10,1/2/2024,Search,\"B, three\",23,4,40,1,,x\n")
    rows = {r["campaign_name"]: r for r in load_all_channels(spark, "file://" + d).collect()}
    assert set(rows) == {"B1", "B2", "B, three"}
    r = rows["B, three"]
    assert (str(r["date"]), r["revenue"], r["spend"], r["clicks"], r["daily_budget"]) == ("2024-01-02", 10.0, 5.0, 4, None)
    assert (rows["B1"]["revenue"], rows["B1"]["spend"]) == (10.0, 5.0)


def test_bad_date_and_missing_column_raise(spark):
    d = tempfile.mkdtemp(prefix="revcast-bad-")
    write(d, "bing.csv", BING.replace("2024-01-01,Display", "soon,Display"))
    with pytest.raises(PySparkException):
        load_all_channels(spark, d).collect()
    d = tempfile.mkdtemp(prefix="revcast-column-")
    write(d, "bing.csv", BING.replace("Revenue", "Income"))
    with pytest.raises(ValueError):
        load_all_channels(spark, d)
    with pytest.raises(NoInputError):
        load_all_channels(spark, d + "/nowhere")


def folder(**files):
    d = tempfile.mkdtemp(prefix="revcast-csv-")
    for name, text in files.items():
        write(d, f"{name}.csv", text)
    return d


def test_comma_and_doubled_quotes_in_a_header(spark):
    text = BING.replace("CampaignId,", 'CampaignId,"Max, bid","the ""best"" note",').replace(",21,", ',21,"9,5","x ""y""",').replace(",22,", ",22,,,")
    rows = {r["campaign_name"]: r for r in load_all_channels(spark, folder(bing=text)).collect()}
    assert (rows["B1"]["revenue"], rows["B1"]["spend"], rows["B1"]["clicks"], rows["B1"]["impressions"]) == (10.0, 5.0, 3, 30)
    assert (rows["B2"]["revenue"], rows["B2"]["daily_budget"]) == (1.0, None)


def test_line_breaks_in_quoted_cells(spark):
    """Also with small splits, so that records, and the quotes they are told by, cross them."""
    names = [f'"B{i}, ""x""\n\nline {i}\nend"' if i % 3 else f"B{i}" for i in range(200)]
    body = "".join(f"2024-01-0{1 + i % 9},Search,{n},{i},1,2,3,4,5,6\n" for i, n in enumerate(names))
    head = BING.split("\n")[0].replace("CampaignName", '"CampaignName"').replace("Spend", "Spend,\"two\nlines\"").replace(",Spend", ",Spend")
    d = folder(bing_1=head.replace(',"two\nlines"', "") + "\n" + body, bing_2=BING,
               bing_3=head + "\n2024-01-01,Search,\"a\nb\",900,1,2,,3,4,5,6\n")
    want = {(str(i), n.strip('"').replace('""', '"')) for i, n in enumerate(names)} | {("21", "B1"), ("22", "B2"), ("900", "a\nb")}
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (small, "700"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = load_all_channels(spark, d).collect()
            assert {(r["campaign_id"], r["campaign_name"]) for r in rows} == want and len(rows) == len(want)
            assert {(r["revenue"], r["spend"], r["clicks"], r["impressions"], r["daily_budget"]) for r in rows if r["campaign_id"] not in ("21", "22")} == {(1.0, 2.0, 3, 4, 6.0)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)


@pytest.mark.parametrize("old, new", [
    (",3,30,1,20", ",,30,1,20"),                 # empty clicks
    (",3,30,1,20", ",3,,1,20"),                  # empty impressions
    (",3,30,1,20", ""),                          # a row cut short
    (",3,30,1,20", ",3,30,1"),                   # one cell short
    (",3,30,1,20", ",3,30,1,20,7"),              # one cell too many
    (",3,30,1,20", ",many,30,1,20"),             # not a number
    (",B1,", ',B"1",'),                          # quotes amid a cell
    (",B1,", ',"B1"x,'),                         # text after quotes
    (",B1,", ',"B1,'),                           # quotes left open
])
def test_what_a_strict_reader_does_not_take(spark, old, new):
    assert old in BING
    with pytest.raises(PySparkException):
        load_all_channels(spark, folder(bing=BING.replace(old, new, 1))).collect()


def test_whole_numbers_with_decimals_are_cut_off(spark):
    rows = load_all_channels(spark, folder(bing=BING.replace(",3,30,", ",3.9,30.0,"))).collect()
    assert {(r["clicks"], r["impressions"]) for r in rows} == {(3, 30), (1, 1)}



@pytest.mark.parametrize("file", ["'f'", "concat('f', substr(i, 1, 0))"])
def test_records_stay_in_their_tasks(spark, file):
    """Rows made on the driver have no known size: neither they nor a constant file may gather the records in one task."""
    head, record = BING.split("\n")[:2]
    names = header_names(head)
    heads = spark.createDataFrame([("f", len(names), [names.index(c) for c in LAYOUTS["bing"]])], "file string, width int, places array<int>")
    records = spark.range(400, numPartitions=4).withColumnRenamed("id", "i").select(
        F.expr(file).alias("file"), F.lit("bing").alias("channel"), F.replace(F.lit(record), F.lit(",21,"), F.concat(F.lit(","), F.col("i"), F.lit(","))).alias("record"))
    rows = unified_of(records, heads).select("campaign_id", F.spark_partition_id().alias("task")).collect()
    assert {int(r["campaign_id"]) for r in rows} == set(range(400)) and len(rows) == 400
    assert len({r["task"] for r in rows}) == 4


def test_a_record_is_cut_once_and_a_date_tried_once_a_format(spark):
    """In the plan, since only the time tells otherwise; and no try that its text is sure to fail."""
    lines, head = spark.createDataFrame([("f", "bing", BING.split("\n")[1])], "file string, channel string, record string"), header_names(BING.split("\n")[0])
    heads = spark.createDataFrame([("f", len(head), [head.index(c) for c in LAYOUTS["bing"]])], "file string, width int, places array<int>")
    plan = unified_of(lines, heads)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    dates = unified_of(lines.withColumn("channel", F.lit("bing")), heads).select("date")._jdf.queryExecution().optimizedPlan().toString()
    assert dates.count("gettimestamp(") == len(DATE_FORMATS) and dates.count("Contains(") + dates.count("instr(") >= 4


def test_dates_and_counts_in_each_form(spark):
    dates = {"2024-01-02": "2024-01-02", "2024-01-02 03:04:05": "2024-01-02", "2024/01/02": "2024-01-02", "1/2/2024": "2024-01-02", "12/31/2024": "2024-12-31",
             "20240102": "2024-01-02", "+12024/01/02": "+12024-01-02", "  ": None}
    rows = spark.createDataFrame([(d,) for d in dates], "d string").select("d", parse_date(F.col("d")).cast("string").alias("date")).collect()
    assert {r["d"]: r["date"] for r in rows} == dates
    for bad in ("2024/1/2", "2024-1-2", "13/02/2024", "2024-01-02T03:04:05", "2024-01-02 03:04", "1/2/24"):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "d string").select(parse_date(F.col("d"))).collect()
    rows = load_all_channels(spark, folder(bing=BING.replace(",3,30,", ",9007199254740993,1e3,").replace(",1,1,0,", ",-1.9, 7 ,0,"))).collect()
    assert {(r["clicks"], r["impressions"]) for r in rows} == {(9007199254740993, 1000), (-1, 7)}
