"""The unified daily fact table derived from the star-schema test tables.

``ad_daily`` re-expresses FIXTURES.md section 2 with the DataFrame API: one row per
(date, channel, campaign_type, campaign_name), same 11 columns as the vendor
loaders produce.  Only the needed columns are read (column pruning reaches the
parquet scan); the join is left to Catalyst/AQE (broadcast when ``part`` is
small, sort-merge when it is not — no forced broadcast of a table that grows
with the scale factor).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.constants import UNIFIED_COLUMNS
from revcast.session import table_path

# FIXED VALUES of the fixture definition (FIXTURES.md section 2).
FIXTURE_CHANNEL_BY_FLAG = {"A": "google", "N": "bing"}          # else meta
FIXTURE_TYPE_BY_PART = {
    "ECONOMY": "SEARCH", "STANDARD": "PERFORMANCE_MAX", "PROMO": "SHOPPING",
    "SMALL": "DISPLAY", "MEDIUM": "AUDIENCE",
}                                                              # else OTHER
FIXTURE_PAUSED = [
    ("bing", "AUDIENCE", "2001-06-01"),
    ("google", "DISPLAY", "2001-09-01"),
]
FIXTURE_SPARSE_META_CAMPAIGN = "PROMO_Campaign_F"


def _case(col, mapping: dict, default: str):
    expr = None
    for k, v in mapping.items():
        expr = F.when(col == k, F.lit(v)) if expr is None else expr.when(col == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def ad_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spark.read.parquet(table_path(sf_dir, "lineitem")).select(
        "l_partkey", "l_shipdate", "l_returnflag", "l_linestatus",
        "l_extendedprice", "l_tax", "l_quantity", "l_linenumber")
    part = spark.read.parquet(table_path(sf_dir, "part")).select("p_partkey", "p_type")
    src = (li.join(part, li.l_partkey == part.p_partkey)
             .select(F.col("l_shipdate").cast("date").alias("date"),
                     _case(F.col("l_returnflag"), FIXTURE_CHANNEL_BY_FLAG, "meta").alias("channel"),
                     _case(F.col("p_type"), FIXTURE_TYPE_BY_PART, "OTHER").alias("campaign_type"),
                     F.concat(F.col("p_type"), F.lit("_Campaign_"), F.col("l_linestatus")).alias("campaign_name"),
                     "l_extendedprice", "l_tax", "l_quantity", "l_linenumber"))
    keep = None
    for ch, ty, since in FIXTURE_PAUSED:
        cond = ~((F.col("channel") == ch) & (F.col("campaign_type") == ty)
                 & (F.col("date") >= F.lit(since).cast("date")))
        keep = cond if keep is None else keep & cond
    keep = keep & ~((F.col("channel") == "meta")
                    & (F.col("campaign_name") == FIXTURE_SPARSE_META_CAMPAIGN)
                    & (F.dayofmonth("date") != 1))
    big = F.col("l_quantity") >= 10
    agg = (src.where(keep)
              .groupBy("date", "channel", "campaign_type", "campaign_name")
              .agg(F.sum(F.when(big, F.col("l_extendedprice")).otherwise(F.lit(0.0))).alias("revenue"),
                   F.sum(F.col("l_quantity") * F.col("l_tax") * 10000).alias("spend"),
                   F.sum("l_quantity").cast("bigint").alias("clicks"),
                   F.sum(F.col("l_quantity") * F.col("l_linenumber") * 10).cast("bigint").alias("impressions"),
                   F.sum(F.when(big, 1).otherwise(0)).cast("double").alias("_conv"),
                   F.max("l_extendedprice").alias("_maxprice")))
    return agg.select(
        "date", "channel", "campaign_type", "campaign_name",
        F.concat(F.col("channel"), F.lit("-"), F.col("campaign_name")).alias("campaign_id"),
        "revenue", "spend", "clicks", "impressions",
        F.when(F.col("channel") == "meta", F.lit(None).cast("double")).otherwise(F.col("_conv")).alias("conversions"),
        F.when(F.dayofmonth("date") % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("_maxprice") * 0.2).alias("daily_budget"),
    ).select(*UNIFIED_COLUMNS)
