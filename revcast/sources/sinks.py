"""Sinks and scans of derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from revcast.operators.forecast import EXPORT_COLUMNS, format_forecast, sort_forecast

FORECAST_CSV_SCHEMA = (
    "forecast_horizon int, granularity string, channel string, campaign_type string, campaign_name string, "
    "revenue_p10 double, revenue_p50 double, revenue_p90 double, roas_p10 double, roas_p50 double, "
    "roas_p90 double, projected_spend double, budget_multiplier double, historical_daily_revenue double, "
    "historical_daily_spend double, days_in_window int")


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Engineered daily table; parquet partitioned by channel by default."""
    w = df.write.mode("overwrite")
    if fmt == "parquet":
        w.partitionBy("channel").parquet(path)
    else:
        w.option("header", True).csv(path)


def write_forecast(fc: DataFrame, path: str, fmt: str = "csv") -> None:
    """The 16 exported columns, rounded, globally sorted (part files stay in order)."""
    out = sort_forecast(format_forecast(fc, export=True))
    if fmt == "csv":
        out.write.mode("overwrite").option("header", True).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def read_forecast(spark: SparkSession, path: str) -> DataFrame:
    """Forecast CSV with an explicit schema (no inference)."""
    return spark.read.schema(FORECAST_CSV_SCHEMA).option("header", True).csv(path)


def write_importances(imp: DataFrame, path: str) -> None:
    """S9."""
    imp.orderBy("granularity", "quantile", F.col("importance").desc(), "feature") \
       .write.mode("overwrite").option("header", True).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines in the order of their sort keys as text."""
    lines.orderBy(*[c for c in lines.columns if c != "line"]).select("line").write.mode("overwrite").text(path)


def json_clean(df: DataFrame) -> DataFrame:
    """Numeric NaN / +-Inf / NULL -> 0, then one JSON record per row."""
    from revcast.functions.expr import finite_or_zero
    frac = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    integral = [f.name for f in df.schema.fields
                if isinstance(f.dataType, NumericType) and f.name not in frac]
    cleaned = df.withColumns({**{c: finite_or_zero(F.col(c)) for c in frac},
                              **{c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in integral}})
    return cleaned.withColumn("record_json", F.to_json(F.struct(*[F.col(c) for c in df.columns])))


def write_json(df: DataFrame, path: str) -> None:
    json_clean(df).select("record_json").write.mode("overwrite").text(path)


__all__ = ["EXPORT_COLUMNS", "FORECAST_CSV_SCHEMA", "write_features", "write_forecast", "read_forecast",
           "write_importances", "write_report", "json_clean", "write_json"]
