"""Importance ranking (W6), top-N features (O2) and the revenue-driver table.

The importance table has one row per (granularity, quantile, feature); every
window here is partitioned by (granularity, quantile), i.e. bounded by the
feature count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.functions.explain import explain_feature, explain_feature_short


def ranked(imp: DataFrame) -> DataFrame:
    """Rank (1 = most important) and percent of the (granularity, quantile) total."""
    part = Window.partitionBy("granularity", "quantile")
    rank = F.row_number().over(part.orderBy(F.col("importance").desc(), F.col("feature")))
    total = F.sum("importance").over(part)
    return imp.select("*", rank.alias("rank"),
                      F.when(total > 0, F.col("importance") / total * 100).otherwise(F.lit(0.0)).alias("pct_of_all"))


def top_features(imp: DataFrame, granularity: str = "campaign", quantile: float = 0.5, n: int = 10,
                 short: bool = False) -> DataFrame:
    """O2: top-N features; ``pct_of_all`` divides by all features (report), ``pct_of_top`` by the top N (dashboard)."""
    r = ranked(imp.where((F.col("granularity") == granularity) & (F.col("quantile") == quantile)))
    top = r.where(F.col("rank") <= n)
    top_total = F.sum("importance").over(Window.partitionBy("granularity", "quantile"))
    explain = explain_feature_short if short else explain_feature
    return top.select("granularity", "quantile", "rank", "feature", "importance", "pct_of_all",
                      F.when(top_total > 0, F.col("importance") / top_total * 100).otherwise(F.lit(0.0))
                       .alias("pct_of_top"),
                      explain(F.col("feature")).alias("explanation"))


def drivers(imp: DataFrame, n: int = 10) -> DataFrame:
    """The top-10 campaign/P50 drivers plus the narrative flags computed from the top 3."""
    top = top_features(imp, "campaign", 0.5, n)
    top3 = top.where(F.col("rank") <= 3).agg(F.collect_list("feature").alias("_t3"))   # three names
    flags = top3.select(
        (F.array_contains("_t3", "roas") | F.array_contains("_t3", "roas_roll_7d_mean")).alias("roas_driven"),
        F.array_contains("_t3", "spend").alias("spend_driven"),
        F.exists("_t3", lambda f: f.contains("roll")).alias("rolling_driven"))
    return top.select("*", *[flags.select(c).scalar().alias(c)
                             for c in ("roas_driven", "spend_driven", "rolling_driven")])


def explain_names(names: DataFrame, col: str = "feature") -> DataFrame:
    """P22 on a column of feature names: long and short explanations."""
    return names.select(col, explain_feature(F.col(col)).alias("explanation"),
                        explain_feature_short(F.col(col)).alias("short_explanation"))
