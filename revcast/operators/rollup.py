"""Daily rollup to a granularity (A1) and the latest feature row per group.

Channel / type level: one row per (date, keys) with volumes and revenue
summed, every other numeric feature averaged over the campaigns of that day,
and ROAS recomputed from the sums.  Campaign level passes rows through
unmerged (two ids sharing a name stay two rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from revcast import constants as K
from revcast.functions.expr import safe_ratio


def numeric_features(df: DataFrame) -> list[str]:
    """Numeric columns minus identifiers/target/leak columns and categoricals."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType)
            and f.name not in K.EXCLUDE_COLS and f.name not in K.CATEGORICAL_COLS]


def rollup_columns(df: DataFrame) -> tuple[list[str], list[str]]:
    num = numeric_features(df)
    sums = [c for c in K.SUM_COLS if c in df.columns]
    means = [c for c in num if c not in sums]
    return sums, means


def daily_rollup(features: DataFrame, granularity: str) -> DataFrame:
    keys = K.GRANULARITIES[granularity]
    if granularity == "campaign":
        return features
    sums, means = rollup_columns(features)
    out = features.groupBy("date", *keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.avg(c).alias(c) for c in means],
        F.sum("revenue").alias("revenue"))
    return out.withColumn("roas", safe_ratio(F.col("revenue"), F.col("spend")))


def latest_rows(rolled: DataFrame, granularity: str) -> DataFrame:
    """Latest row per group (date, then type and id as tie-break) via max_by."""
    keys = K.GRANULARITIES[granularity]
    order = [c for c in ["date", "campaign_type", "campaign_id"] if c in rolled.columns and c not in keys]
    if "date" not in order:
        order = ["date", *order]
    rest = [c for c in rolled.columns if c not in keys]
    picked = rolled.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
