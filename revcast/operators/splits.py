"""Chronological index (W7), expanding-window CV folds (M2) and the 80/20
holdout (M3).

``ordered_index`` numbers rows 0..n-1 in a total order without a
single-partition window: a range-partitioned global sort, then each row's
position inside its partition plus the row count of all earlier partitions.
The per-partition count table has one row per partition, so its broadcast is
bounded by the partition count, not by the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast import constants as K

CHRONO_ORDER = ["date", "channel", "campaign_type", "campaign_name", "campaign_id"]


def ordered_index(df: DataFrame, order_cols: list, name: str = "idx") -> DataFrame:
    from revcast.plans.daily import materialize  # late import: plans depend on operators

    tagged = (df.orderBy(*order_cols)
                .withColumn("_pid", F.spark_partition_id())
                .withColumn("_mid", F.monotonically_increasing_id()))
    fixed = materialize(tagged, "index")            # pid / position are now stored values
    per_part = fixed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_base"))
    # one row per partition: a cumulative sum over it is tiny
    offsets = per_part.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
                           F.lit(0)))
    out = fixed.join(F.broadcast(offsets.select("_pid", "_off", "_base")), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_base")).drop("_pid", "_mid", "_off", "_base")


def chrono_index(df: DataFrame, order_cols: list | None = None) -> DataFrame:
    """Row index in (date, channel, type, name, id) order (D10: ties broken by keys)."""
    cols = [c for c in (order_cols or CHRONO_ORDER) if c in df.columns]
    return ordered_index(df, cols, "idx")


def cv_fold_bounds(n, n_splits: int = K.CV_FOLDS) -> list:
    """[(fold, test_start, test_end)] for an expanding window with test size n // (k+1)."""
    ts = n // (n_splits + 1)
    return [(i, n - (n_splits - i) * ts, n - (n_splits - i) * ts + ts) for i in range(n_splits)]


def cv_assign(indexed: DataFrame, n_splits: int = K.CV_FOLDS) -> DataFrame:
    """Explode each indexed row into (fold, role) memberships: train if idx < test_start,
    test if test_start <= idx < test_start + n // (k + 1).  ``n`` is a scalar subquery."""
    n = indexed.select(F.count(F.lit(1))).scalar()
    base = indexed.withColumns({"_n": n, "_ts": F.floor(n / (n_splits + 1)).cast("bigint")})
    idx, n_col, ts = F.col("idx"), F.col("_n"), F.col("_ts")

    def role(i):
        start = n_col - (F.lit(n_splits) - i) * ts
        return F.struct(i.alias("fold"),
                        F.when(idx < start, F.lit("train"))
                         .when((idx >= start) & (idx < start + ts), F.lit("test")).alias("role"))

    member = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), role),
                      lambda m: m["role"].isNotNull())
    return base.select("*", F.inline(member)).drop("_n", "_ts")


def holdout_assign(indexed: DataFrame, fraction: float = K.HOLDOUT_FRACTION) -> DataFrame:
    """First int(n * 0.8) rows train, the rest validation."""
    n = indexed.select(F.count(F.lit(1))).scalar()
    split = F.floor(n * F.lit(fraction)).cast("bigint")
    return indexed.withColumn("role", F.when(F.col("idx") < split, F.lit("train")).otherwise(F.lit("valid")))
