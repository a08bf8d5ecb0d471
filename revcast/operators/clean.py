"""Cleaning: budget fill (W1), zero-activity filter (P8), unnamed-column drop (P7), audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAMPAIGN_KEYS = ["channel", "campaign_name"]
# Total order inside a campaign: the fact grain is campaign-day, ties (two ids
# sharing a name) are broken by type and id so results do not depend on partitioning.
CAMPAIGN_ORDER = ["date", "campaign_type", "campaign_id"]


def campaign_window() -> Window:
    """One spec shared by every per-campaign window (one shuffle + one sort).

    A partition holds one campaign's history: at most one row per day per id,
    so its size is bounded by the calendar, not by the data volume.
    """
    return Window.partitionBy(*CAMPAIGN_KEYS).orderBy(*CAMPAIGN_ORDER)


def campaign_window_desc() -> Window:
    """Same partitioning, reversed order: running frames over it look forward in time."""
    return Window.partitionBy(*CAMPAIGN_KEYS).orderBy(*[F.col(c).desc() for c in CAMPAIGN_ORDER])


def _running_last(col, w: Window):
    # growing frame: evaluated incrementally (linear), unlike a shrinking
    # CURRENT ROW .. UNBOUNDED FOLLOWING frame which is re-aggregated per row
    return F.last(col, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))


def filled_budget_expr():
    """ffill (previous non-null), else bfill (next non-null), else 0."""
    b = F.col("daily_budget")
    return F.coalesce(b, _running_last(b, campaign_window()), _running_last(b, campaign_window_desc()), F.lit(0.0))


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed")])


def fill_budget(df: DataFrame) -> DataFrame:
    """Forward fill, then backward fill, then 0, per (channel, campaign_name)."""
    return df.withColumn("daily_budget", filled_budget_expr())


def zero_activity(df: DataFrame):
    """True where revenue = 0 and spend = 0 (NULL never counts as 0)."""
    return F.col("revenue").eqNullSafe(0.0) & F.col("spend").eqNullSafe(0.0)


def drop_zero_activity(df: DataFrame) -> DataFrame:
    return df.where(~zero_activity(df))


def by_campaign(df: DataFrame) -> DataFrame:
    """Hash-partition by campaign for the window stages; every later per-campaign window reuses it.

    No explicit count: the session's shuffle partitions and AQE size it by the data.
    """
    return df.repartition(*CAMPAIGN_KEYS)


def clean(df: DataFrame) -> DataFrame:
    """W1 before P8, as in the original flow (fill sees the zero rows too)."""
    return drop_zero_activity(fill_budget(by_campaign(drop_unnamed(df))))


def cleaning_audit(raw: DataFrame) -> DataFrame:
    """One row: rows in/out, null budgets, still-null after fill, zero-activity rows."""
    b = F.col("daily_budget")
    marked = drop_unnamed(raw).select(
        b.isNull().alias("was_null"),
        F.coalesce(b, _running_last(b, campaign_window()), _running_last(b, campaign_window_desc()))
         .isNull().alias("still_null"),
        zero_activity(raw).alias("zero"))
    return marked.agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count(F.when(F.col("was_null"), 1)).alias("null_budgets"),
        F.count(F.when(F.col("still_null"), 1)).alias("still_null_budgets"),
        F.count(F.when(F.col("zero"), 1)).alias("zero_activity_rows"),
        F.count(F.when(~F.col("zero"), 1)).alias("rows_out"),
    )
