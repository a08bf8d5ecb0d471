"""Skew-safe per-campaign windows for very long series.

A (channel, campaign_name) series is normally one window partition, bounded by
the calendar.  When many ids share one name a single series can hold a large
share of all rows; then the series is cut into chunks of ``chunk_rows``
consecutive rows (positions come from the distributed ``ordered_index``):

* rolling frames look back at most 29 rows, so each chunk also receives the
  last 29 rows of the previous chunk as halo rows, computes its frames over
  ``partitionBy(campaign, chunk)`` and drops the halo — exact results;
* the budget fill carries the last / first non-null value across chunks
  through a per-chunk summary (one row per chunk) and a window over chunks;
* the campaign start date is a plain aggregation joined back.

Results equal the single-partition plan row for row (tested).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.constants import ROLLING_WINDOWS
from revcast.operators.clean import CAMPAIGN_KEYS, CAMPAIGN_ORDER, drop_zero_activity
from revcast.operators.splits import ordered_index

HALO = max(ROLLING_WINDOWS) - 1
CHUNK_ROWS = 100_000                 # rows of a window partition


def positions(df: DataFrame, chunk_rows: int) -> DataFrame:
    """Adds _pos (0-based position in its series), _chunk and _first_date."""
    ix = ordered_index(df, [*CAMPAIGN_KEYS, *CAMPAIGN_ORDER], "_gidx")
    start = ix.groupBy(*CAMPAIGN_KEYS).agg(F.min("_gidx").alias("_s"), F.min("date").alias("_first_date"))
    return (ix.join(start, CAMPAIGN_KEYS)
              .withColumn("_pos", F.col("_gidx") - F.col("_s"))
              .withColumn("_chunk", F.floor(F.col("_pos") / chunk_rows).cast("bigint"))
              .drop("_gidx", "_s"))


def fill_budget_chunked(pos: DataFrame) -> DataFrame:
    """ffill, then bfill, then 0 — across chunk borders."""
    b = F.col("daily_budget")
    wc = Window.partitionBy(*CAMPAIGN_KEYS, "_chunk").orderBy("_pos")
    wc_desc = Window.partitionBy(*CAMPAIGN_KEYS, "_chunk").orderBy(F.col("_pos").desc())
    summary = pos.where(b.isNotNull()).groupBy(*CAMPAIGN_KEYS, "_chunk").agg(
        F.max_by("daily_budget", "_pos").alias("_last_nn"), F.min_by("daily_budget", "_pos").alias("_first_nn"))
    by_chunk = Window.partitionBy(*CAMPAIGN_KEYS).orderBy("_chunk")     # one row per chunk
    carry = summary.select(
        *CAMPAIGN_KEYS, "_chunk",
        F.last("_last_nn", True).over(by_chunk.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         .alias("_carry_fwd"),
        F.first("_first_nn", True).over(by_chunk.rowsBetween(Window.currentRow, Window.unboundedFollowing))
         .alias("_carry_bwd"))
    # a chunk without any non-null budget takes the carries of its neighbours
    chunks = pos.select(*CAMPAIGN_KEYS, "_chunk").distinct()
    c = chunks.join(carry, [*CAMPAIGN_KEYS, "_chunk"], "left")
    c = c.select(
        *CAMPAIGN_KEYS, "_chunk",
        F.last("_carry_fwd", True).over(by_chunk.rowsBetween(Window.unboundedPreceding, -1)).alias("_prev_fwd"),
        F.first("_carry_bwd", True).over(by_chunk.rowsBetween(1, Window.unboundedFollowing)).alias("_next_bwd"))
    run_fwd = F.last(b, True).over(wc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    run_bwd = F.last(b, True).over(wc_desc.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (pos.join(c, [*CAMPAIGN_KEYS, "_chunk"], "left")
               .withColumn("daily_budget", F.coalesce(b, run_fwd, F.col("_prev_fwd"), run_bwd, F.col("_next_bwd"),
                                                      F.lit(0.0)))
               .drop("_prev_fwd", "_next_bwd"))


def with_halo(pos: DataFrame, chunk_rows: int) -> DataFrame:
    own = pos.withColumn("_halo", F.lit(False))
    halo = (pos.where(F.col("_pos") % chunk_rows >= chunk_rows - HALO)
               .withColumn("_chunk", F.col("_chunk") + 1).withColumn("_halo", F.lit(True)))
    return own.unionByName(halo)


def clean_chunked(raw: DataFrame, chunk_rows: int) -> DataFrame:
    filled = fill_budget_chunked(positions(raw, chunk_rows))
    return drop_zero_activity(filled.drop("_pos", "_chunk", "_first_date"))


def engineer_features_chunked(clean_df: DataFrame, chunk_rows: int) -> DataFrame:
    from revcast.operators import features as fe

    pos = positions(clean_df, chunk_rows)
    base = with_halo(pos, chunk_rows).withColumns({**fe.calendar_columns(), **fe.ratio_columns()})
    w = Window.partitionBy(*CAMPAIGN_KEYS, "_chunk").orderBy("_pos")
    cols = {}
    for n in ROLLING_WINDOWS:
        frame = w.rowsBetween(-(n - 1), Window.currentRow)
        for col in fe.ROLL_MEAN_BASES:
            cols[fe.rolling_name(col, n, "mean")] = F.avg(col).over(frame)
            if col in fe.ROLL_STD_BASES:
                cols[fe.rolling_name(col, n, "std")] = F.coalesce(F.stddev_samp(col).over(frame), F.lit(0.0))
    out = (base.withColumns({"days_since_campaign_start": F.datediff(F.col("date"), F.col("_first_date")), **cols})
               .where(~F.col("_halo"))
               .withColumns({
                   "revenue_momentum": fe.safe_ratio(F.col("revenue_roll_7d_mean"), F.col("revenue_roll_30d_mean"), 1.0),
                   "spend_momentum": fe.safe_ratio(F.col("spend_roll_7d_mean"), F.col("spend_roll_30d_mean"), 1.0)}))
    return out.select(*clean_df.columns, *fe.feature_order())
