"""Insight tables over the forecast table.

Each function takes the forecast DataFrame (18 columns) and returns a small
table; text is a later projection (``operators.report``).  Inputs are
filtered to one horizon / granularity first, so every aggregation here works
on the forecast rows of that slice, never on the daily fact table, except
``paused_types`` which pre-aggregates the fact table before its anti join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.functions.expr import (
    anomaly_label, channel_display, outlook_label, risk_label, roas_label, safe_ratio, trend_label,
)


def rows_at(fc: DataFrame, granularity: str, horizon: int | None = None) -> DataFrame:
    out = fc.where(F.col("granularity") == granularity)
    return out if horizon is None else out.where(F.col("forecast_horizon") == horizon)


# ------------------------------------------------------------------ filters
def filter_forecast(fc: DataFrame, horizon: int | None = None, granularity: str | None = None,
                    channel: str | None = None) -> DataFrame:
    """Falsy arguments mean no filter."""
    if horizon:
        fc = fc.where(F.col("forecast_horizon") == horizon)
    if granularity:
        fc = fc.where(F.col("granularity") == granularity)
    if channel:
        fc = fc.where(F.col("channel") == channel)
    return fc


# ------------------------------------------------------------------ totals
def forecast_totals(fc: DataFrame) -> DataFrame:
    """Per horizon x granularity."""
    return fc.groupBy("forecast_horizon", "granularity").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("revenue_p50").alias("total_revenue_p50"),
        F.sum("projected_spend").alias("total_projected_spend"),
        F.avg("roas_p50").alias("avg_roas_p50"))


def kpis(fc: DataFrame) -> DataFrame:
    """Per horizon, from channel rows."""
    agg = rows_at(fc, "channel").groupBy("forecast_horizon").agg(
        F.sum("revenue_p10").alias("revenue_p10"),
        F.sum("revenue_p50").alias("revenue_p50"),
        F.sum("revenue_p90").alias("revenue_p90"),
        F.sum("projected_spend").alias("projected_spend"),
        F.count_distinct("channel").alias("num_channels"))
    blended = safe_ratio(F.col("revenue_p50"), F.col("projected_spend"))
    return agg.withColumns({
        "blended_roas": blended,
        "confidence_range": F.col("revenue_p90") - F.col("revenue_p10"),
        "model_confidence": F.when(blended > K.CONFIDENCE_ROAS, F.lit("85%")).otherwise(F.lit("70%")),
    })


def dimension_lists(fc: DataFrame) -> DataFrame:
    """A11 as rows (dimension, value): distinct channels and non-ALL types."""
    ch = fc.select(F.lit("channel").alias("dimension"), F.col("channel").alias("value"))
    ty = fc.where(F.col("campaign_type") != K.ALL).select(
        F.lit("campaign_type").alias("dimension"), F.col("campaign_type").alias("value"))
    return ch.unionByName(ty).where(F.col("value").isNotNull()).distinct()


def validation_counts(fc: DataFrame) -> DataFrame:
    """Channels overall, campaign rows at 30 days."""
    return fc.agg(
        F.count_distinct("channel").alias("channels"),
        F.count(F.when((F.col("granularity") == "campaign") & (F.col("forecast_horizon") == 30), 1))
         .alias("campaigns"))


# ------------------------------------------------------------------ paused types
def paused_types(daily: DataFrame, fc: DataFrame, horizon: int) -> DataFrame:
    """(channel, type) in the full history with no type-level forecast at ``horizon``."""
    hist = daily.groupBy("channel", "campaign_type").agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("spend").alias("total_spend"),
        F.count_distinct("campaign_name").alias("campaigns"),
        F.max("date").alias("last_active"))
    active = rows_at(fc, "campaign_type", horizon).select("channel", "campaign_type")
    return (hist.join(active, ["channel", "campaign_type"], "left_anti")
                .withColumns({"forecast_horizon": F.lit(horizon),
                              "channel_display": channel_display(F.col("channel")),
                              "status": F.lit("Paused")})
                .select("forecast_horizon", "channel", "channel_display", "campaign_type",
                        "total_revenue", "total_spend", "campaigns", "last_active", "status"))


# ------------------------------------------------------------------ contributions
def contribution_table(fc: DataFrame, daily: DataFrame, horizon: int) -> DataFrame:
    """I5 with A12/A13: type rows + campaign count + share, paused rows appended."""
    types = rows_at(fc, "campaign_type", horizon)
    counts = (rows_at(fc, "campaign", horizon).groupBy("channel", "campaign_type")
              .agg(F.count(F.lit(1)).alias("campaigns")))
    total = F.sum("revenue_p50").over(Window.partitionBy("forecast_horizon"))
    active = (types.join(counts, ["channel", "campaign_type"], "left")
                   .select("forecast_horizon", "channel", channel_display(F.col("channel")).alias("channel_display"),
                           "campaign_type", F.coalesce("campaigns", F.lit(0)).cast("bigint").alias("campaigns"),
                           "revenue_p10", "revenue_p50", "revenue_p90", "roas_p10", "roas_p90",
                           F.when(total > 0, F.col("revenue_p50") / total * 100).otherwise(F.lit(0.0))
                            .alias("contribution_pct"),
                           "low_confidence", F.lit("Active").alias("status")))
    paused = paused_types(daily, fc, horizon).select(
        "forecast_horizon", "channel", "channel_display", "campaign_type",
        F.col("campaigns").cast("bigint").alias("campaigns"),
        *[F.lit(None).cast("double").alias(c) for c in
          ["revenue_p10", "revenue_p50", "revenue_p90", "roas_p10", "roas_p90", "contribution_pct"]],
        F.lit(None).cast("boolean").alias("low_confidence"), "status")
    return active.unionByName(paused)


def contribution_totals(fc: DataFrame) -> DataFrame:
    """Per horizon over type rows."""
    agg = rows_at(fc, "campaign_type").groupBy("forecast_horizon").agg(
        F.sum("revenue_p10").alias("total_p10"),
        F.sum("revenue_p90").alias("total_p90"),
        F.sum("projected_spend").alias("total_spend"))
    return agg.withColumns({
        "blended_roas_p10": safe_ratio(F.col("total_p10"), F.col("total_spend")),
        "blended_roas_p90": safe_ratio(F.col("total_p90"), F.col("total_spend")),
    })


# ------------------------------------------------------------------ channel / type analysis
def channel_analysis(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """Share, full P10-P90 width in % of P50, assessment."""
    ch = rows_at(fc, "channel", horizon)
    total = F.sum("revenue_p50").over(Window.partitionBy("forecast_horizon"))
    p50 = F.col("revenue_p50")
    return ch.select(
        "forecast_horizon", "channel", "revenue_p10", "revenue_p50", "revenue_p90", "roas_p50", "projected_spend",
        F.when(total > 0, p50 / total * 100).otherwise(F.lit(0.0)).alias("share_pct"),
        F.when(p50 > 0, (F.col("revenue_p90") - F.col("revenue_p10")) / p50 * 100).otherwise(F.lit(0.0))
         .alias("width_pct"),
        roas_label(F.col("roas_p50")).alias("assessment"))


def type_analysis(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """I4: type rows with risk label."""
    ty = rows_at(fc, "campaign_type", horizon)
    return ty.select("forecast_horizon", "channel", "campaign_type", "revenue_p50", "roas_p50",
                     risk_label(F.col("revenue_p10"), F.col("revenue_p50"), F.col("revenue_p90")).alias("risk"))


def best_worst(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """O3: best / lowest type by P50 and best / worst channel by P50 ROAS, one row.

    One aggregation over the horizon slice; rows of the other granularity get a
    NULL ordering key and are ignored by max_by/min_by.
    """
    sl = fc.where(F.col("forecast_horizon") == horizon)
    is_t, is_c = F.col("granularity") == "campaign_type", F.col("granularity") == "channel"
    t_val = F.struct("campaign_type", "channel", "revenue_p50", "roas_p50")
    t_key = F.when(is_t, F.struct("revenue_p50", "channel", "campaign_type"))
    c_val = F.struct("channel", "roas_p50")
    c_key = F.when(is_c, F.struct("roas_p50", "channel"))
    agg = sl.agg(F.max_by(t_val, t_key).alias("b"), F.min_by(t_val, t_key).alias("w"),
                 F.max_by(c_val, c_key).alias("bc"), F.min_by(c_val, c_key).alias("wc"))
    return agg.select(
        F.lit(horizon).alias("forecast_horizon"),
        F.col("b.campaign_type").alias("top_type"), F.col("b.channel").alias("top_type_channel"),
        F.col("b.revenue_p50").alias("top_type_revenue_p50"), F.col("b.roas_p50").alias("top_type_roas_p50"),
        F.col("w.campaign_type").alias("lowest_type"), F.col("w.channel").alias("lowest_type_channel"),
        F.col("w.revenue_p50").alias("lowest_type_revenue_p50"), F.col("w.roas_p50").alias("lowest_type_roas_p50"),
        F.col("bc.channel").alias("best_channel"), F.col("bc.roas_p50").alias("best_channel_roas_p50"),
        F.col("wc.channel").alias("worst_channel"), F.col("wc.roas_p50").alias("worst_channel_roas_p50"))


# ------------------------------------------------------------------ horizon trend / efficiency
def horizon_trend(fc: DataFrame) -> DataFrame:
    """Monthly run-rate per horizon; growth of the 90-day vs the 30-day month."""
    per_h = rows_at(fc, "channel").groupBy("forecast_horizon").agg(
        F.sum("revenue_p50").alias("total_p50"), F.sum("projected_spend").alias("total_spend"))
    whole = Window.partitionBy()  # per_h holds one row per horizon
    m30 = F.max(F.when(F.col("forecast_horizon") == 30, F.col("total_p50"))).over(whole)
    m90 = F.max(F.when(F.col("forecast_horizon") == 90, F.col("total_p50") / 3)).over(whole)
    growth = F.when(m30 > 0, (m90 - m30) / m30 * 100)
    return per_h.withColumns({
        "avg_monthly_p50": F.col("total_p50") / (F.col("forecast_horizon") / 30.0),
        "growth_pct": growth,
        "trend": F.when(growth.isNotNull(), trend_label(growth)),
    })


def budget_efficiency(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """Historical vs forecast ROAS per channel, outlook label."""
    ch = rows_at(fc, "channel", horizon)
    hist = safe_ratio(F.col("historical_daily_revenue"), F.col("historical_daily_spend"))
    return ch.select("forecast_horizon", "channel", "historical_daily_revenue", "historical_daily_spend",
                     hist.alias("historical_roas"), "roas_p50",
                     outlook_label(F.col("roas_p50"), hist).alias("outlook"))


# ------------------------------------------------------------------ risk
def uncertainty_pct(p10: Column, p50: Column, p90: Column) -> Column:
    return F.when(p50 > 0, (p90 - p10) / p50 * 100).otherwise(F.lit(0.0))


def high_uncertainty(fc: DataFrame, horizon: int = 30, top_n: int = 5) -> DataFrame:
    """The top-N campaigns by width % among those above 150 %, with the total count."""
    camp = rows_at(fc, "campaign", horizon).withColumn(
        "uncertainty_pct", uncertainty_pct(F.col("revenue_p10"), F.col("revenue_p50"), F.col("revenue_p90")))
    risky = camp.where(F.col("uncertainty_pct") > K.HIGH_UNCERTAINTY_PCT)
    total = risky.select(F.count(F.lit(1))).scalar()
    top = risky.orderBy(F.col("uncertainty_pct").desc(), "channel", "campaign_name").limit(top_n)
    return top.select("forecast_horizon", "channel", "campaign_type", "campaign_name", "revenue_p10",
                      "revenue_p50", "revenue_p90", "uncertainty_pct", total.alias("high_uncertainty_total"))


def zero_revenue(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """I8: campaigns with zero median forecast."""
    return (rows_at(fc, "campaign", horizon).where(F.col("revenue_p50") == 0)
            .select("forecast_horizon", "channel", "campaign_type", "campaign_name", "projected_spend"))


def wasted_spend(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """Number of zero-P50 campaigns and their projected spend."""
    z = zero_revenue(fc, horizon)
    return z.agg(F.count(F.lit(1)).alias("zero_revenue_campaigns"),
                 F.coalesce(F.sum("projected_spend"), F.lit(0.0)).alias("wasted_spend")) \
            .withColumn("forecast_horizon", F.lit(horizon))


def budget_concentration(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """Dominant channel by projected spend and the > 60 % (rounded) flag."""
    ch = rows_at(fc, "channel", horizon)
    agg = ch.agg(F.max_by("channel", F.struct("projected_spend", F.col("channel"))).alias("dominant_channel"),
                 F.max("projected_spend").alias("dominant_spend"),
                 F.sum("projected_spend").alias("total_spend"))
    share = F.when(F.col("total_spend") > 0, F.col("dominant_spend") / F.col("total_spend") * 100)
    return agg.withColumns({
        "forecast_horizon": F.lit(horizon),
        "share_pct": share,
        "concentration_alert": F.coalesce(F.round(share, 0) > K.CONCENTRATION_PCT, F.lit(False)),
    })


def baseline_anomaly(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """Predicted daily P50 vs historical daily revenue."""
    ch = rows_at(fc, "channel", horizon)
    pred = F.col("revenue_p50") / float(horizon)
    hist = F.col("historical_daily_revenue")
    change = F.when(hist > 0, (pred - hist) / hist * 100).otherwise(F.lit(0.0))
    return ch.select("forecast_horizon", "channel", hist.alias("historical_daily_revenue"),
                     pred.alias("predicted_daily_revenue"), change.alias("change_pct"),
                     F.when(change > 0, F.lit("uplift")).otherwise(F.lit("decline")).alias("direction"),
                     anomaly_label(change).alias("anomaly"))


# ------------------------------------------------------------------ recommendations
def recommendation_inputs(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """One row of rule inputs (I9), computed in a single aggregation of the horizon slice."""
    sl = fc.where(F.col("forecast_horizon") == horizon)
    is_c, is_k = F.col("granularity") == "channel", F.col("granularity") == "campaign"
    c_key = F.when(is_c, F.struct("roas_p50", "channel"))
    zero = is_k & (F.col("revenue_p50") == 0)
    width = (F.col("revenue_p90") - F.col("revenue_p10")) / F.greatest(F.col("revenue_p50"), F.lit(1.0))
    return sl.agg(
        F.max_by("channel", c_key).alias("best_channel"),
        F.max_by("roas_p50", c_key).alias("best_channel_roas_p50"),
        F.min_by("channel", c_key).alias("worst_channel"),
        F.min_by("roas_p50", c_key).alias("worst_channel_roas_p50"),
        F.count(F.when(zero, 1)).alias("zero_revenue_campaigns"),
        F.coalesce(F.sum(F.when(zero, F.col("projected_spend"))), F.lit(0.0)).alias("wasted_spend"),
        F.count(F.when(is_k & (width > K.DATA_QUALITY_RATIO), 1)).alias("data_quality_campaigns"))


def _rule(order: int, name: str, fired: Column) -> Column:
    return F.struct(F.lit(order).alias("rule_order"), F.lit(name).alias("rule"), fired.alias("fired"))


def recommendations(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """Fired rules numbered in firing order (reallocation, pruning, data quality, scenarios)."""
    inp = recommendation_inputs(fc, horizon)
    rules = F.array(
        _rule(1, "BUDGET REALLOCATION", F.col("best_channel_roas_p50") > F.col("worst_channel_roas_p50") * 2),
        _rule(2, "CAMPAIGN PRUNING", F.col("zero_revenue_campaigns") > 0),
        _rule(3, "DATA QUALITY", F.col("data_quality_campaigns") > 0),
        _rule(4, "SCENARIO PLANNING", F.lit(True)))
    fired = (inp.select("*", F.inline(rules)).where(F.coalesce(F.col("fired"), F.lit(False))))
    # at most four rows: numbering them needs no partitioned window
    num = F.row_number().over(Window.orderBy("rule_order"))
    return fired.select(num.alias("rec_num"), "rule", "best_channel", "best_channel_roas_p50", "worst_channel",
                        "worst_channel_roas_p50", "zero_revenue_campaigns", "wasted_spend",
                        "data_quality_campaigns")


# ------------------------------------------------------------------ fan chart
def fan_series(fc: DataFrame) -> DataFrame:
    """A point every 3 days per horizon, from channel totals and mean channel ROAS."""
    ch = rows_at(fc, "channel")
    agg = ch.groupBy("forecast_horizon").agg(
        F.sum("revenue_p10").alias("t10"), F.sum("revenue_p50").alias("t50"), F.sum("revenue_p90").alias("t90"),
        F.avg("roas_p10").alias("r10"), F.avg("roas_p50").alias("r50"), F.avg("roas_p90").alias("r90"))
    n = F.floor(F.col("forecast_horizon") / K.FAN_STEP_DAYS).cast("int")
    pts = agg.withColumn("n_points", n).select("*", F.explode(F.sequence(F.lit(0), n)).alias("point"))
    frac = F.try_divide(F.col("point"), F.col("n_points"))
    steps = F.col("point") * K.FAN_STEP_DAYS + 1
    h = F.col("forecast_horizon")
    rev50 = F.col("t50") / h * steps * (1 + frac * K.FAN_P50_GROWTH)
    rev10 = F.col("t10") / h * steps
    rev90 = F.col("t90") / h * steps * (1 + frac * K.FAN_P90_GROWTH)
    ro50 = F.col("r50") * (1 + frac * K.FAN_ROAS_GROWTH["p50"])
    ro10 = F.col("r10") * (1 + frac * K.FAN_ROAS_GROWTH["p10"])
    ro90 = F.col("r90") * (1 + frac * K.FAN_ROAS_GROWTH["p90"])
    return pts.select(
        "forecast_horizon", "point", (F.col("point") * K.FAN_STEP_DAYS).alias("day_offset"),
        rev10.alias("revenue_p10"), rev50.alias("revenue_p50"),
        (rev50 + (rev90 - rev50) * 0.5).alias("revenue_p75"), rev90.alias("revenue_p90"),
        ro10.alias("roas_p10"), ro50.alias("roas_p50"), (ro50 + (ro90 - ro50) * 0.5).alias("roas_p75"),
        ro90.alias("roas_p90"))
