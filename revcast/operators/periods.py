"""Period features (A2-A6): horizons x granularities from mergeable states.

Rows are attached to their horizons by ``assign_horizons`` (no join) and summed up to one state for each
horizon and campaign: sums and counts, (n, mean, M2) for the deviations, the days as bits, the last row's
rolling values.  Only these states enter the GROUPING SETS, so no raw row is multiplied by granularities
or distinct counts: days are counted by or-ing their bits, campaigns by marking each name's first type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.functions.expr import safe_ratio
from revcast.operators.forecast import (
    KEY_COLS, assign_horizons, granularity_sets, grouping_flags, label_rolled_up, snapshot_date,
)

PERIOD_COLUMNS = [
    "forecast_horizon", "granularity", "snapshot_date", *KEY_COLS,
    "total_revenue", "total_spend", "total_clicks", "total_impressions", "total_conversions",
    "mean_daily_revenue", "mean_daily_spend", "std_daily_revenue", "std_daily_spend",
    "mean_roas", "overall_roas", "mean_cpc", "mean_cvr", "mean_budget_util",
    "mean_daily_budget", "total_budget", "active_days", "num_campaigns",
    "revenue_trend", "spend_trend", "avg_month", "avg_quarter", "weekend_ratio",
    *K.CARRY_FORWARD_COLS,
]

# Order that defines "the group's last row": (channel, campaign_name, date), ties by type and id.
LAST_ROW_ORDER = ["campaign_name", "date", "campaign_type", "campaign_id"]


_MEANS = {"mean_daily_revenue": "revenue", "mean_daily_spend": "spend", "mean_roas": "roas", "mean_cpc": "cpc", "mean_cvr": "cvr",
          "mean_budget_util": "budget_utilization", "mean_daily_budget": "daily_budget", "avg_month": "month", "avg_quarter": "quarter",
          "weekend_ratio": "is_weekend"}
_TOTALS = {"total_revenue": "revenue", "total_spend": "spend", "total_clicks": "clicks", "total_impressions": "impressions",
           "total_conversions": "conversions", "total_budget": "daily_budget"}
_STDS = {"std_daily_revenue": "revenue", "std_daily_spend": "spend"}
#: Days that a long's bits stand for.
_DAYS = 62


def _half_sum(col: str, first: bool):
    cond = F.col("date") <= F.col("_mid") if first else F.col("date") > F.col("_mid")
    return F.sum(F.when(cond, F.col(col)))


def _trend(first, second):
    return F.when(first > 0, (second - first) / first).otherwise(F.lit(0.0))


def campaign_states(hrows: DataFrame, days: int) -> DataFrame:
    """One row for each horizon and campaign of ``hrows`` (with _age, days before the snapshot, and _mid)."""
    order_key = F.struct(*[F.col(c) for c in LAST_ROW_ORDER])
    measures = sorted({*_MEANS.values(), *_TOTALS.values()})
    bit = lambda w: F.bit_or(F.when(F.floor(F.col("_age") / _DAYS) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("_age") % _DAYS).cast("int"))))
    states = hrows.groupBy("forecast_horizon", *KEY_COLS).agg(
        F.max("snapshot_date").alias("snapshot_date"),
        *[F.sum(m).alias(f"s_{m}") for m in measures], *[F.count(m).alias(f"n_{m}") for m in measures],
        *[(F.var_pop(m) * F.count(m)).alias(f"m2_{m}") for m in _STDS.values()],
        *[_half_sum(m, half).alias(f"{'first' if half else 'second'}_{m}") for m in ("revenue", "spend") for half in (True, False)],
        *[bit(w).alias(f"days_{w}") for w in range(-(-days // _DAYS))],
        F.max(order_key).alias("_key"), F.max_by(F.struct(*[F.col(c) for c in K.CARRY_FORWARD_COLS]), order_key).alias("_last"))
    first = F.row_number().over(Window.partitionBy("forecast_horizon", "channel", "campaign_name").orderBy("campaign_type")) == 1
    return states.withColumn("_first", first.cast("int"))


def _mean(m: str):
    return F.sum(f"s_{m}") / F.nullif(F.sum(f"n_{m}"), F.lit(0))


def _std(m: str, centre):
    """Sample deviation of merged (n, mean, M2) states; means are taken from ``centre``, so that nothing cancels out."""
    n, away = F.col(f"n_{m}"), F.col(f"s_{m}") / F.nullif(F.col(f"n_{m}"), F.lit(0)) - centre
    total, off = F.sum(n), F.sum(n * away)
    m2 = F.sum(f"m2_{m}") + F.sum(n * away * away) - off * off / F.nullif(total, F.lit(0))
    return F.coalesce(F.when(total > 1, F.sqrt(F.greatest(m2, F.lit(0.0)) / F.nullif(total - 1, F.lit(0)))), F.lit(0.0))


def period_features(features: DataFrame, horizons=K.HORIZONS, snapshot=None) -> DataFrame:
    snap = snapshot_date(features) if snapshot is None else snapshot
    hrows = (assign_horizons(features, horizons, snap)
             .withColumns({"snapshot_date": snap, "_age": F.datediff(snap, F.col("date")),
                           # lookback_start + h // 2 days
                           "_mid": F.date_add(F.date_sub(snap, F.col("forecast_horizon")),
                                              F.floor(F.col("forecast_horizon") / 2).cast("int"))}))
    states = campaign_states(hrows, max(horizons))
    recent = features.where(F.col("date") > F.date_sub(snap, max(horizons)))
    means = recent.agg(*[F.avg(m) for m in _STDS.values()]).first()    # any number near the means will do
    centre = {m: F.lit(float(c or 0.0)) for m, c in zip(_STDS.values(), means)}
    days = [c for c in states.columns if c.startswith("days_")]
    agg = states.groupingSets(granularity_sets(["forecast_horizon"]), "forecast_horizon", *KEY_COLS).agg(
        F.max("snapshot_date").alias("snapshot_date"),
        *[(F.coalesce(F.sum(f"s_{m}"), F.lit(0.0)) if m == "conversions" else F.sum(f"s_{m}")).alias(c) for c, m in _TOTALS.items()],
        *[_mean(m).alias(c) for c, m in _MEANS.items()],
        *[_std(m, centre[m]).alias(c) for c, m in _STDS.items()],
        sum((F.bit_count(F.coalesce(F.bit_or(d), F.lit(0).cast("bigint"))) for d in days), F.lit(0)).cast("bigint").alias("active_days"),
        F.sum("_first").alias("_names"), F.count(F.lit(1)).alias("_campaigns"),
        *[F.coalesce(F.sum(f"{half}_{m}"), F.lit(0.0)).alias(f"_{half}_{m}") for m in ("revenue", "spend") for half in ("first", "second")],
        F.max_by("_last", "_key").alias("_last"),
        *grouping_flags())
    out = label_rolled_up(agg).withColumns({
        # a name in several types is one campaign of the channel, and one of each type
        "num_campaigns": F.when(F.col("granularity") == "channel", F.col("_names")).otherwise(F.col("_campaigns")),
        "overall_roas": safe_ratio(F.col("total_revenue"), F.col("total_spend")),
        "revenue_trend": _trend(F.col("_first_revenue"), F.col("_second_revenue")),
        "spend_trend": _trend(F.col("_first_spend"), F.col("_second_spend")),
        **{c: F.col(f"_last.{c}") for c in K.CARRY_FORWARD_COLS},
    })
    return out.select(*PERIOD_COLUMNS)


def half_trend(features: DataFrame, horizons=K.HORIZONS, snapshot=None) -> DataFrame:
    """A4 alone: first/second-half sums and trends per horizon x group."""
    p = period_features(features, horizons, snapshot)
    return p.select("forecast_horizon", "granularity", *KEY_COLS, "revenue_trend", "spend_trend")


def carry_forward(features: DataFrame, horizons=K.HORIZONS, snapshot=None) -> DataFrame:
    """A6 alone: last-row rolling values per horizon x group."""
    p = period_features(features, horizons, snapshot)
    return p.select("forecast_horizon", "granularity", *KEY_COLS, *K.CARRY_FORWARD_COLS)
