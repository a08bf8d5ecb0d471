"""Forecast operators: snapshot (A8), look-back (P15), horizon assignment (J4),
forecast base (A7), sparse fallback and scaling (M9/M10), non-negative clip
(P17), quantile-crossing repair (P18), ROAS cap (P19), rounding (P20) and the
whole horizon x granularity forecast (M11).

Plan shape: the engineered daily table is cut to the widest look-back, each
row is exploded into the horizons whose look-back holds it (no join), one
GROUPING SETS aggregation builds per-date sums for all three granularities at
once (partial aggregation before the shuffle), and a second aggregation per
group yields the base statistics and the empirical daily quantiles.  Every
group of the second aggregation holds at most one row per day of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.functions.expr import cap_roas, non_negative

KEY_COLS = ["channel", "campaign_type", "campaign_name"]
GROUP_COLS = ["forecast_horizon", "granularity", *KEY_COLS]

FORECAST_COLUMNS = [
    "forecast_horizon", "granularity", "channel", "campaign_type", "campaign_name",
    "revenue_p10", "revenue_p50", "revenue_p90", "roas_p10", "roas_p50", "roas_p90",
    "projected_spend", "budget_multiplier", "historical_daily_revenue", "historical_daily_spend",
    "days_in_window", "nonzero_revenue_days", "low_confidence",
]
EXPORT_COLUMNS = FORECAST_COLUMNS[:16]
MONEY_COLS = ["revenue_p10", "revenue_p50", "revenue_p90", "projected_spend",
              "historical_daily_revenue", "historical_daily_spend"]
ROAS_COLS = ["roas_p10", "roas_p50", "roas_p90"]


def snapshot_date(daily: DataFrame, eager: bool = True) -> Column:
    """Global snapshot (max date over all channels).

    Eager (default): one single-value job, returned as a DATE literal, so that
    ``date > snapshot - h`` is a static predicate the parquet scan can push down
    (row groups of older dates are skipped on the date-clustered landed table).
    Lazy: a scalar subquery inside the plan.
    """
    if not eager:
        return daily.select(F.max("date")).scalar()
    value = daily.agg(F.max("date")).first()[0]
    return F.lit(value).cast("date")


def lookback(daily: DataFrame, horizon: int, snapshot: Column | None = None) -> DataFrame:
    """Rows with date > snapshot - horizon days (exactly ``horizon`` days incl. snapshot)."""
    snap = snapshot_date(daily) if snapshot is None else snapshot
    return daily.where(F.col("date") > F.date_sub(snap, horizon))


def assign_horizons(daily: DataFrame, horizons=K.HORIZONS, snapshot: Column | None = None) -> DataFrame:
    """Attach ``forecast_horizon``: a row appears once per horizon whose look-back holds it."""
    snap = snapshot_date(daily) if snapshot is None else snapshot
    age = F.datediff(snap, F.col("date"))
    hs = F.array(*[F.lit(int(h)) for h in sorted(horizons)])
    return (daily.where(F.col("date") > F.date_sub(snap, max(horizons)))
                 .withColumn("_age", age)
                 .withColumn("forecast_horizon", F.explode(F.filter(hs, lambda h: F.col("_age") < h)))
                 .drop("_age"))


def granularity_sets(prefix: list[str], granularities=None) -> list[list[str]]:
    return [prefix + cols for g, cols in K.GRANULARITIES.items() if not granularities or g in granularities]


def grouping_flags() -> list[Column]:
    """grouping() bits of the rolled-up keys; use with ``label_rolled_up``."""
    return [F.grouping("campaign_type").alias("_g_type"), F.grouping("campaign_name").alias("_g_name")]


def label_rolled_up(df: DataFrame) -> DataFrame:
    """Granularity name and 'ALL' placeholders for rolled-up keys."""
    g_type, g_name = F.col("_g_type") == 1, F.col("_g_name") == 1
    return df.withColumns({
        "granularity": F.when(g_type, F.lit("channel")).when(g_name, F.lit("campaign_type"))
                        .otherwise(F.lit("campaign")),
        "campaign_type": F.when(g_type, F.lit(K.ALL)).otherwise(F.col("campaign_type")),
        "campaign_name": F.when(g_name, F.lit(K.ALL)).otherwise(F.col("campaign_name")),
    }).drop("_g_type", "_g_name")


def daily_group_sums(hrows: DataFrame, granularities=None) -> DataFrame:
    """Per (horizon, granularity, group, date): summed revenue and spend, of the wanted granularities."""
    sets = granularity_sets(["forecast_horizon", "date"], granularities)
    agg = (hrows.groupingSets(sets, "forecast_horizon", "date", *KEY_COLS)
                .agg(F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("day_revenue"),
                     F.coalesce(F.sum("spend"), F.lit(0.0)).alias("day_spend"),
                     *grouping_flags()))
    return label_rolled_up(agg)


def forecast_base(hrows: DataFrame, granularities=None) -> DataFrame:
    """A7 + empirical daily quantiles per (horizon, granularity, group)."""
    daily = daily_group_sums(hrows, granularities)
    return daily.groupBy(*GROUP_COLS).agg(
        F.count(F.lit(1)).alias("days_in_window"),
        F.count(F.when(F.col("day_revenue") > 0, 1)).alias("nonzero_revenue_days"),
        (F.sum("day_revenue") / F.count(F.lit(1))).alias("historical_daily_revenue"),
        (F.sum("day_spend") / F.count(F.lit(1))).alias("historical_daily_spend"),
        F.max("date").alias("last_date"),
        F.percentile("day_revenue", [float(q) for q in K.QUANTILES]).alias("daily_quantiles"),
    )


def repair_quantiles(df: DataFrame, p10="revenue_p10", p50="revenue_p50", p90="revenue_p90") -> DataFrame:
    """Crossing repair in the original order: low, high, then swap."""
    df = df.withColumn(p10, F.when(F.col(p10) > F.col(p50), F.col(p50) * K.CROSSING_LOW_FACTOR).otherwise(F.col(p10)))
    df = df.withColumn(p90, F.when(F.col(p90) < F.col(p50), F.col(p50) * K.CROSSING_HIGH_FACTOR).otherwise(F.col(p90)))
    swap = F.col(p10) > F.col(p90)
    return df.withColumns({
        p10: F.when(swap, F.col(p90)).otherwise(F.col(p10)),
        p90: F.when(swap, F.col(p10)).otherwise(F.col(p90)),
    })


def cap_forecast(df: DataFrame) -> DataFrame:
    """ROAS per quantile capped at MAX_ROAS, revenue capped at MAX_ROAS x spend."""
    s = F.col("projected_spend")
    out = df.withColumns({f"roas_p{q}": cap_roas(F.col(f"revenue_p{q}"), s) for q in ("10", "50", "90")})
    return out.withColumns({
        f"revenue_p{q}": F.when(s > 0, F.least(F.col(f"revenue_p{q}"), s * K.MAX_ROAS)).otherwise(F.col(f"revenue_p{q}"))
        for q in ("10", "50", "90")
    })


def project_forecast(base: DataFrame, multiplier: float | Column = 1.0,
                     quantile_col: str = "daily_quantiles") -> DataFrame:
    """Sparse fallback, clip, scale to the horizon, repair, cap."""
    m = multiplier if isinstance(multiplier, Column) else F.lit(float(multiplier))
    h = F.col("forecast_horizon")
    sparse = F.col("nonzero_revenue_days") < K.MIN_REVENUE_DAYS
    daily = {q: non_negative(F.when(sparse, F.col("historical_daily_revenue"))
                              .otherwise(F.col(quantile_col)[i]))
             for i, q in enumerate(("10", "50", "90"))}
    out = base.withColumns({
        "budget_multiplier": m,
        "projected_spend": F.col("historical_daily_spend") * h * m,
        "low_confidence": sparse,
        **{f"revenue_p{q}": daily[q] * h * m for q in daily},
    })
    out = cap_forecast(repair_quantiles(out))
    return out.select(*FORECAST_COLUMNS)


def forecast(features: DataFrame, multiplier: float | Column = 1.0, horizons=K.HORIZONS,
             granularities: list[str] | None = None, daily_quantiles: DataFrame | None = None,
             snapshot: Column | None = None) -> DataFrame:
    """Whole forecast table (unrounded).  ``daily_quantiles`` optionally supplies
    model predictions per group (columns: granularity, channel, campaign_type,
    campaign_name, daily_quantiles); default is the empirical quantile model."""
    base = forecast_base(assign_horizons(features, horizons, snapshot), granularities)
    if daily_quantiles is not None:
        base = (base.drop("daily_quantiles")
                    .join(daily_quantiles, ["granularity", *KEY_COLS], "left"))
    return project_forecast(base, multiplier)


def format_forecast(df: DataFrame, export: bool = False) -> DataFrame:
    """P20: half-even rounding to 2 dp (money) and 4 dp (ROAS)."""
    out = df.withColumns({**{c: F.bround(c, 2) for c in MONEY_COLS}, **{c: F.bround(c, 4) for c in ROAS_COLS}})
    return out.select(*(EXPORT_COLUMNS if export else FORECAST_COLUMNS))


def sort_forecast(df: DataFrame) -> DataFrame:
    return df.orderBy("forecast_horizon", "granularity", *KEY_COLS)
