"""Daily feature engineering: calendar (P9), ratios (P10), age (P11/W4),
rolling means/std (W2/W3) and momentum (P12).

All per-campaign windows share one partitioning and ordering, so the whole
feature block costs one shuffle on (channel, campaign_name) and one sort.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revcast.constants import ROLLING_WINDOWS
from revcast.functions.expr import safe_ratio
from revcast.operators.clean import CAMPAIGN_KEYS, campaign_window

ROLL_MEAN_BASES = ["revenue", "spend", "roas", "clicks"]
ROLL_STD_BASES = ["revenue", "spend"]


def calendar_columns() -> dict:
    d = F.col("date")
    return {
        "month": F.month(d),
        "day_of_week": F.weekday(d),                  # 0 = Monday
        "week_of_year": F.weekofyear(d),              # ISO week
        "quarter": F.quarter(d),
        "is_weekend": (F.weekday(d) >= 5).cast("int"),
    }


def ratio_columns() -> dict:
    return {
        "roas": safe_ratio(F.col("revenue"), F.col("spend")),
        "cpc": safe_ratio(F.col("spend"), F.col("clicks")),
        "cvr": F.coalesce(safe_ratio(F.col("conversions"), F.col("clicks")), F.lit(0.0)),
        "budget_utilization": safe_ratio(F.col("spend"), F.col("daily_budget")),
    }


def rolling_name(base: str, n: int, stat: str) -> str:
    return f"{base}_roll_{n}d_{stat}"


def rolling_columns() -> dict:
    """Mean/std over the last n ROWS (min 1 row) of a campaign, NULL std -> 0."""
    w = campaign_window()
    cols = {}
    for n in ROLLING_WINDOWS:
        frame = w.rowsBetween(-(n - 1), Window.currentRow)
        for base in ROLL_MEAN_BASES:
            cols[rolling_name(base, n, "mean")] = F.avg(base).over(frame)
            if base in ROLL_STD_BASES:
                cols[rolling_name(base, n, "std")] = F.coalesce(F.stddev_samp(base).over(frame), F.lit(0.0))
    return cols


# Column order of the engineered table (the original's insertion order).
CALENDAR_COLS = ["month", "day_of_week", "week_of_year", "quarter", "is_weekend"]
RATIO_COLS = ["roas", "cpc", "cvr", "budget_utilization"]


def feature_order() -> list:
    out = CALENDAR_COLS + RATIO_COLS + ["days_since_campaign_start"]
    for n in ROLLING_WINDOWS:
        out += [rolling_name("revenue", n, "mean"), rolling_name("revenue", n, "std"),
                rolling_name("spend", n, "mean"), rolling_name("spend", n, "std"),
                rolling_name("roas", n, "mean"), rolling_name("clicks", n, "mean")]
    return out + ["revenue_momentum", "spend_momentum"]


def engineer_features(clean_df: DataFrame) -> DataFrame:
    """11 unified columns -> 41 columns (30 features).

    Rows that are dealt by campaign already (straight after ``clean``) are not dealt again."""
    base = clean_df.withColumns({**calendar_columns(), **ratio_columns()})
    first_date = F.min("date").over(Window.partitionBy(*CAMPAIGN_KEYS))
    with_win = base.withColumns({
        "days_since_campaign_start": F.datediff(F.col("date"), first_date),
        **rolling_columns(),
    })
    out = with_win.withColumns({
        "revenue_momentum": safe_ratio(F.col("revenue_roll_7d_mean"), F.col("revenue_roll_30d_mean"), 1.0),
        "spend_momentum": safe_ratio(F.col("spend_roll_7d_mean"), F.col("spend_roll_30d_mean"), 1.0),
    })
    return out.select(*clean_df.columns, *feature_order())


def lag_features(features: DataFrame, lag: int = 1) -> DataFrame:
    """D7 option: every engineered feature (and same-day ratios) taken from ``lag`` rows
    earlier in the campaign, so a row's features never contain its own revenue.
    The first ``lag`` rows of a campaign get NULL features (the matrix turns them into 0)."""
    if lag <= 0:
        return features
    w = campaign_window()
    cols = [c for c in feature_order() if c not in CALENDAR_COLS and c != "days_since_campaign_start"]
    return features.withColumns({c: F.lag(c, lag).over(w) for c in cols})
