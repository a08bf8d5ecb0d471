"""Constants shared by every operator.

The block marked FIXED VALUES must equal the values of the system being
re-implemented, otherwise forecasts, labels and reports differ.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay equal to the original system's values)
# ---------------------------------------------------------------------------

UNIFIED_COLUMNS = [
    "date", "channel", "campaign_type", "campaign_name", "campaign_id",
    "revenue", "spend", "clicks", "impressions", "conversions", "daily_budget",
]

# Campaign-type vocabulary (case-sensitive); anything else becomes OTHER.
CAMPAIGN_TYPE_MAP = {
    "SEARCH": "SEARCH",
    "PERFORMANCE_MAX": "PERFORMANCE_MAX",
    "DISPLAY": "DISPLAY",
    "VIDEO": "VIDEO",
    "DEMAND_GEN": "DEMAND_GEN",
    "SHOPPING": "SHOPPING",
    "Search": "SEARCH",
    "PerformanceMax": "PERFORMANCE_MAX",
    "Audience": "AUDIENCE",
    "Shopping": "SHOPPING",
}
DEFAULT_TYPE = "OTHER"

# Meta campaign names: first "_"-separated token -> campaign type.
META_PREFIX_TYPES = {
    "Generic": "GENERIC",
    "Prospecting": "PROSPECTING",
    "Remarketing": "REMARKETING",
}

CHANNELS = ["google", "bing", "meta"]          # file-name routing order
CHANNEL_DISPLAY = {"google": "Google Ads", "meta": "Meta Ads", "bing": "Microsoft Ads"}

ROLLING_WINDOWS = [7, 14, 30]                  # in rows, not days
HORIZONS = [30, 60, 90]                        # days
QUANTILES = [0.1, 0.5, 0.9]
GRANULARITIES = {
    "channel": ["channel"],
    "campaign_type": ["channel", "campaign_type"],
    "campaign": ["channel", "campaign_type", "campaign_name"],
}
ALL = "ALL"

MAX_ROAS = 20.0
MIN_REVENUE_DAYS = 5
CROSSING_LOW_FACTOR = 0.8
CROSSING_HIGH_FACTOR = 1.2

CATEGORICAL_COLS = ["channel", "campaign_type", "campaign_name"]
EXCLUDE_COLS = ["date", "campaign_id", "revenue", "conversions"]
TARGET = "revenue"
SUM_COLS = ["spend", "clicks", "impressions", "daily_budget"]
UNSEEN = "__UNSEEN__"

CV_FOLDS = 5
HOLDOUT_FRACTION = 0.8
MULTIPLIER_MIN, MULTIPLIER_MAX = 0.1, 3.0

# Label thresholds.
ROAS_LABELS = [(3.0, "HIGH PERFORMER"), (1.0, "PROFITABLE"), (0.5, "MARGINAL")]
ROAS_LABEL_ELSE = "UNDERPERFORMING"
RISK_HIGH, RISK_MED = 1.5, 0.5
OUTLOOK_BAND = 0.10          # forecast vs historical ROAS
TREND_BAND_PCT = 5.0         # monthly growth 90 d vs 30 d, in percent
ANOMALY_BAND_PCT = 10.0      # predicted vs historical daily revenue, in percent
CONCENTRATION_PCT = 60       # rounded share of spend
HIGH_UNCERTAINTY_PCT = 150.0
DATA_QUALITY_RATIO = 1.5
CONFIDENCE_ROAS = 0.5        # blended ROAS above -> "85%" else "70%"
FAN_STEP_DAYS = 3
FAN_P50_GROWTH, FAN_P90_GROWTH = 0.03, 0.05
FAN_ROAS_GROWTH = {"p10": 0.05, "p50": 0.08, "p90": 0.10}

# Rolling columns carried forward into period rows.
CARRY_FORWARD_COLS = [
    "revenue_roll_7d_mean", "revenue_roll_14d_mean", "revenue_roll_30d_mean",
    "revenue_roll_7d_std", "revenue_roll_14d_std", "revenue_roll_30d_std",
    "spend_roll_7d_mean", "spend_roll_14d_mean", "spend_roll_30d_mean",
    "spend_roll_7d_std", "spend_roll_14d_std", "spend_roll_30d_std",
    "roas_roll_7d_mean", "roas_roll_14d_mean", "roas_roll_30d_mean",
    "clicks_roll_7d_mean", "clicks_roll_14d_mean", "clicks_roll_30d_mean",
    "revenue_momentum", "spend_momentum",
]

# Long feature explanations (report) and short ones (dashboard).
FEATURE_EXPLANATIONS = {
    "roas": "Historical return on ad spend (revenue per dollar spent)",
    "spend": "Daily advertising expenditure",
    "clicks": "Number of ad clicks received",
    "impressions": "Number of times ads were shown",
    "daily_budget": "Configured daily budget cap",
    "cpc": "Cost per click (spend efficiency)",
    "cvr": "Conversion rate (conversions per click)",
    "budget_utilization": "Fraction of daily budget actually spent",
    "month": "Month of year (seasonality signal)",
    "day_of_week": "Day of week (weekly patterns)",
    "week_of_year": "Week number (annual seasonality)",
    "quarter": "Fiscal quarter",
    "is_weekend": "Weekend vs weekday indicator",
    "days_since_campaign_start": "Campaign maturity / age in days",
    "revenue_momentum": "Short-term vs long-term revenue trend ratio",
    "spend_momentum": "Short-term vs long-term spend trend ratio",
}
# Pattern rules, checked in order after the exact dictionary: (substring, mean text, std text or None).
FEATURE_PATTERNS = [
    ("revenue_roll", "Average daily revenue over {w} window", "Revenue volatility over {w} window"),
    ("spend_roll", "Average daily spend over {w} window", "Spend volatility over {w} window"),
    ("roas_roll", "Average ROAS over {w} window", None),
    ("clicks_roll", "Average daily clicks over {w} window", None),
]
FEATURE_FALLBACKS = [
    ("channel", "Advertising channel (Google, Bing, Meta)"),
    ("campaign_type", "Campaign type (Search, PMax, Display, etc.)"),
    ("campaign_name", "Individual campaign identifier"),
]
FEATURE_DEFAULT = "Model feature"

FEATURE_EXPLANATIONS_SHORT = {
    "roas": "Return on ad spend",
    "spend": "Daily advertising expenditure",
    "clicks": "Ad clicks received",
    "impressions": "Times ads were shown",
    "daily_budget": "Daily budget cap",
    "cpc": "Cost per click",
    "cvr": "Conversion rate",
    "budget_utilization": "Budget utilisation %",
    "month": "Month of year",
    "day_of_week": "Day of week",
    "week_of_year": "Week number",
    "quarter": "Fiscal quarter",
    "is_weekend": "Weekend indicator",
    "days_since_campaign_start": "Campaign age (days)",
    "revenue_momentum": "Revenue trend ratio",
    "spend_momentum": "Spend trend ratio",
}
# Short rules: a name containing "roll" and the token.
FEATURE_PATTERNS_SHORT = [
    ("revenue", "Rolling revenue metric"),
    ("spend", "Rolling spend metric"),
    ("roas", "Rolling ROAS metric"),
    ("clicks", "Rolling clicks metric"),
]
FEATURE_FALLBACKS_SHORT = [("channel", "Ad channel"), ("campaign", "Campaign identifier")]

# ---------------------------------------------------------------------------
# FIXED VALUES: texts of the report (must stay equal to the original system's texts)
# ---------------------------------------------------------------------------
REPORT_TITLE = "PROBABILISTIC REVENUE FORECAST — CAUSAL SUMMARY"
REPORT_SECTIONS = [
    "EXECUTIVE SUMMARY",
    "KEY REVENUE DRIVERS",
    "CHANNEL PERFORMANCE ANALYSIS",
    "CAMPAIGN TYPE ANALYSIS",
    "FORECAST HORIZON TRENDS",
    "BUDGET EFFICIENCY ANALYSIS",
    "RISK ASSESSMENT",
    "ACTIONABLE RECOMMENDATIONS",
]
REPORT_EMPTY = {
    "drivers": "  No feature importance data available.",
    "channel": "  No channel-level data available.",
    "campaign_type": "  No campaign-type data available.",
    "efficiency": "  No data available.",
    "campaign": "  No campaign-level data available.",
    "uncertainty": "  No high-uncertainty campaigns identified.",
}
ASSESSMENT_TEXT = {
    "HIGH PERFORMER": "strong return on investment",
    "PROFITABLE": "generating positive returns",
    "MARGINAL": "close to break-even",
    "UNDERPERFORMING": "low return on spend",
}
OUTLOOK_TEXT = {
    "IMPROVING": "forecast ROAS exceeds historical",
    "DECLINING": "forecast ROAS below historical",
    "STABLE": "forecast ROAS consistent with historical",
}
TREND_TEXT = {
    "GROWING": "  Trend: GROWING — monthly revenue expected to increase %.0f%% over 90 days",
    "DECLINING": "  Trend: DECLINING — monthly revenue expected to decrease %.0f%% over 90 days",
    "STABLE": "  Trend: STABLE — monthly revenue expected to remain roughly flat over 90 days",
}
DRIVER_TEXT = {
    "roas": "    The strong influence of ROAS metrics suggests that campaigns with historically efficient ad spend are the best predictors of future revenue.",
    "spend": "    Spend level is a significant driver, indicating that budget allocation directly impacts revenue outcomes.",
    "rolling": "    Rolling average features rank highly, showing that recent performance trends are more predictive than point-in-time metrics.",
}
