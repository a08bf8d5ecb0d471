"""DuckDB oracle SQL, written independently of the Spark operators.

Every oracle starts from the fixture view ``ad_daily`` (FIXTURES.md section 2) over
the pre-registered ``lineitem`` and ``part`` views.  CTE fragments are shared
between oracles; the final SELECT applies the same comparison rules as
``plans.present``.
"""

from __future__ import annotations

AD_DAILY = """ad_daily AS (
  WITH src AS (
    SELECT CAST(l.l_shipdate AS DATE) AS date,
      CASE l.l_returnflag WHEN 'A' THEN 'google' WHEN 'N' THEN 'bing' ELSE 'meta' END AS channel,
      CASE p.p_type WHEN 'ECONOMY' THEN 'SEARCH' WHEN 'STANDARD' THEN 'PERFORMANCE_MAX'
                    WHEN 'PROMO' THEN 'SHOPPING' WHEN 'SMALL' THEN 'DISPLAY'
                    WHEN 'MEDIUM' THEN 'AUDIENCE' ELSE 'OTHER' END AS campaign_type,
      concat(p.p_type, '_Campaign_', l.l_linestatus) AS campaign_name,
      l.l_extendedprice, l.l_tax, l.l_quantity, l.l_linenumber
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
  SELECT date, channel, campaign_type, campaign_name,
    concat(channel, '-', campaign_name) AS campaign_id,
    sum(CASE WHEN l_quantity >= 10 THEN l_extendedprice ELSE 0 END) AS revenue,
    sum(l_quantity * l_tax * 10000) AS spend,
    CAST(sum(l_quantity) AS BIGINT) AS clicks,
    CAST(sum(l_quantity * l_linenumber * 10) AS BIGINT) AS impressions,
    CASE WHEN channel = 'meta' THEN NULL
         ELSE CAST(sum(CASE WHEN l_quantity >= 10 THEN 1 ELSE 0 END) AS DOUBLE) END AS conversions,
    CASE WHEN extract(day FROM date) % 7 = 0 THEN NULL ELSE max(l_extendedprice) * 0.2 END AS daily_budget
  FROM src
  WHERE NOT (channel = 'bing' AND campaign_type = 'AUDIENCE' AND date >= DATE '2001-06-01')
    AND NOT (channel = 'google' AND campaign_type = 'DISPLAY' AND date >= DATE '2001-09-01')
    AND NOT (channel = 'meta' AND campaign_name = 'PROMO_Campaign_F' AND extract(day FROM date) <> 1)
  GROUP BY date, channel, campaign_type, campaign_name)"""

_W = "PARTITION BY channel, campaign_name ORDER BY date, campaign_type, campaign_id"

FILLED = f"""filled AS (
  SELECT date, channel, campaign_type, campaign_name, campaign_id, revenue, spend, clicks, impressions, conversions,
    coalesce(daily_budget,
      last_value(daily_budget IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(daily_budget IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      0.0) AS daily_budget
  FROM ad_daily)"""

CLEANED = """cleaned AS (
  SELECT * FROM filled
  WHERE NOT (revenue IS NOT DISTINCT FROM 0 AND spend IS NOT DISTINCT FROM 0))"""


def _roll_cols() -> str:
    parts = []
    for n in (7, 14, 30):
        w = f"w{n}"
        parts += [
            f"avg(revenue) OVER {w} AS revenue_roll_{n}d_mean",
            f"coalesce(stddev_samp(revenue) OVER {w}, 0.0) AS revenue_roll_{n}d_std",
            f"avg(spend) OVER {w} AS spend_roll_{n}d_mean",
            f"coalesce(stddev_samp(spend) OVER {w}, 0.0) AS spend_roll_{n}d_std",
            f"avg(roas) OVER {w} AS roas_roll_{n}d_mean",
            f"avg(clicks) OVER {w} AS clicks_roll_{n}d_mean",
        ]
    return ",\n    ".join(parts)


FEATURES = f"""base_feat AS (
  SELECT *,
    month(date) AS month, isodow(date) - 1 AS day_of_week, weekofyear(date) AS week_of_year,
    quarter(date) AS quarter, CASE WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN spend > 0 THEN revenue / spend ELSE 0.0 END AS roas,
    CASE WHEN clicks > 0 THEN spend / clicks ELSE 0.0 END AS cpc,
    coalesce(CASE WHEN clicks > 0 THEN conversions / clicks ELSE 0.0 END, 0.0) AS cvr,
    CASE WHEN daily_budget > 0 THEN spend / daily_budget ELSE 0.0 END AS budget_utilization,
    date_diff('day', min(date) OVER (PARTITION BY channel, campaign_name), date) AS days_since_campaign_start
  FROM cleaned),
roll_feat AS (
  SELECT *,
    {_roll_cols()}
  FROM base_feat
  WINDOW w7 AS ({_W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w14 AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
         w30 AS ({_W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
features AS (
  SELECT *,
    CASE WHEN revenue_roll_30d_mean > 0 THEN revenue_roll_7d_mean / revenue_roll_30d_mean ELSE 1.0 END AS revenue_momentum,
    CASE WHEN spend_roll_30d_mean > 0 THEN spend_roll_7d_mean / spend_roll_30d_mean ELSE 1.0 END AS spend_momentum
  FROM roll_feat)"""

SNAP = "snap AS (SELECT max(date) AS snap FROM cleaned)"

HROWS = """hrows AS (
  SELECT c.*, h.forecast_horizon
  FROM cleaned c CROSS JOIN snap CROSS JOIN (VALUES (30), (60), (90)) h(forecast_horizon)
  WHERE date_diff('day', c.date, snap.snap) < h.forecast_horizon)"""

DAILY_GROUPS = """dgs AS (
  SELECT forecast_horizon, date, channel, campaign_type, campaign_name,
    grouping(campaign_type) AS gt, grouping(campaign_name) AS gn,
    coalesce(sum(revenue), 0.0) AS day_revenue, coalesce(sum(spend), 0.0) AS day_spend
  FROM hrows
  GROUP BY GROUPING SETS ((forecast_horizon, date, channel),
                          (forecast_horizon, date, channel, campaign_type),
                          (forecast_horizon, date, channel, campaign_type, campaign_name))),
daily_groups AS (
  SELECT forecast_horizon, date,
    CASE WHEN gt = 1 THEN 'channel' WHEN gn = 1 THEN 'campaign_type' ELSE 'campaign' END AS granularity,
    channel,
    CASE WHEN gt = 1 THEN 'ALL' ELSE campaign_type END AS campaign_type,
    CASE WHEN gn = 1 THEN 'ALL' ELSE campaign_name END AS campaign_name,
    day_revenue, day_spend
  FROM dgs)"""

BASE = """fbase AS (
  SELECT forecast_horizon, granularity, channel, campaign_type, campaign_name,
    count(*) AS days_in_window,
    count(CASE WHEN day_revenue > 0 THEN 1 END) AS nonzero_revenue_days,
    sum(day_revenue) / count(*) AS historical_daily_revenue,
    sum(day_spend) / count(*) AS historical_daily_spend,
    max(date) AS last_date,
    quantile_cont(day_revenue, 0.1) AS q10,
    quantile_cont(day_revenue, 0.5) AS q50,
    quantile_cont(day_revenue, 0.9) AS q90
  FROM daily_groups
  GROUP BY forecast_horizon, granularity, channel, campaign_type, campaign_name)"""


def forecast_ctes(multiplier: str = "CAST(1.0 AS DOUBLE)", src: str = "fbase") -> str:
    return f"""fp AS (
  SELECT *, nonzero_revenue_days < 5 AS low_confidence, {multiplier} AS budget_multiplier,
    historical_daily_spend * forecast_horizon * {multiplier} AS projected_spend,
    greatest(CASE WHEN nonzero_revenue_days < 5 THEN historical_daily_revenue ELSE q10 END, 0.0) * forecast_horizon * {multiplier} AS r10,
    greatest(CASE WHEN nonzero_revenue_days < 5 THEN historical_daily_revenue ELSE q50 END, 0.0) * forecast_horizon * {multiplier} AS r50,
    greatest(CASE WHEN nonzero_revenue_days < 5 THEN historical_daily_revenue ELSE q90 END, 0.0) * forecast_horizon * {multiplier} AS r90
  FROM {src}),
fr1 AS (SELECT *, CASE WHEN r10 > r50 THEN r50 * 0.8 ELSE r10 END AS a10 FROM fp),
fr2 AS (SELECT *, CASE WHEN r90 < r50 THEN r50 * 1.2 ELSE r90 END AS a90 FROM fr1),
fr3 AS (SELECT *, CASE WHEN a10 > a90 THEN a90 ELSE a10 END AS b10,
                  CASE WHEN a10 > a90 THEN a10 ELSE a90 END AS b90 FROM fr2),
fcast AS (
  SELECT forecast_horizon, granularity, channel, campaign_type, campaign_name,
    CASE WHEN projected_spend > 0 THEN least(b10, 20.0 * projected_spend) ELSE b10 END AS revenue_p10,
    CASE WHEN projected_spend > 0 THEN least(r50, 20.0 * projected_spend) ELSE r50 END AS revenue_p50,
    CASE WHEN projected_spend > 0 THEN least(b90, 20.0 * projected_spend) ELSE b90 END AS revenue_p90,
    CASE WHEN projected_spend > 0 THEN least(b10 / projected_spend, 20.0) ELSE 0.0 END AS roas_p10,
    CASE WHEN projected_spend > 0 THEN least(r50 / projected_spend, 20.0) ELSE 0.0 END AS roas_p50,
    CASE WHEN projected_spend > 0 THEN least(b90 / projected_spend, 20.0) ELSE 0.0 END AS roas_p90,
    projected_spend, budget_multiplier, historical_daily_revenue, historical_daily_spend,
    days_in_window, nonzero_revenue_days, low_confidence
  FROM fr3)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes)


# Common stacks.
def clean_stack() -> list[str]:
    return [AD_DAILY, FILLED, CLEANED]


def feature_stack() -> list[str]:
    return clean_stack() + [FEATURES]


def forecast_stack(multiplier: str = "CAST(1.0 AS DOUBLE)") -> list[str]:
    return clean_stack() + [SNAP, HROWS, DAILY_GROUPS, BASE, forecast_ctes(multiplier)]
