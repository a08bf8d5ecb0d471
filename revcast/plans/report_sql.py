"""DuckDB oracles of the explanations (P22), the report lines (I14) and the report context.

All texts are written out here, apart from ``revcast.constants``, so that a wrong text on either side
shows.  Numbers are formatted as the report does: whole money half-even with commas; decimals half-up
on the number's shortest digits.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES: texts of the report and of the explanations (must stay equal to the original system's texts)
# ---------------------------------------------------------------------------
EXPLAIN_LONG = """CASE
  WHEN {x} = 'roas' THEN 'Historical return on ad spend (revenue per dollar spent)'
  WHEN {x} = 'spend' THEN 'Daily advertising expenditure'
  WHEN {x} = 'clicks' THEN 'Number of ad clicks received'
  WHEN {x} = 'impressions' THEN 'Number of times ads were shown'
  WHEN {x} = 'daily_budget' THEN 'Configured daily budget cap'
  WHEN {x} = 'cpc' THEN 'Cost per click (spend efficiency)'
  WHEN {x} = 'cvr' THEN 'Conversion rate (conversions per click)'
  WHEN {x} = 'budget_utilization' THEN 'Fraction of daily budget actually spent'
  WHEN {x} = 'month' THEN 'Month of year (seasonality signal)'
  WHEN {x} = 'day_of_week' THEN 'Day of week (weekly patterns)'
  WHEN {x} = 'week_of_year' THEN 'Week number (annual seasonality)'
  WHEN {x} = 'quarter' THEN 'Fiscal quarter'
  WHEN {x} = 'is_weekend' THEN 'Weekend vs weekday indicator'
  WHEN {x} = 'days_since_campaign_start' THEN 'Campaign maturity / age in days'
  WHEN {x} = 'revenue_momentum' THEN 'Short-term vs long-term revenue trend ratio'
  WHEN {x} = 'spend_momentum' THEN 'Short-term vs long-term spend trend ratio'
  WHEN {x} LIKE '%revenue_roll%' AND {x} LIKE '%std%' THEN 'Revenue volatility over ' || split_part({x}, '_', 3) || ' window'
  WHEN {x} LIKE '%revenue_roll%' THEN 'Average daily revenue over ' || split_part({x}, '_', 3) || ' window'
  WHEN {x} LIKE '%spend_roll%' AND {x} LIKE '%std%' THEN 'Spend volatility over ' || split_part({x}, '_', 3) || ' window'
  WHEN {x} LIKE '%spend_roll%' THEN 'Average daily spend over ' || split_part({x}, '_', 3) || ' window'
  WHEN {x} LIKE '%roas_roll%' THEN 'Average ROAS over ' || split_part({x}, '_', 3) || ' window'
  WHEN {x} LIKE '%clicks_roll%' THEN 'Average daily clicks over ' || split_part({x}, '_', 3) || ' window'
  WHEN {x} LIKE '%channel%' THEN 'Advertising channel (Google, Bing, Meta)'
  WHEN {x} LIKE '%campaign_type%' THEN 'Campaign type (Search, PMax, Display, etc.)'
  WHEN {x} LIKE '%campaign_name%' THEN 'Individual campaign identifier'
  ELSE 'Model feature' END"""

EXPLAIN_SHORT = """CASE
  WHEN {x} = 'roas' THEN 'Return on ad spend'
  WHEN {x} = 'spend' THEN 'Daily advertising expenditure'
  WHEN {x} = 'clicks' THEN 'Ad clicks received'
  WHEN {x} = 'impressions' THEN 'Times ads were shown'
  WHEN {x} = 'daily_budget' THEN 'Daily budget cap'
  WHEN {x} = 'cpc' THEN 'Cost per click'
  WHEN {x} = 'cvr' THEN 'Conversion rate'
  WHEN {x} = 'budget_utilization' THEN 'Budget utilisation %'
  WHEN {x} = 'month' THEN 'Month of year'
  WHEN {x} = 'day_of_week' THEN 'Day of week'
  WHEN {x} = 'week_of_year' THEN 'Week number'
  WHEN {x} = 'quarter' THEN 'Fiscal quarter'
  WHEN {x} = 'is_weekend' THEN 'Weekend indicator'
  WHEN {x} = 'days_since_campaign_start' THEN 'Campaign age (days)'
  WHEN {x} = 'revenue_momentum' THEN 'Revenue trend ratio'
  WHEN {x} = 'spend_momentum' THEN 'Spend trend ratio'
  WHEN {x} LIKE '%roll%' AND {x} LIKE '%revenue%' THEN 'Rolling revenue metric'
  WHEN {x} LIKE '%roll%' AND {x} LIKE '%spend%' THEN 'Rolling spend metric'
  WHEN {x} LIKE '%roll%' AND {x} LIKE '%roas%' THEN 'Rolling ROAS metric'
  WHEN {x} LIKE '%roll%' AND {x} LIKE '%clicks%' THEN 'Rolling clicks metric'
  WHEN {x} LIKE '%channel%' THEN 'Ad channel'
  WHEN {x} LIKE '%campaign%' THEN 'Campaign identifier'
  ELSE 'Model feature' END"""

ASSESSMENT = """CASE assessment WHEN 'HIGH PERFORMER' THEN 'strong return on investment' WHEN 'PROFITABLE' THEN 'generating positive returns'
  WHEN 'MARGINAL' THEN 'close to break-even' ELSE 'low return on spend' END"""
OUTLOOK = """CASE outlook WHEN 'IMPROVING' THEN 'forecast ROAS exceeds historical' WHEN 'DECLINING' THEN 'forecast ROAS below historical'
  ELSE 'forecast ROAS consistent with historical' END"""


def explain_long(x: str) -> str:
    return EXPLAIN_LONG.replace("{x}", x)


def explain_short(x: str) -> str:
    return EXPLAIN_SHORT.replace("{x}", x)


# ---------------------------------------------------------------- numbers as text
def money(x: str) -> str:
    return f"('$' || format('{{:,.0f}}', {x}))"


def digits(x: str, n: int) -> str:
    return f"CAST(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 15)) AS DECIMAL(38, {n}))::VARCHAR"


def left(x: str, width: int) -> str:
    return f"rpad({x}, greatest({width}, length({x}))::INTEGER, ' ')"


def right(x: str, width: int) -> str:
    return f"lpad({x}, greatest({width}, length({x}))::INTEGER, ' ')"


# ---------------------------------------------------------------- lines
def lines(body: str, section: int, ord_: int, texts: list[str], num: str = "0.0", text1: str = "''", text2: str = "''") -> str:
    """Lines of each row of ``body``; a text that is NULL is no line."""
    return (f"SELECT * FROM (SELECT {section} AS section, {ord_} AS ord, CAST({num} AS DOUBLE) AS num, {text1} AS text1, {text2} AS text2, "
            f"unnest(range({len(texts)})) AS k, unnest([{', '.join(texts)}]) AS line FROM ({body}) t) WHERE line IS NOT NULL")


def when(condition: str, text: str) -> str:
    return f"CASE WHEN {condition} THEN {text} END"


def report_lines(bodies: dict[str, str]) -> str:
    """``bodies``: SQL of the insight tables over ``rcast`` (the exported forecast); ``features`` and ``ranked`` are at hand."""
    drivers = f"SELECT *, {explain_long('feature')} AS explanation FROM ranked WHERE rank <= 10"
    top3 = """SELECT list(feature ORDER BY rank) AS f, coalesce(bool_or(feature IN ('roas', 'roas_roll_7d_mean')), false) AS roas,
      coalesce(bool_or(feature = 'spend'), false) AS spend, coalesce(bool_or(feature LIKE '%roll%'), false) AS rolling, count(*) AS n FROM ranked WHERE rank <= 3"""
    one = """SELECT count(*) AS n_rows, count(*) FILTER (WHERE forecast_horizon = 30 AND granularity = 'channel') AS n_channel,
      count(*) FILTER (WHERE forecast_horizon = 30 AND granularity = 'campaign_type') AS n_type,
      count(*) FILTER (WHERE forecast_horizon = 30 AND granularity = 'campaign') AS n_campaign,
      count(*) FILTER (WHERE forecast_horizon = 30 AND granularity = 'campaign' AND revenue_p50 > 0 AND (revenue_p90 - revenue_p10) / revenue_p50 * 100 > 150) AS n_high,
      count(*) FILTER (WHERE forecast_horizon = 30 AND granularity = 'campaign' AND revenue_p50 = 0) AS n_zero FROM rcast"""
    head = """SELECT (SELECT count(*) FROM rcast) AS n_rows, CAST(min(date) AS VARCHAR) AS a, CAST(max(date) AS VARCHAR) AS b,
      string_agg(DISTINCT channel, ', ' ORDER BY channel) AS channels FROM features"""
    rule = "'" + "=" * 70 + "'"
    titles = ["EXECUTIVE SUMMARY", "KEY REVENUE DRIVERS", "CHANNEL PERFORMANCE ANALYSIS", "CAMPAIGN TYPE ANALYSIS", "FORECAST HORIZON TRENDS",
              "BUDGET EFFICIENCY ANALYSIS", "RISK ASSESSMENT", "ACTIONABLE RECOMMENDATIONS"]
    performer = lambda label, side: (
        f"'  {label}: ' || {side}_type || ' (' || {side}_type_channel || ') — ' || {money(f'{side}_type_revenue_p50')} || ' revenue, ' || {digits(f'{side}_type_roas_p50', 2)} || 'x ROAS'")
    trend = lambda label, text: when(f"forecast_horizon = 90 AND trend = '{label}'", f"'  Trend: {label} — monthly revenue expected to ' || {text} || ' over 90 days'")
    parts = [
        lines(head, 0, 0, [rule, "'PROBABILISTIC REVENUE FORECAST — CAUSAL SUMMARY'", rule, "'Training Data: ' || a || ' to ' || b", "'Channels: ' || channels",
                           "'Total Forecast Rows: ' || n_rows"]),
        *[lines("SELECT 1", i, -1, [f"'## {title}'"]) for i, title in enumerate(titles, 1)],
        lines(bodies["kpis"], 1, 0, [
            "'  ' || forecast_horizon || '-Day Forecast:'",
            f"'    Expected Revenue (P50): ' || {money('revenue_p50')}", f"'    Optimistic Range (P90): ' || {money('revenue_p90')}",
            f"'    Conservative Range (P10): ' || {money('revenue_p10')}", f"'    Projected Spend: ' || {money('projected_spend')}",
            f"'    Blended ROAS: ' || {digits('blended_roas', 2)} || 'x'"], "forecast_horizon"),
        lines(top3, 2, 0, [when("n > 0", "'  Top 10 features driving revenue predictions:'"), when("n = 0", "'  No feature importance data available.'")]),
        lines(drivers, 2, 1, [f"'    ' || {right('rank::VARCHAR', 2)} || '. ' || {left('feature', 30)} || ' (' || {right(digits('pct_of_all', 1), 5)} || '% importance) — ' || explanation"], "rank"),
        lines(top3, 2, 2, [
            when("n > 0", "''"), when("n > 0", "'  Causal Interpretation:'"),
            when("n >= 3", "'    Revenue is primarily driven by ' || f[1] || ', ' || f[2] || ', and ' || f[3] || '.'"),
            when("roas", "'    The strong influence of ROAS metrics suggests that campaigns with historically efficient ad spend are the best predictors of future revenue.'"),
            when("spend", "'    Spend level is a significant driver, indicating that budget allocation directly impacts revenue outcomes.'"),
            when("rolling", "'    Rolling average features rank highly, showing that recent performance trends are more predictive than point-in-time metrics.'")]),
        lines(one, 3, 0, [when("n_channel = 0", "'  No channel-level data available.'")]),
        lines(bodies["channel_analysis"], 3, 1, [
            "'  ' || upper(channel)", f"'    30-Day P50 Revenue: ' || {money('revenue_p50')} || ' (' || {digits('share_pct', 0)} || '% of total)'",
            f"'    Revenue Range: ' || {money('revenue_p10')} || ' — ' || {money('revenue_p90')}", f"'    ROAS (P50): ' || {digits('roas_p50', 2)} || 'x'",
            f"'    Projected Spend: ' || {money('projected_spend')}", f"'    Forecast Uncertainty: ±' || {digits('width_pct', 0)} || '%'",
            f"'    Assessment: ' || assessment || ' — ' || {ASSESSMENT}"], "-revenue_p50", "channel"),
        lines(one, 4, 0, [
            when("n_type = 0", "'  No campaign-type data available.'"), when("n_type > 0", "'  30-Day Revenue Forecast by Campaign Type:'"),
            when("n_type > 0", "'  Campaign Type             Channel     P50 Revenue     ROAS     Risk'"), when("n_type > 0", "'  " + "-" * 65 + "'")]),
        lines(bodies["type_analysis"], 4, 1, [
            f"'  ' || {left('campaign_type', 25)} || ' ' || {left('channel', 10)} || ' $' || {right(f'''substr({money('revenue_p50')}, 2)''', 10)} || ' ' || "
            f"{right(digits('roas_p50', 2), 7)} || 'x ' || {right('risk', 7)}"], "-revenue_p50", "channel", "campaign_type"),
        lines(bodies["best_worst"], 4, 2, [performer("Top Performer", "top"), performer("Lowest Revenue", "lowest")]),
        lines(bodies["horizon_trend"], 5, 0, [
            f"'  ' || forecast_horizon || '-Day: Total P50 = ' || {money('total_p50')} || ' (~' || {money('avg_monthly_p50')} || '/month), Spend = ' || {money('total_spend')}",
            trend("GROWING", f"'increase ' || {digits('abs(growth_pct)', 0)} || '%'"), trend("DECLINING", f"'decrease ' || {digits('abs(growth_pct)', 0)} || '%'"),
            trend("STABLE", "'remain roughly flat'")], "forecast_horizon"),
        lines(one, 6, 0, [when("n_channel = 0", "'  No data available.'"), when("n_channel > 0", "'  Channel Efficiency (30-Day Horizon):'")]),
        lines(bodies["budget_efficiency"], 6, 1, [
            "'  ' || upper(channel)", f"'    Historical Daily Revenue: ' || {money('historical_daily_revenue')}", f"'    Historical Daily Spend: ' || {money('historical_daily_spend')}",
            f"'    Historical ROAS: ' || {digits('historical_roas', 2)} || 'x'", f"'    Forecast P50 ROAS: ' || {digits('roas_p50', 2)} || 'x'",
            f"'    Outlook: ' || outlook || ' — ' || {OUTLOOK}"], "-roas_p50", "channel"),
        lines(one, 7, 0, [
            when("n_campaign = 0", "'  No campaign-level data available.'"), when("n_high > 0", "'  HIGH UNCERTAINTY CAMPAIGNS (' || n_high || ' identified):'"),
            when("n_campaign > 0 AND n_high = 0", "'  No high-uncertainty campaigns identified.'")]),
        lines(bodies["high_uncertainty"], 7, 1, [
            f"'    - ' || campaign_name || ' (' || channel || '): P10=' || {money('revenue_p10')} || ', P50=' || {money('revenue_p50')} || ', P90=' || {money('revenue_p90')} || "
            f"' (±' || {digits('uncertainty_pct', 0)} || '%)'"], "-uncertainty_pct", "channel", "campaign_name"),
        lines(f"SELECT * FROM ({one}) WHERE n_zero > 0", 7, 2, [
            "''", "'  ZERO-REVENUE CAMPAIGNS (' || n_zero || ' identified):'", "'    These campaigns show zero median revenue forecast:'"]),
        lines(bodies["zero_revenue"], 7, 3, [
            f"'    - ' || campaign_name || ' (' || channel || ', ' || campaign_type || '): Spend=' || {money('projected_spend')}"], "0.0", "channel", "campaign_name"),
        lines(bodies["recommendations"], 8, 0, [f"""'  ' || rec_num || '. ' || CASE rule
            WHEN 'BUDGET REALLOCATION' THEN 'BUDGET REALLOCATION: Consider shifting budget from ' || worst_channel || ' (ROAS: ' || {digits('worst_channel_roas_p50', 2)} || 'x) to '
              || best_channel || ' (ROAS: ' || {digits('best_channel_roas_p50', 2)} || 'x) to improve overall portfolio ROAS.'
            WHEN 'CAMPAIGN PRUNING' THEN 'CAMPAIGN PRUNING: ' || zero_revenue_campaigns || ' campaigns have zero median revenue forecast but ' || {money('wasted_spend')}
              || ' in projected spend. Review these campaigns for potential pause or restructuring.'
            WHEN 'DATA QUALITY' THEN 'DATA QUALITY: ' || data_quality_campaigns || ' campaigns have forecast uncertainty exceeding 150%. Collecting more data or adding conversion tracking may improve prediction confidence.'
            ELSE 'SCENARIO PLANNING: Run the forecast with budget multipliers 1.2 and 0.8 to model the impact of ±20% budget changes on forecasted revenue.' END"""], "rec_num"),
        lines("SELECT 1", 8, 1, ["''", rule, "'End of Causal Summary Report'", rule]),
    ]
    return ("SELECT CAST(section AS BIGINT) AS section, CAST(ord AS BIGINT) AS ord, round(num + 1e-9, 4) AS num, text1, text2, CAST(k AS BIGINT) AS k, line FROM (\n"
            + "\nUNION ALL ".join(parts) + ") u")


REPORT_CONTEXT = """
SELECT 'training' AS part, 1::BIGINT AS place, CAST(min(date) AS VARCHAR) || ' ' || CAST(max(date) AS VARCHAR) AS name,
  string_agg(DISTINCT channel, ',' ORDER BY channel) || ';' || string_agg(DISTINCT campaign_type, ',' ORDER BY campaign_type) AS text, NULL::DOUBLE AS a, NULL::DOUBLE AS b, NULL::DOUBLE AS c
FROM features
UNION ALL SELECT 'forecast', row_number() OVER (ORDER BY channel), channel, campaign_type || ';' || campaign_name, revenue_p10, revenue_p50, revenue_p90
FROM rcast WHERE granularity = 'channel' AND forecast_horizon = 30
UNION ALL SELECT 'feature', rank, feature, NULL, round(importance, 6), NULL, NULL FROM ranked WHERE rank <= 10"""
