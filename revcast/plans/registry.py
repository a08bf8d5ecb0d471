"""Query registry: every operator from SURVEY section 2 that has a table-level
check gets (a) a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where SQL
can express it, (b) an independent DuckDB oracle.

Column names and rounding are identical on both sides (``plans.present``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revcast.constants import UNIFIED_COLUMNS
from revcast.operators import forecast as fc
from revcast.operators.features import feature_order
from revcast.plans import daily
from revcast.plans import oracle_sql as O
from revcast.plans import report_sql as R
from revcast.plans.present import present, sql_select


@dataclass
class Query:
    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------- cleaning
CLEAN_SPEC = {"revenue": "money", "spend": "money", "conversions": "money", "daily_budget": "money",
              "clicks": "int", "impressions": "int"}


@register("clean_daily", O.with_ctes(*O.clean_stack()) + f"\nSELECT {sql_select(CLEAN_SPEC, UNIFIED_COLUMNS)} FROM cleaned")
def q_clean_daily(spark, sf):
    return present(daily.cleaned_daily(spark, sf), CLEAN_SPEC)


# ---------------------------------------------------------------- vendor records
#: CSV columns of each vendor's records over lineitem, in an order of their own, with one unnamed and one
#: quoted extra column: (name, value in both dialects).  Names hold commas, doubled quotes and line breaks.
_VENDOR_NAME = "concat('Prospecting_', l_returnflag, ', \"x\"', chr(10), l_linestatus)"
_VENDOR_TYPE = "CASE l_returnflag WHEN 'A' THEN '{}' WHEN 'N' THEN '{}' ELSE 'search' END"
_VENDOR_BUDGET = "CASE WHEN l_linenumber = 1 THEN '' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"
_VENDOR_COLUMNS = {
    "google": {"": "'0'", "campaign_budget_amount": _VENDOR_BUDGET, "segments_date": "DATE", "a, b": "'1,2'", "campaign_name": _VENDOR_NAME,
               "campaign_advertising_channel_type": _VENDOR_TYPE.format("SEARCH", "DEMAND_GEN"), "campaign_id": "CAST(l_orderkey AS STRING)",
               "metrics_cost_micros": "CAST(CAST(l_quantity * 1000000 AS BIGINT) AS STRING)", "metrics_conversions_value": "CAST(CAST(l_extendedprice AS BIGINT) AS STRING)",
               "metrics_clicks": "CAST(l_linenumber AS STRING)", "metrics_impressions": "concat(CAST(l_orderkey AS STRING), '.0')", "metrics_conversions": "'2.5'"},
    "bing": {"Spend": "CAST(CAST(l_quantity AS INT) AS STRING)", "Revenue": "CAST(CAST(l_extendedprice AS BIGINT) AS STRING)", "TimePeriod": "DATE", "Max, bid": "'1,2'",
             "CampaignType": _VENDOR_TYPE.format("PerformanceMax", "Audience"), "CampaignName": _VENDOR_NAME, "CampaignId": "CAST(l_orderkey AS STRING)",
             "Impressions": "concat(CAST(l_orderkey AS STRING), '.0')", "Clicks": "CAST(l_linenumber AS STRING)", "Conversions": "'2.5'", "DailyBudget": _VENDOR_BUDGET, "": "''"},
    "meta": {"campaign_name": _VENDOR_NAME, "impressions": "concat(CAST(l_orderkey AS STRING), '.9')", "date_start": "DATE", "campaign_id": "CAST(l_orderkey AS STRING)", "x,\n\"y\"": "'1,2'",
             "conversion": "CAST(CAST(l_extendedprice AS BIGINT) AS STRING)", "spend": "CAST(CAST(l_quantity AS INT) AS STRING)", "clicks": "concat(CAST(l_linenumber AS STRING), '.2')",
             "daily_budget": _VENDOR_BUDGET},
}


def _vendor_records(spark, sf, channel):
    """The vendor's records over lineitem, read by the vendor reader."""
    from revcast.session import table_path
    from revcast.sources import vendors as V

    columns = _VENDOR_COLUMNS[channel]
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    day = F.element_at(F.array(*[F.date_format("l_shipdate", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy")]), F.col("l_linenumber") % 3 + 1)
    cells = [day if v == "DATE" else quoted(F.expr(v)) if any(c in v for c in ",(") else F.expr(v) for v in columns.values()]
    head = ",".join('"' + c.replace('"', '""') + '"' if "," in c else c for c in columns)
    names = V.header_names(head)
    files = spark.createDataFrame([("f", len(names), [names.index(c) for c in V.LAYOUTS[channel]])], "file string, width int, places array<int>")
    rows = spark.read.parquet(table_path(sf, "lineitem")).select(F.lit("f").alias("file"), F.lit(channel).alias("channel"), F.concat_ws(",", *cells).alias("record"))
    return present(V.unified_of(rows, files), CLEAN_SPEC)


def _vendor_sql(channel):
    kinds = {"google": ("SEARCH", "DEMAND_GEN"), "bing": ("PERFORMANCE_MAX", "AUDIENCE"), "meta": ("PROSPECTING", "PROSPECTING")}[channel]
    return f"""WITH u AS (SELECT CAST(l_shipdate AS DATE) AS date, '{channel}' AS channel,
      CASE l_returnflag WHEN 'A' THEN '{kinds[0]}' WHEN 'N' THEN '{kinds[1]}' ELSE '{'PROSPECTING' if channel == 'meta' else 'OTHER'}' END AS campaign_type,
      {_VENDOR_NAME} AS campaign_name, CAST(l_orderkey AS VARCHAR) AS campaign_id, CAST(CAST(trunc(l_extendedprice) AS BIGINT) AS DOUBLE) AS revenue,
      CAST(CAST(l_quantity AS INT) AS DOUBLE) AS spend, CAST(l_linenumber AS BIGINT) AS clicks, CAST(l_orderkey AS BIGINT) AS impressions,
      {'CAST(NULL AS DOUBLE)' if channel == 'meta' else '2.5'} AS conversions, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS DOUBLE) END AS daily_budget
      FROM lineitem) SELECT {sql_select(CLEAN_SPEC, UNIFIED_COLUMNS)} FROM u"""


for _v in _VENDOR_COLUMNS:
    REGISTRY[f"vendor_{_v}"] = Query(lambda spark, sf, v=_v: _vendor_records(spark, sf, v), _vendor_sql(_v))


# ---------------------------------------------------------------- forecast
FORECAST_SPEC = {
    "forecast_horizon": "int", "days_in_window": "int", "nonzero_revenue_days": "int",
    "revenue_p10": "mean", "revenue_p50": "mean", "revenue_p90": "mean",
    "roas_p10": "ratio", "roas_p50": "ratio", "roas_p90": "ratio",
    "projected_spend": "mean", "historical_daily_revenue": "mean", "historical_daily_spend": "mean",
}


def _forecast_query(gran: str):
    sql = (O.with_ctes(*O.forecast_stack())
           + f"\nSELECT {sql_select(FORECAST_SPEC, fc.FORECAST_COLUMNS)} FROM fcast WHERE granularity = '{gran}'")

    def run(spark, sf):
        out = fc.forecast(daily.feature_daily(spark, sf), granularities=[gran],
                          snapshot=daily.landed_snapshot(spark, sf))
        return present(out, FORECAST_SPEC)
    return run, sql


for _g in ("channel", "campaign_type", "campaign"):
    _fn, _sql = _forecast_query(_g)
    REGISTRY[f"forecast_{'type' if _g == 'campaign_type' else _g}"] = Query(_fn, _sql)


@register("forecast_all", O.with_ctes(*O.forecast_stack()) + f"\nSELECT {sql_select(FORECAST_SPEC, fc.FORECAST_COLUMNS)} FROM fcast")
def q_forecast_all(spark, sf):
    """The whole 3 horizons x 3 granularities forecast table in one plan."""
    return present(fc.forecast(daily.feature_daily(spark, sf), snapshot=daily.landed_snapshot(spark, sf)),
                   FORECAST_SPEC)



# ---------------------------------------------------------------- features
KEYS5 = ["date", "channel", "campaign_type", "campaign_name", "campaign_id"]
CAL = ["month", "day_of_week", "week_of_year", "quarter", "is_weekend"]
RATIOS = ["roas", "cpc", "cvr", "budget_utilization"]
ROLL = [c for c in feature_order() if "_roll_" in c]
ROLL_SPEC = {c: ("ratio" if c.endswith("_std") else "roll") for c in ROLL}


def _feature_query(name: str, cols: list[str], spec: dict[str, str]):
    sql = O.with_ctes(*O.feature_stack()) + f"\nSELECT {sql_select(spec, KEYS5 + cols)} FROM features"

    def run(spark, sf):
        return present(daily.feature_daily(spark, sf).select(*KEYS5, *cols), spec)
    REGISTRY[name] = Query(run, sql)


_feature_query("calendar_features", CAL, {c: "int" for c in CAL})
_feature_query("efficiency_ratios", RATIOS, {c: "ratio" for c in RATIOS})
_feature_query("campaign_age", ["days_since_campaign_start"], {"days_since_campaign_start": "int"})
_feature_query("rolling_features", ROLL, ROLL_SPEC)
_feature_query("momentum", ["revenue_momentum", "spend_momentum"],
               {"revenue_momentum": "ratio", "spend_momentum": "ratio"})


# ---------------------------------------------------------------- daily increments
_SINCE = ["2001-10-01", "2001-10-20"]
_INC_COLS = ["daily_budget", "days_since_campaign_start", *RATIOS, *ROLL, "revenue_momentum", "spend_momentum"]
_INC_SPEC = {**ROLL_SPEC, **{c: "ratio" for c in (*RATIOS, "revenue_momentum", "spend_momentum")}, "daily_budget": "money", "days_since_campaign_start": "int"}


@register("incremental_features", O.with_ctes(*O.feature_stack())
          + f"\nSELECT {sql_select(_INC_SPEC, [*KEYS5, *_INC_COLS])} FROM features WHERE date >= DATE '{_SINCE[0]}'")
def q_incremental_features(spark, sf):
    """The days up to _SINCE leave a state; two increments of later days read only that and their own rows."""
    from revcast.operators.incremental import increment, no_state, with_patches
    raw, state, parts, patches = daily.raw_daily(spark, sf), no_state(spark), [], []
    for low, high in zip([None, *_SINCE], [*_SINCE, None]):
        part = raw.where((F.col("date") >= low) if low else F.lit(True)).where((F.col("date") < high) if high else F.lit(True))
        done = increment(state, part)
        if low:
            parts.append(daily.materialize(done.features, "increment"))
            patches.append(daily.materialize(done.patches, "increment"))
        state = daily.materialize(done.state, "increment")
    rows = with_patches(parts[0].unionByName(parts[1]), patches[0].unionByName(patches[1]))
    return present(rows.select(*KEYS5, *_INC_COLS), _INC_SPEC)


# ---------------------------------------------------------------- look-back / horizons
@register("lookback_rows", O.with_ctes(*O.clean_stack(), O.SNAP) + """
SELECT CAST(h.forecast_horizon AS BIGINT) AS forecast_horizon, CAST(count(*) AS BIGINT) AS rows,
  CAST(count(DISTINCT c.channel) AS BIGINT) AS channels,
  CAST(count(DISTINCT c.channel || '|' || c.campaign_type) AS BIGINT) AS channel_types,
  CAST(count(DISTINCT c.channel || '|' || c.campaign_name) AS BIGINT) AS campaigns
FROM cleaned c CROSS JOIN snap CROSS JOIN (VALUES (30), (60), (90)) h(forecast_horizon)
WHERE c.date > snap.snap - CAST(h.forecast_horizon AS INTEGER)
GROUP BY h.forecast_horizon""")
def q_lookback_rows(spark, sf):
    cl = daily.cleaned_daily(spark, sf)
    snap = daily.landed_snapshot(spark, sf)
    parts = [fc.lookback(cl, h, snap).agg(
        F.lit(h).cast("bigint").alias("forecast_horizon"), F.count(F.lit(1)).alias("rows"),
        F.count_distinct("channel").alias("channels"),
        F.count_distinct("channel", "campaign_type").alias("channel_types"),
        F.count_distinct("channel", "campaign_name").alias("campaigns")) for h in (30, 60, 90)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("horizon_assign", O.with_ctes(*O.clean_stack(), O.SNAP, O.HROWS)
          + "\nSELECT CAST(forecast_horizon AS BIGINT) AS forecast_horizon, date, channel, campaign_name, campaign_id FROM hrows")
def q_horizon_assign(spark, sf):
    h = fc.assign_horizons(daily.cleaned_daily(spark, sf), snapshot=daily.landed_snapshot(spark, sf))
    return h.select(F.col("forecast_horizon").cast("bigint").alias("forecast_horizon"),
                    "date", "channel", "campaign_name", "campaign_id")


BASE_COLS = ["forecast_horizon", "granularity", "channel", "campaign_type", "campaign_name", "days_in_window",
             "nonzero_revenue_days", "historical_daily_revenue", "historical_daily_spend", "last_date",
             "q10", "q50", "q90"]
BASE_SPEC = {"forecast_horizon": "int", "days_in_window": "int", "nonzero_revenue_days": "int",
             "historical_daily_revenue": "mean", "historical_daily_spend": "mean",
             "q10": "mean", "q50": "mean", "q90": "mean"}


@register("forecast_base", O.with_ctes(*O.forecast_stack()) + f"\nSELECT {sql_select(BASE_SPEC, BASE_COLS)} FROM fbase")
def q_forecast_base(spark, sf):
    b = fc.forecast_base(fc.assign_horizons(daily.feature_daily(spark, sf), snapshot=daily.landed_snapshot(spark, sf)))
    b = b.withColumns({f"q{int(q * 100)}": F.col("daily_quantiles")[i] for i, q in enumerate((0.1, 0.5, 0.9))})
    return present(b.select(*BASE_COLS), BASE_SPEC)


# ---------------------------------------------------------------- period features
from revcast import constants as K  # noqa: E402
from revcast.operators import periods as pe  # noqa: E402

PERIOD_SPEC = {
    "forecast_horizon": "int", "total_revenue": "money", "total_spend": "money", "total_clicks": "int",
    "total_impressions": "int", "total_conversions": "money", "mean_daily_revenue": "mean",
    "mean_daily_spend": "mean", "std_daily_revenue": "ratio", "std_daily_spend": "ratio",
    "mean_roas": "mean", "overall_roas": "ratio", "mean_cpc": "mean", "mean_cvr": "mean",
    "mean_budget_util": "mean", "mean_daily_budget": "mean", "total_budget": "money", "active_days": "int",
    "num_campaigns": "int", "revenue_trend": "ratio", "spend_trend": "ratio", "avg_month": "mean",
    "avg_quarter": "mean", "weekend_ratio": "mean",
    **{c: ("ratio" if c.endswith("_std") or c.endswith("momentum") else "roll") for c in K.CARRY_FORWARD_COLS},
}

_CF = ", ".join(f"arg_max({c}, (campaign_name, date, campaign_type, campaign_id)) AS {c}" for c in K.CARRY_FORWARD_COLS)


def _period_level(keys: str, gran: str, sel_keys: str) -> str:
    return f"""SELECT forecast_horizon, '{gran}' AS granularity, max(snapshot_date) AS snapshot_date, {sel_keys},
    sum(revenue) AS total_revenue, sum(spend) AS total_spend, sum(clicks) AS total_clicks,
    sum(impressions) AS total_impressions, coalesce(sum(conversions), 0.0) AS total_conversions,
    avg(revenue) AS mean_daily_revenue, avg(spend) AS mean_daily_spend,
    coalesce(stddev_samp(revenue), 0.0) AS std_daily_revenue, coalesce(stddev_samp(spend), 0.0) AS std_daily_spend,
    avg(roas) AS mean_roas,
    CASE WHEN sum(spend) > 0 THEN sum(revenue) / sum(spend) ELSE 0.0 END AS overall_roas,
    avg(cpc) AS mean_cpc, avg(cvr) AS mean_cvr, avg(budget_utilization) AS mean_budget_util,
    avg(daily_budget) AS mean_daily_budget, sum(daily_budget) AS total_budget,
    count(DISTINCT date) AS active_days, count(DISTINCT campaign_name) AS num_campaigns,
    CASE WHEN coalesce(sum(CASE WHEN date <= mid THEN revenue END), 0) > 0
         THEN (coalesce(sum(CASE WHEN date > mid THEN revenue END), 0) - sum(CASE WHEN date <= mid THEN revenue END))
              / sum(CASE WHEN date <= mid THEN revenue END) ELSE 0.0 END AS revenue_trend,
    CASE WHEN coalesce(sum(CASE WHEN date <= mid THEN spend END), 0) > 0
         THEN (coalesce(sum(CASE WHEN date > mid THEN spend END), 0) - sum(CASE WHEN date <= mid THEN spend END))
              / sum(CASE WHEN date <= mid THEN spend END) ELSE 0.0 END AS spend_trend,
    avg(month) AS avg_month, avg(quarter) AS avg_quarter, avg(is_weekend) AS weekend_ratio,
    {_CF}
  FROM fhrows GROUP BY forecast_horizon, {keys}"""


PERIOD_SQL = O.with_ctes(*O.feature_stack(), O.SNAP, """fhrows AS (
  SELECT f.*, h.forecast_horizon, snap.snap AS snapshot_date,
    CAST(snap.snap - CAST(h.forecast_horizon AS INTEGER) + CAST(h.forecast_horizon // 2 AS INTEGER) AS DATE) AS mid
  FROM features f CROSS JOIN snap CROSS JOIN (VALUES (30), (60), (90)) h(forecast_horizon)
  WHERE f.date > snap.snap - CAST(h.forecast_horizon AS INTEGER))""", f"""periods AS (
  {_period_level("channel", "channel", "channel, 'ALL' AS campaign_type, 'ALL' AS campaign_name")}
  UNION ALL
  {_period_level("channel, campaign_type", "campaign_type", "channel, campaign_type, 'ALL' AS campaign_name")}
  UNION ALL
  {_period_level("channel, campaign_type, campaign_name", "campaign", "channel, campaign_type, campaign_name")})""")


@register("period_features", PERIOD_SQL + f"\nSELECT {sql_select(PERIOD_SPEC, pe.PERIOD_COLUMNS)} FROM periods")
def q_period_features(spark, sf):
    return present(pe.period_features(daily.feature_daily(spark, sf), snapshot=daily.landed_snapshot(spark, sf)),
                   PERIOD_SPEC)


_HT = ["forecast_horizon", "granularity", "channel", "campaign_type", "campaign_name", "revenue_trend", "spend_trend"]
_CFC = ["forecast_horizon", "granularity", "channel", "campaign_type", "campaign_name", *K.CARRY_FORWARD_COLS]


@register("half_trend", PERIOD_SQL + f"\nSELECT {sql_select(PERIOD_SPEC, _HT)} FROM periods")
def q_half_trend(spark, sf):
    return present(pe.half_trend(daily.feature_daily(spark, sf), snapshot=daily.landed_snapshot(spark, sf)),
                   PERIOD_SPEC)


@register("carry_forward", PERIOD_SQL + f"\nSELECT {sql_select(PERIOD_SPEC, _CFC)} FROM periods")
def q_carry_forward(spark, sf):
    return present(pe.carry_forward(daily.feature_daily(spark, sf), snapshot=daily.landed_snapshot(spark, sf)),
                   PERIOD_SPEC)


# ---------------------------------------------------------------- daily rollups
from revcast.operators import rollup as ru  # noqa: E402

_ROLL_SUMS = ["spend", "clicks", "impressions", "daily_budget"]
_ROLL_MEANS = ["month", "day_of_week", "week_of_year", "quarter", "is_weekend", "roas", "cpc", "cvr",
               "budget_utilization", "days_since_campaign_start", *ROLL, "revenue_momentum", "spend_momentum"]
ROLLUP_SPEC = {"spend": "money", "clicks": "int", "impressions": "int", "daily_budget": "money",
               "revenue": "money", "roas": "ratio", **{c: "mean" for c in _ROLL_MEANS if c != "roas"}}


def _rollup_query(gran: str):
    keys = K.GRANULARITIES[gran]
    cols = ["date", *keys, *_ROLL_SUMS, *_ROLL_MEANS, "revenue"]
    aggs = ", ".join([f"sum({c}) AS {c}" for c in _ROLL_SUMS]
                     + [f"avg({c}) AS {c}" for c in _ROLL_MEANS if c != "roas"]
                     + ["sum(revenue) AS revenue"])
    sql = O.with_ctes(*O.feature_stack(), f"""rolled AS (
  SELECT date, {", ".join(keys)}, {aggs} FROM features GROUP BY date, {", ".join(keys)}),
rolled2 AS (SELECT *, CASE WHEN spend > 0 THEN revenue / spend ELSE 0.0 END AS roas FROM rolled)""") \
        + f"\nSELECT {sql_select(ROLLUP_SPEC, cols)} FROM rolled2"

    def run(spark, sf):
        return present(ru.daily_rollup(daily.feature_daily(spark, sf), gran).select(*cols), ROLLUP_SPEC)
    return run, sql


for _g, _n in (("channel", "daily_rollup_channel"), ("campaign_type", "daily_rollup_type")):
    _fn, _sql = _rollup_query(_g)
    REGISTRY[_n] = Query(_fn, _sql)


@register("latest_features", O.with_ctes(*O.feature_stack()) + f"""
SELECT {sql_select({**ROLL_SPEC, "days_since_campaign_start": "int"}, ["channel", "campaign_name", "date", "campaign_type",
        "campaign_id", "days_since_campaign_start", *ROLL])}
FROM (SELECT *, row_number() OVER (PARTITION BY channel, campaign_type, campaign_name
                                   ORDER BY date DESC, campaign_id DESC) AS rn FROM features) t WHERE rn = 1""")
def q_latest_features(spark, sf):
    lr = ru.latest_rows(daily.feature_daily(spark, sf), "campaign")
    return present(lr.select("channel", "campaign_name", "date", "campaign_type", "campaign_id",
                             "days_since_campaign_start", *ROLL),
                   {**ROLL_SPEC, "days_since_campaign_start": "int"})


# ---------------------------------------------------------------- source profile / audits / maps
from revcast.functions.expr import cap_roas, map_campaign_type, meta_prefix_type  # noqa: E402
from revcast.operators.clean import cleaning_audit  # noqa: E402


@register("source_profile", O.with_ctes(O.AD_DAILY) + """
SELECT channel, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT campaign_name) AS BIGINT) AS campaigns,
  min(date) AS min_date, max(date) AS max_date
FROM ad_daily GROUP BY channel""")
def q_source_profile(spark, sf):
    return daily.raw_daily(spark, sf).groupBy("channel").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("campaign_name").alias("campaigns"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"))


@register("cleaning_audit", O.with_ctes(AD_FILL := O.AD_DAILY, O.FILLED) + f"""
SELECT CAST(count(*) AS BIGINT) AS rows_in,
  CAST(count(CASE WHEN a.daily_budget IS NULL THEN 1 END) AS BIGINT) AS null_budgets,
  CAST(0 AS BIGINT) + (SELECT count(*) FROM (SELECT channel, campaign_name FROM ad_daily GROUP BY 1, 2
                                              HAVING count(daily_budget) = 0) x2
                       JOIN ad_daily a2 USING (channel, campaign_name)) AS still_null_budgets,
  CAST(count(CASE WHEN a.revenue IS NOT DISTINCT FROM 0 AND a.spend IS NOT DISTINCT FROM 0 THEN 1 END) AS BIGINT)
    AS zero_activity_rows,
  CAST(count(CASE WHEN NOT (a.revenue IS NOT DISTINCT FROM 0 AND a.spend IS NOT DISTINCT FROM 0) THEN 1 END) AS BIGINT)
    AS rows_out
FROM ad_daily a""")
def q_cleaning_audit(spark, sf):
    return cleaning_audit(daily.raw_daily(spark, sf))


def _bing_style_spark(c):
    return F.regexp_replace(F.initcap(F.regexp_replace(F.lower(c), "_", " ")), " ", "")


_BING_SQL = ("concat(upper(left(split_part(campaign_type, '_', 1), 1)), lower(substr(split_part(campaign_type, '_', 1), 2)),"
             " upper(left(split_part(campaign_type, '_', 2), 1)), lower(substr(split_part(campaign_type, '_', 2), 2)))")
_TYPE_MAP_SQL = ("coalesce(CASE {x} WHEN 'SEARCH' THEN 'SEARCH' WHEN 'PERFORMANCE_MAX' THEN 'PERFORMANCE_MAX'"
                 " WHEN 'DISPLAY' THEN 'DISPLAY' WHEN 'VIDEO' THEN 'VIDEO' WHEN 'DEMAND_GEN' THEN 'DEMAND_GEN'"
                 " WHEN 'SHOPPING' THEN 'SHOPPING' WHEN 'Search' THEN 'SEARCH' WHEN 'PerformanceMax' THEN 'PERFORMANCE_MAX'"
                 " WHEN 'Audience' THEN 'AUDIENCE' WHEN 'Shopping' THEN 'SHOPPING' END, 'OTHER')")


@register("campaign_type_map", O.with_ctes(O.AD_DAILY) + f"""
SELECT style, raw_type, {_TYPE_MAP_SQL.format(x="raw_type")} AS mapped_type, CAST(count(*) AS BIGINT) AS rows
FROM (SELECT 'google' AS style, campaign_type AS raw_type FROM ad_daily
      UNION ALL SELECT 'bing', {_BING_SQL} FROM ad_daily) t
GROUP BY style, raw_type""")
def q_campaign_type_map(spark, sf):
    raw = daily.raw_daily(spark, sf)
    g = raw.select(F.lit("google").alias("style"), F.col("campaign_type").alias("raw_type"))
    b = raw.select(F.lit("bing").alias("style"), _bing_style_spark(F.col("campaign_type")).alias("raw_type"))
    return (g.unionByName(b).groupBy("style", "raw_type").agg(F.count(F.lit(1)).alias("rows"))
             .withColumn("mapped_type", map_campaign_type(F.col("raw_type")))
             .select("style", "raw_type", "mapped_type", "rows"))


_PREFIXED_SQL = """prefixed AS (
  SELECT (CASE month(date) % 5 WHEN 0 THEN 'Generic_' WHEN 1 THEN 'Prospecting_' WHEN 2 THEN 'Remarketing_' WHEN 3 THEN 'generic_' ELSE '' END)
    || campaign_name AS campaign_name FROM ad_daily)"""


@register("name_prefix_varied", O.with_ctes(O.AD_DAILY, _PREFIXED_SQL) + """
SELECT campaign_name, CASE split_part(campaign_name, '_', 1) WHEN 'Generic' THEN 'GENERIC'
  WHEN 'Prospecting' THEN 'PROSPECTING' WHEN 'Remarketing' THEN 'REMARKETING' ELSE 'OTHER' END AS inferred_type,
  CAST(count(*) AS BIGINT) AS rows
FROM prefixed GROUP BY campaign_name""")
def q_name_prefix_varied(spark, sf):
    """P2 on names that begin with each prefix, by month."""
    prefix = F.element_at(F.lit(["Generic_", "Prospecting_", "Remarketing_", "generic_", ""]), F.month("date") % 5 + 1)
    return (daily.raw_daily(spark, sf).select(F.concat(prefix, "campaign_name").alias("campaign_name")).groupBy("campaign_name").agg(F.count(F.lit(1)).alias("rows"))
            .select("campaign_name", meta_prefix_type(F.col("campaign_name")).alias("inferred_type"), "rows"))


@register("name_prefix_type", O.with_ctes(O.AD_DAILY) + """
SELECT campaign_name, CASE split_part(campaign_name, '_', 1) WHEN 'Generic' THEN 'GENERIC'
  WHEN 'Prospecting' THEN 'PROSPECTING' WHEN 'Remarketing' THEN 'REMARKETING' ELSE 'OTHER' END AS inferred_type,
  CAST(count(*) AS BIGINT) AS rows
FROM ad_daily GROUP BY campaign_name""")
def q_name_prefix_type(spark, sf):
    return (daily.raw_daily(spark, sf).groupBy("campaign_name").agg(F.count(F.lit(1)).alias("rows"))
            .select("campaign_name", meta_prefix_type(F.col("campaign_name")).alias("inferred_type"), "rows"))


# ---------------------------------------------------------------- guards on daily rows
@register("quantile_repair", O.with_ctes(*O.feature_stack(), """band AS (
  SELECT date, channel, campaign_type, campaign_name, campaign_id,
    revenue_roll_7d_mean - 1.28 * revenue_roll_7d_std AS r10, revenue AS r50,
    revenue_roll_7d_mean + 1.28 * revenue_roll_7d_std AS r90 FROM features),
b1 AS (SELECT *, CASE WHEN r10 > r50 THEN r50 * 0.8 ELSE r10 END AS a10 FROM band),
b2 AS (SELECT *, CASE WHEN r90 < r50 THEN r50 * 1.2 ELSE r90 END AS a90 FROM b1)""") + """
SELECT date, channel, campaign_type, campaign_name, campaign_id,
  round(CASE WHEN a10 > a90 THEN a90 ELSE a10 END + 1e-7, 2) AS revenue_p10, round(r50 + 1e-7, 2) AS revenue_p50,
  round(CASE WHEN a10 > a90 THEN a10 ELSE a90 END + 1e-7, 2) AS revenue_p90
FROM b2""")
def q_quantile_repair(spark, sf):
    f = daily.feature_daily(spark, sf)
    band = f.select(*KEYS5,
                    (F.col("revenue_roll_7d_mean") - 1.28 * F.col("revenue_roll_7d_std")).alias("revenue_p10"),
                    F.col("revenue").alias("revenue_p50"),
                    (F.col("revenue_roll_7d_mean") + 1.28 * F.col("revenue_roll_7d_std")).alias("revenue_p90"))
    return present(fc.repair_quantiles(band), {c: "mean" for c in ("revenue_p10", "revenue_p50", "revenue_p90")})


@register("roas_cap", O.with_ctes(*O.clean_stack()) + """
SELECT date, channel, campaign_type, campaign_name, campaign_id,
  round(CASE WHEN spend > 0 THEN least(revenue / spend, 20.0) ELSE 0.0 END + 1e-9, 4) AS roas_capped,
  round(CASE WHEN spend > 0 THEN least(revenue, 20.0 * spend) ELSE revenue END, 2) AS revenue_capped
FROM cleaned""")
def q_roas_cap(spark, sf):
    c = daily.cleaned_daily(spark, sf)
    s = F.col("spend")
    out = c.select(*KEYS5, cap_roas(F.col("revenue"), s).alias("roas_capped"),
                   F.when(s > 0, F.least(F.col("revenue"), s * K.MAX_ROAS)).otherwise(F.col("revenue"))
                    .alias("revenue_capped"))
    return present(out, {"roas_capped": "ratio", "revenue_capped": "money"})


# ---------------------------------------------------------------- insight tables
from revcast.operators import insights as ins  # noqa: E402
from revcast.operators import scenarios as sc  # noqa: E402


def _fc(spark, sf):
    """Insight queries read the landed forecast table (the forecast queries themselves build it)."""
    return daily.landed_forecast(spark, sf)


BODIES: dict[str, tuple[dict, list[str], str]] = {}


def _insight(name: str, fn, spec: dict, cols: list[str], body_sql: str, extra_ctes: tuple = ()):
    BODIES[name] = (spec, cols, body_sql)
    sql = O.with_ctes(*O.forecast_stack(), *extra_ctes) + f"\nSELECT {sql_select(spec, cols)} FROM ({body_sql}) t"

    def run(spark, sf):
        return present(fn(spark, sf).select(*cols), spec)
    REGISTRY[name] = Query(run, sql)


_insight("forecast_filter", lambda sp, sf: ins.filter_forecast(_fc(sp, sf), 30, None, "google"),
         FORECAST_SPEC, fc.FORECAST_COLUMNS, "SELECT * FROM fcast WHERE forecast_horizon = 30 AND channel = 'google'")

_insight("forecast_totals", lambda sp, sf: ins.forecast_totals(_fc(sp, sf)),
         {"forecast_horizon": "int", "groups": "int", "total_revenue_p50": "mean",
          "total_projected_spend": "mean", "avg_roas_p50": "ratio"},
         ["forecast_horizon", "granularity", "groups", "total_revenue_p50", "total_projected_spend", "avg_roas_p50"],
         """SELECT forecast_horizon, granularity, count(*) AS groups, sum(revenue_p50) AS total_revenue_p50,
                   sum(projected_spend) AS total_projected_spend, avg(roas_p50) AS avg_roas_p50
            FROM fcast GROUP BY forecast_horizon, granularity""")

KPI_COLS = ["forecast_horizon", "revenue_p10", "revenue_p50", "revenue_p90", "projected_spend", "num_channels",
            "blended_roas", "confidence_range", "model_confidence"]
_insight("kpis", lambda sp, sf: ins.kpis(_fc(sp, sf)),
         {"forecast_horizon": "int", "revenue_p10": "mean", "revenue_p50": "mean", "revenue_p90": "mean",
          "projected_spend": "mean", "num_channels": "int", "blended_roas": "ratio", "confidence_range": "mean"},
         KPI_COLS,
         """SELECT *, CASE WHEN blended_roas > 0.5 THEN '85%' ELSE '70%' END AS model_confidence FROM (
              SELECT forecast_horizon, sum(revenue_p10) AS revenue_p10, sum(revenue_p50) AS revenue_p50,
                sum(revenue_p90) AS revenue_p90, sum(projected_spend) AS projected_spend,
                count(DISTINCT channel) AS num_channels,
                CASE WHEN sum(projected_spend) > 0 THEN sum(revenue_p50) / sum(projected_spend) ELSE 0.0 END AS blended_roas,
                sum(revenue_p90) - sum(revenue_p10) AS confidence_range
              FROM fcast WHERE granularity = 'channel' GROUP BY forecast_horizon) k""")

_insight("dimension_lists", lambda sp, sf: ins.dimension_lists(_fc(sp, sf)), {}, ["dimension", "value"],
         """SELECT DISTINCT 'channel' AS dimension, channel AS value FROM fcast WHERE channel IS NOT NULL
            UNION SELECT DISTINCT 'campaign_type', campaign_type FROM fcast WHERE campaign_type <> 'ALL'""")

_insight("validation_counts", lambda sp, sf: ins.validation_counts(_fc(sp, sf)),
         {"channels": "int", "campaigns": "int"}, ["channels", "campaigns"],
         """SELECT count(DISTINCT channel) AS channels,
                   count(CASE WHEN granularity = 'campaign' AND forecast_horizon = 30 THEN 1 END) AS campaigns
            FROM fcast""")

PAUSED_COLS = ["forecast_horizon", "channel", "channel_display", "campaign_type", "total_revenue", "total_spend",
               "campaigns", "last_active", "status"]
PAUSED_SPEC = {"forecast_horizon": "int", "total_revenue": "money", "total_spend": "money", "campaigns": "int"}
_DISPLAY_SQL = ("CASE {c} WHEN 'google' THEN 'Google Ads' WHEN 'meta' THEN 'Meta Ads' "
                "WHEN 'bing' THEN 'Microsoft Ads' ELSE {c} END")
PAUSED_HIST = """phist AS (
  SELECT channel, campaign_type, sum(revenue) AS total_revenue, sum(spend) AS total_spend,
    count(DISTINCT campaign_name) AS campaigns, max(date) AS last_active
  FROM cleaned GROUP BY channel, campaign_type)"""


def _paused_sql(h: int) -> str:
    return f"""SELECT {h} AS forecast_horizon, channel, {_DISPLAY_SQL.format(c="channel")} AS channel_display,
      campaign_type, total_revenue, total_spend, campaigns, last_active, 'Paused' AS status
    FROM phist p WHERE NOT EXISTS (SELECT 1 FROM fcast f WHERE f.granularity = 'campaign_type'
      AND f.forecast_horizon = {h} AND f.channel = p.channel AND f.campaign_type = p.campaign_type)"""


for _h in (30, 60, 90):
    _insight(f"paused_types_{_h}",
             (lambda h: lambda sp, sf: ins.paused_types(daily.cleaned_daily(sp, sf), _fc(sp, sf), h))(_h),
             PAUSED_SPEC, PAUSED_COLS, _paused_sql(_h), (PAUSED_HIST,))

CONTRIB_COLS = ["forecast_horizon", "channel", "channel_display", "campaign_type", "campaigns", "revenue_p10",
                "revenue_p50", "revenue_p90", "roas_p10", "roas_p90", "contribution_pct", "low_confidence", "status"]
CONTRIB_SPEC = {"forecast_horizon": "int", "campaigns": "int", "revenue_p10": "mean", "revenue_p50": "mean",
                "revenue_p90": "mean", "roas_p10": "ratio", "roas_p90": "ratio", "contribution_pct": "ratio"}


def _contribution_sql(h: int) -> str:
    return f"""SELECT t.forecast_horizon, t.channel, {_DISPLAY_SQL.format(c="t.channel")} AS channel_display,
               t.campaign_type, coalesce(c.n, 0) AS campaigns, t.revenue_p10, t.revenue_p50, t.revenue_p90,
               t.roas_p10, t.roas_p90,
               CASE WHEN sum(t.revenue_p50) OVER (PARTITION BY t.forecast_horizon) > 0
                    THEN t.revenue_p50 / sum(t.revenue_p50) OVER (PARTITION BY t.forecast_horizon) * 100
                    ELSE 0.0 END AS contribution_pct,
               t.low_confidence, 'Active' AS status
             FROM fcast t LEFT JOIN (SELECT channel, campaign_type, count(*) AS n FROM fcast
                                     WHERE granularity = 'campaign' AND forecast_horizon = {h} GROUP BY 1, 2) c
               ON t.channel = c.channel AND t.campaign_type = c.campaign_type
             WHERE t.granularity = 'campaign_type' AND t.forecast_horizon = {h}
             UNION ALL
             SELECT forecast_horizon, channel, channel_display, campaign_type, campaigns, NULL, NULL, NULL, NULL,
               NULL, NULL, NULL, status FROM ({_paused_sql(h)}) p"""


for _h, _name in ((30, "contribution_table"), (60, "contribution_table_60"), (90, "contribution_table_90")):
    _insight(_name, (lambda h: lambda sp, sf: ins.contribution_table(_fc(sp, sf), daily.cleaned_daily(sp, sf), h))(_h),
             CONTRIB_SPEC, CONTRIB_COLS, _contribution_sql(_h), (PAUSED_HIST,))

_insight("contribution_totals", lambda sp, sf: ins.contribution_totals(_fc(sp, sf)),
         {"forecast_horizon": "int", "total_p10": "mean", "total_p90": "mean", "total_spend": "mean",
          "blended_roas_p10": "ratio", "blended_roas_p90": "ratio"},
         ["forecast_horizon", "total_p10", "total_p90", "total_spend", "blended_roas_p10", "blended_roas_p90"],
         """SELECT *, CASE WHEN total_spend > 0 THEN total_p10 / total_spend ELSE 0.0 END AS blended_roas_p10,
                   CASE WHEN total_spend > 0 THEN total_p90 / total_spend ELSE 0.0 END AS blended_roas_p90
            FROM (SELECT forecast_horizon, sum(revenue_p10) AS total_p10, sum(revenue_p90) AS total_p90,
                         sum(projected_spend) AS total_spend
                  FROM fcast WHERE granularity = 'campaign_type' GROUP BY forecast_horizon) x""")

_ROAS_LABEL_SQL = ("CASE WHEN {r} > 3.0 THEN 'HIGH PERFORMER' WHEN {r} > 1.0 THEN 'PROFITABLE' "
                   "WHEN {r} > 0.5 THEN 'MARGINAL' ELSE 'UNDERPERFORMING' END")
_insight("channel_analysis", lambda sp, sf: ins.channel_analysis(_fc(sp, sf)),
         {"forecast_horizon": "int", "revenue_p10": "mean", "revenue_p50": "mean", "revenue_p90": "mean",
          "roas_p50": "ratio", "projected_spend": "mean", "share_pct": "ratio", "width_pct": "ratio"},
         ["forecast_horizon", "channel", "revenue_p10", "revenue_p50", "revenue_p90", "roas_p50", "projected_spend",
          "share_pct", "width_pct", "assessment"],
         f"""SELECT forecast_horizon, channel, revenue_p10, revenue_p50, revenue_p90, roas_p50, projected_spend,
               CASE WHEN sum(revenue_p50) OVER () > 0 THEN revenue_p50 / sum(revenue_p50) OVER () * 100 ELSE 0.0 END
                 AS share_pct,
               CASE WHEN revenue_p50 > 0 THEN (revenue_p90 - revenue_p10) / revenue_p50 * 100 ELSE 0.0 END AS width_pct,
               {_ROAS_LABEL_SQL.format(r="roas_p50")} AS assessment
             FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30""")

_insight("type_analysis", lambda sp, sf: ins.type_analysis(_fc(sp, sf)),
         {"forecast_horizon": "int", "revenue_p50": "mean", "roas_p50": "ratio"},
         ["forecast_horizon", "channel", "campaign_type", "revenue_p50", "roas_p50", "risk"],
         """SELECT forecast_horizon, channel, campaign_type, revenue_p50, roas_p50,
               CASE WHEN revenue_p50 > 0 AND (revenue_p90 - revenue_p10) / greatest(revenue_p50, 1.0) > 1.5 THEN 'HIGH'
                    WHEN revenue_p50 > 0 AND (revenue_p90 - revenue_p10) / greatest(revenue_p50, 1.0) > 0.5 THEN 'MED'
                    ELSE 'LOW' END AS risk
             FROM fcast WHERE granularity = 'campaign_type' AND forecast_horizon = 30""")

BW_COLS = ["forecast_horizon", "top_type", "top_type_channel", "top_type_revenue_p50", "top_type_roas_p50",
           "lowest_type", "lowest_type_channel", "lowest_type_revenue_p50", "lowest_type_roas_p50",
           "best_channel", "best_channel_roas_p50", "worst_channel", "worst_channel_roas_p50"]
_insight("best_worst", lambda sp, sf: ins.best_worst(_fc(sp, sf)),
         {"forecast_horizon": "int", "top_type_revenue_p50": "mean", "top_type_roas_p50": "ratio",
          "lowest_type_revenue_p50": "mean", "lowest_type_roas_p50": "ratio", "best_channel_roas_p50": "ratio",
          "worst_channel_roas_p50": "ratio"}, BW_COLS,
         """SELECT 30 AS forecast_horizon, b.campaign_type AS top_type, b.channel AS top_type_channel,
               b.revenue_p50 AS top_type_revenue_p50, b.roas_p50 AS top_type_roas_p50,
               w.campaign_type AS lowest_type, w.channel AS lowest_type_channel,
               w.revenue_p50 AS lowest_type_revenue_p50, w.roas_p50 AS lowest_type_roas_p50,
               bc.channel AS best_channel, bc.roas_p50 AS best_channel_roas_p50,
               wc.channel AS worst_channel, wc.roas_p50 AS worst_channel_roas_p50
             FROM (SELECT * FROM fcast WHERE granularity = 'campaign_type' AND forecast_horizon = 30
                   ORDER BY revenue_p50 DESC, channel DESC, campaign_type DESC LIMIT 1) b,
                  (SELECT * FROM fcast WHERE granularity = 'campaign_type' AND forecast_horizon = 30
                   ORDER BY revenue_p50, channel, campaign_type LIMIT 1) w,
                  (SELECT * FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30
                   ORDER BY roas_p50 DESC, channel DESC LIMIT 1) bc,
                  (SELECT * FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30
                   ORDER BY roas_p50, channel LIMIT 1) wc""")

_insight("horizon_trend", lambda sp, sf: ins.horizon_trend(_fc(sp, sf)),
         {"forecast_horizon": "int", "total_p50": "mean", "total_spend": "mean", "avg_monthly_p50": "mean",
          "growth_pct": "ratio"},
         ["forecast_horizon", "total_p50", "total_spend", "avg_monthly_p50", "growth_pct", "trend"],
         """SELECT *, CASE WHEN growth_pct IS NULL THEN NULL WHEN growth_pct > 5 THEN 'GROWING'
                          WHEN growth_pct < -5 THEN 'DECLINING' ELSE 'STABLE' END AS trend
            FROM (SELECT forecast_horizon, total_p50, total_spend, total_p50 / (forecast_horizon / 30.0) AS avg_monthly_p50,
                    CASE WHEN max(CASE WHEN forecast_horizon = 30 THEN total_p50 END) OVER () > 0 THEN
                      (max(CASE WHEN forecast_horizon = 90 THEN total_p50 / 3 END) OVER ()
                       - max(CASE WHEN forecast_horizon = 30 THEN total_p50 END) OVER ())
                      / max(CASE WHEN forecast_horizon = 30 THEN total_p50 END) OVER () * 100 END AS growth_pct
                  FROM (SELECT forecast_horizon, sum(revenue_p50) AS total_p50, sum(projected_spend) AS total_spend
                        FROM fcast WHERE granularity = 'channel' GROUP BY forecast_horizon) a) b""")

_insight("budget_efficiency", lambda sp, sf: ins.budget_efficiency(_fc(sp, sf)),
         {"forecast_horizon": "int", "historical_daily_revenue": "mean", "historical_daily_spend": "mean",
          "historical_roas": "ratio", "roas_p50": "ratio"},
         ["forecast_horizon", "channel", "historical_daily_revenue", "historical_daily_spend", "historical_roas",
          "roas_p50", "outlook"],
         """SELECT *, CASE WHEN roas_p50 > historical_roas * 1.1 THEN 'IMPROVING'
                          WHEN roas_p50 < historical_roas * 0.9 THEN 'DECLINING' ELSE 'STABLE' END AS outlook
            FROM (SELECT forecast_horizon, channel, historical_daily_revenue, historical_daily_spend,
                    CASE WHEN historical_daily_spend > 0 THEN historical_daily_revenue / historical_daily_spend
                         ELSE 0.0 END AS historical_roas, roas_p50
                  FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30) x""")

_UNC = "CASE WHEN revenue_p50 > 0 THEN (revenue_p90 - revenue_p10) / revenue_p50 * 100 ELSE 0.0 END"
_insight("high_uncertainty", lambda sp, sf: ins.high_uncertainty(_fc(sp, sf)),
         {"forecast_horizon": "int", "revenue_p10": "mean", "revenue_p50": "mean", "revenue_p90": "mean",
          "uncertainty_pct": "ratio", "high_uncertainty_total": "int"},
         ["forecast_horizon", "channel", "campaign_type", "campaign_name", "revenue_p10", "revenue_p50",
          "revenue_p90", "uncertainty_pct", "high_uncertainty_total"],
         f"""SELECT *, (SELECT count(*) FROM fcast WHERE granularity = 'campaign' AND forecast_horizon = 30
                         AND {_UNC} > 150) AS high_uncertainty_total
             FROM (SELECT forecast_horizon, channel, campaign_type, campaign_name, revenue_p10, revenue_p50,
                     revenue_p90, {_UNC} AS uncertainty_pct
                   FROM fcast WHERE granularity = 'campaign' AND forecast_horizon = 30 AND {_UNC} > 150
                   ORDER BY uncertainty_pct DESC, channel, campaign_name LIMIT 5) x""")

_insight("zero_revenue", lambda sp, sf: ins.zero_revenue(_fc(sp, sf)),
         {"forecast_horizon": "int", "projected_spend": "mean"},
         ["forecast_horizon", "channel", "campaign_type", "campaign_name", "projected_spend"],
         """SELECT forecast_horizon, channel, campaign_type, campaign_name, projected_spend FROM fcast
            WHERE granularity = 'campaign' AND forecast_horizon = 30 AND revenue_p50 = 0""")

_insight("wasted_spend", lambda sp, sf: ins.wasted_spend(_fc(sp, sf)),
         {"forecast_horizon": "int", "zero_revenue_campaigns": "int", "wasted_spend": "mean"},
         ["forecast_horizon", "zero_revenue_campaigns", "wasted_spend"],
         """SELECT 30 AS forecast_horizon, count(*) AS zero_revenue_campaigns,
                   coalesce(sum(projected_spend), 0.0) AS wasted_spend
            FROM fcast WHERE granularity = 'campaign' AND forecast_horizon = 30 AND revenue_p50 = 0""")

_insight("budget_concentration", lambda sp, sf: ins.budget_concentration(_fc(sp, sf)),
         {"forecast_horizon": "int", "dominant_spend": "mean", "total_spend": "mean", "share_pct": "ratio"},
         ["forecast_horizon", "dominant_channel", "dominant_spend", "total_spend", "share_pct", "concentration_alert"],
         """SELECT 30 AS forecast_horizon, *, coalesce(round(share_pct, 0) > 60, false) AS concentration_alert
            FROM (SELECT arg_max(channel, (projected_spend, channel)) AS dominant_channel,
                    max(projected_spend) AS dominant_spend, sum(projected_spend) AS total_spend,
                    CASE WHEN sum(projected_spend) > 0 THEN max(projected_spend) / sum(projected_spend) * 100 END
                      AS share_pct
                  FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30) x""")

_insight("baseline_anomaly", lambda sp, sf: ins.baseline_anomaly(_fc(sp, sf)),
         {"forecast_horizon": "int", "historical_daily_revenue": "mean", "predicted_daily_revenue": "mean",
          "change_pct": "ratio"},
         ["forecast_horizon", "channel", "historical_daily_revenue", "predicted_daily_revenue", "change_pct",
          "direction", "anomaly"],
         """SELECT *, CASE WHEN change_pct > 0 THEN 'uplift' ELSE 'decline' END AS direction,
                   CASE WHEN change_pct > 10 THEN 'UPLIFT' WHEN change_pct < -10 THEN 'DECLINE' ELSE 'STABLE' END
                     AS anomaly
            FROM (SELECT forecast_horizon, channel, historical_daily_revenue, revenue_p50 / 30.0 AS predicted_daily_revenue,
                    CASE WHEN historical_daily_revenue > 0
                         THEN (revenue_p50 / 30.0 - historical_daily_revenue) / historical_daily_revenue * 100
                         ELSE 0.0 END AS change_pct
                  FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30) x""")

REC_COLS = ["rec_num", "rule", "best_channel", "best_channel_roas_p50", "worst_channel", "worst_channel_roas_p50",
            "zero_revenue_campaigns", "wasted_spend", "data_quality_campaigns"]
_insight("recommendations", lambda sp, sf: ins.recommendations(_fc(sp, sf)),
         {"rec_num": "int", "best_channel_roas_p50": "ratio", "worst_channel_roas_p50": "ratio",
          "zero_revenue_campaigns": "int", "wasted_spend": "mean", "data_quality_campaigns": "int"}, REC_COLS,
         """SELECT row_number() OVER (ORDER BY r.rule_order) AS rec_num, r.rule, i.*
            FROM (SELECT
                    arg_max(channel, (roas_p50, channel)) FILTER (WHERE granularity = 'channel') AS best_channel,
                    max(roas_p50) FILTER (WHERE granularity = 'channel') AS best_channel_roas_p50,
                    arg_min(channel, (roas_p50, channel)) FILTER (WHERE granularity = 'channel') AS worst_channel,
                    min(roas_p50) FILTER (WHERE granularity = 'channel') AS worst_channel_roas_p50,
                    count(*) FILTER (WHERE granularity = 'campaign' AND revenue_p50 = 0) AS zero_revenue_campaigns,
                    coalesce(sum(projected_spend) FILTER (WHERE granularity = 'campaign' AND revenue_p50 = 0), 0.0)
                      AS wasted_spend,
                    count(*) FILTER (WHERE granularity = 'campaign'
                      AND (revenue_p90 - revenue_p10) / greatest(revenue_p50, 1.0) > 1.5) AS data_quality_campaigns
                  FROM fcast WHERE forecast_horizon = 30) i
            JOIN (VALUES (1, 'BUDGET REALLOCATION'), (2, 'CAMPAIGN PRUNING'), (3, 'DATA QUALITY'),
                         (4, 'SCENARIO PLANNING')) r(rule_order, rule)
              ON (r.rule_order = 1 AND coalesce(i.best_channel_roas_p50 > i.worst_channel_roas_p50 * 2, false))
              OR (r.rule_order = 2 AND i.zero_revenue_campaigns > 0)
              OR (r.rule_order = 3 AND i.data_quality_campaigns > 0)
              OR r.rule_order = 4""")

FAN_COLS = ["forecast_horizon", "point", "day_offset", "revenue_p10", "revenue_p50", "revenue_p75", "revenue_p90",
            "roas_p10", "roas_p50", "roas_p75", "roas_p90"]
_insight("fan_series", lambda sp, sf: ins.fan_series(_fc(sp, sf)),
         {"forecast_horizon": "int", "point": "int", "day_offset": "int", "revenue_p10": "mean",
          "revenue_p50": "mean", "revenue_p75": "mean", "revenue_p90": "mean", "roas_p10": "ratio",
          "roas_p50": "ratio", "roas_p75": "ratio", "roas_p90": "ratio"}, FAN_COLS,
         """SELECT forecast_horizon, point, point * 3 AS day_offset,
               t10 / forecast_horizon * (point * 3 + 1) AS revenue_p10,
               t50 / forecast_horizon * (point * 3 + 1) * (1 + frac * 0.03) AS revenue_p50,
               t50 / forecast_horizon * (point * 3 + 1) * (1 + frac * 0.03)
                 + (t90 / forecast_horizon * (point * 3 + 1) * (1 + frac * 0.05)
                    - t50 / forecast_horizon * (point * 3 + 1) * (1 + frac * 0.03)) * 0.5 AS revenue_p75,
               t90 / forecast_horizon * (point * 3 + 1) * (1 + frac * 0.05) AS revenue_p90,
               r10 * (1 + frac * 0.05) AS roas_p10, r50 * (1 + frac * 0.08) AS roas_p50,
               r50 * (1 + frac * 0.08) + (r90 * (1 + frac * 0.10) - r50 * (1 + frac * 0.08)) * 0.5 AS roas_p75,
               r90 * (1 + frac * 0.10) AS roas_p90
            FROM (SELECT *, point / n_points AS frac FROM (
                    SELECT *, unnest(generate_series(0, n_points)) AS point FROM (
                      SELECT forecast_horizon, forecast_horizon // 3 AS n_points,
                        sum(revenue_p10) AS t10, sum(revenue_p50) AS t50, sum(revenue_p90) AS t90,
                        avg(roas_p10) AS r10, avg(roas_p50) AS r50, avg(roas_p90) AS r90
                      FROM fcast WHERE granularity = 'channel' GROUP BY forecast_horizon) a) b) c""")

# FIXED scenario set used by the registered what-if query.
SCENARIOS = [("base", None, 1.0), ("plus_20", None, 1.2), ("minus_20", None, 0.8),
             ("google_up", "google", 1.5), ("over_cap", None, 5.0)]
SCEN_COLS = ["scenario_id", "forecast_horizon", "granularity", "channel", "campaign_type", "campaign_name",
             "budget_multiplier", "revenue_p10", "revenue_p50", "revenue_p90", "projected_spend", "roas_p50"]
_insight("budget_scenarios", lambda sp, sf: sc.apply_scenarios(_fc(sp, sf), SCENARIOS),
         {"forecast_horizon": "int", "budget_multiplier": "ratio", "revenue_p10": "mean", "revenue_p50": "mean",
          "revenue_p90": "mean", "projected_spend": "mean", "roas_p50": "ratio"}, SCEN_COLS,
         """SELECT i.scenario_id, f.forecast_horizon, f.granularity, f.channel, f.campaign_type, f.campaign_name,
               m.mult AS budget_multiplier,
               f.revenue_p10 / f.budget_multiplier * m.mult AS revenue_p10,
               f.revenue_p50 / f.budget_multiplier * m.mult AS revenue_p50,
               f.revenue_p90 / f.budget_multiplier * m.mult AS revenue_p90,
               f.projected_spend / f.budget_multiplier * m.mult AS projected_spend, f.roas_p50
            FROM fcast f CROSS JOIN (SELECT DISTINCT scenario_id FROM scen) i,
            LATERAL (SELECT least(greatest(coalesce(
                (SELECT s.m FROM scen s WHERE s.scenario_id = i.scenario_id AND s.channel = f.channel),
                (SELECT s.m FROM scen s WHERE s.scenario_id = i.scenario_id AND s.channel IS NULL), 1.0), 0.1), 3.0)
                AS mult) m""",
         ("""scen(scenario_id, channel, m) AS (VALUES ('base', NULL, 1.0::DOUBLE), ('plus_20', NULL, 1.2::DOUBLE),
              ('minus_20', NULL, 0.8::DOUBLE), ('google_up', 'google', 1.5::DOUBLE), ('over_cap', NULL, 5.0::DOUBLE))""",))




# ---------------------------------------------------------------- learning: encoders, index, folds, metrics
from revcast.operators import encode as en  # noqa: E402
from revcast.operators import metrics as me  # noqa: E402
from revcast.operators import splits as spl  # noqa: E402

DICT_SQL = """dict AS (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS idx FROM (
    SELECT DISTINCT 'channel' AS column_name, channel AS value FROM cleaned
    UNION SELECT DISTINCT 'campaign_type', campaign_type FROM cleaned
    UNION SELECT DISTINCT 'campaign_name', campaign_name FROM cleaned
    UNION SELECT 'channel', '__UNSEEN__' UNION SELECT 'campaign_type', '__UNSEEN__'
    UNION SELECT 'campaign_name', '__UNSEEN__') v)"""


@register("label_encode_fit", O.with_ctes(*O.clean_stack(), DICT_SQL)
          + "\nSELECT column_name, value, CAST(idx AS BIGINT) AS idx FROM dict")
def q_label_encode_fit(spark, sf):
    return en.fit_dictionary(daily.cleaned_daily(spark, sf))


ENC_SQL = """enc AS (
  SELECT c.* REPLACE (
    coalesce((SELECT idx FROM dict d WHERE d.column_name = 'channel' AND d.value = c.channel),
             (SELECT idx FROM dict d WHERE d.column_name = 'channel' AND d.value = '__UNSEEN__')) AS channel,
    coalesce((SELECT idx FROM dict d WHERE d.column_name = 'campaign_type' AND d.value = c.campaign_type),
             (SELECT idx FROM dict d WHERE d.column_name = 'campaign_type' AND d.value = '__UNSEEN__')) AS campaign_type,
    coalesce((SELECT idx FROM dict d WHERE d.column_name = 'campaign_name' AND d.value = c.campaign_name),
             (SELECT idx FROM dict d WHERE d.column_name = 'campaign_name' AND d.value = '__UNSEEN__')) AS campaign_name)
  FROM features c)"""


@register("label_encode_apply", O.with_ctes(*O.feature_stack(), DICT_SQL, ENC_SQL) + """
SELECT date, campaign_id, CAST(channel AS BIGINT) AS channel, CAST(campaign_type AS BIGINT) AS campaign_type,
  CAST(campaign_name AS BIGINT) AS campaign_name FROM enc""")
def q_label_encode_apply(spark, sf):
    cl = daily.cleaned_daily(spark, sf)
    out = en.encode(cl, en.fit_dictionary(cl))
    return out.select("date", "campaign_id", *[F.col(c).cast("bigint").alias(c) for c in K.CATEGORICAL_COLS])


SEEN_SQL = """seen AS (SELECT * FROM features WHERE channel <> 'meta' AND month <> 6),
seen_dict AS (
  SELECT column_name, value, row_number() OVER (PARTITION BY column_name ORDER BY value) - 1 AS idx FROM (
    SELECT DISTINCT 'channel' AS column_name, channel AS value FROM seen UNION SELECT DISTINCT 'campaign_type', campaign_type FROM seen
    UNION SELECT DISTINCT 'campaign_name', campaign_name FROM seen
    UNION SELECT * FROM (VALUES ('channel', '__UNSEEN__'), ('campaign_type', '__UNSEEN__'), ('campaign_name', '__UNSEEN__')) u(c, v)) x)"""


@register("label_encode_unseen", O.with_ctes(*O.feature_stack(), SEEN_SQL) + """
SELECT f.date, f.campaign_id, f.channel AS channel_name, CAST(coalesce(c.idx, cu.idx) AS BIGINT) AS channel,
  CAST(coalesce(t.idx, tu.idx) AS BIGINT) AS campaign_type, CAST(coalesce(n.idx, nu.idx) AS BIGINT) AS campaign_name
FROM features f
LEFT JOIN seen_dict c ON c.column_name = 'channel' AND c.value = f.channel JOIN seen_dict cu ON cu.column_name = 'channel' AND cu.value = '__UNSEEN__'
LEFT JOIN seen_dict t ON t.column_name = 'campaign_type' AND t.value = f.campaign_type JOIN seen_dict tu ON tu.column_name = 'campaign_type' AND tu.value = '__UNSEEN__'
LEFT JOIN seen_dict n ON n.column_name = 'campaign_name' AND n.value = f.campaign_name JOIN seen_dict nu ON nu.column_name = 'campaign_name' AND nu.value = '__UNSEEN__'""")
def q_label_encode_unseen(spark, sf):
    """J1/J2 with a dictionary that has not seen one channel (and whatever stands in June only)."""
    f = daily.feature_daily(spark, sf)
    out = en.encode(f.withColumn("channel_name", F.col("channel")), en.fit_dictionary(f.where("channel <> 'meta' AND month <> 6")))
    return out.select("date", "campaign_id", "channel_name", *[F.col(c).cast("bigint").alias(c) for c in K.CATEGORICAL_COLS])


MATRIX_FEATURES = ["channel", "campaign_type", "campaign_name", "spend", "clicks", "impressions", "daily_budget",
                   *_ROLL_MEANS]
MATRIX_SPEC = {"channel": "int", "campaign_type": "int", "campaign_name": "int", "spend": "money",
               "clicks": "int", "impressions": "int", "daily_budget": "money", "roas": "ratio",
               **{c: ROLL_SPEC.get(c, "ratio") for c in _ROLL_MEANS if c != "roas"},
               **{c: "int" for c in CAL}, "days_since_campaign_start": "int"}


@register("feature_matrix", O.with_ctes(*O.feature_stack(), DICT_SQL, ENC_SQL)
          + f"\nSELECT {sql_select(MATRIX_SPEC, ['date', 'campaign_id', *MATRIX_FEATURES])} FROM enc")
def q_feature_matrix(spark, sf):
    from revcast.operators.model import feature_matrix
    f = daily.feature_daily(spark, sf)
    fm, names = feature_matrix(f, en.fit_dictionary(f))
    assert names == MATRIX_FEATURES, names
    return present(fm.select("date", "campaign_id", *names), MATRIX_SPEC)


CHRONO_SQL = """chrono AS (
  SELECT *, row_number() OVER (ORDER BY date, channel, campaign_type, campaign_name, campaign_id) - 1 AS idx
  FROM cleaned)"""


@register("chrono_index", O.with_ctes(*O.clean_stack(), CHRONO_SQL)
          + "\nSELECT date, channel, campaign_type, campaign_name, campaign_id, CAST(idx AS BIGINT) AS idx FROM chrono")
def q_chrono_index(spark, sf):
    return spl.chrono_index(daily.cleaned_daily(spark, sf)).select(*KEYS5, "idx")


FOLDS_SQL = """nrows AS (SELECT count(*) AS n, count(*) // 6 AS ts FROM chrono),
folds AS (SELECT f.fold, n - (5 - f.fold) * ts AS test_start, n - (5 - f.fold) * ts + ts AS test_end
          FROM nrows CROSS JOIN (VALUES (0), (1), (2), (3), (4)) f(fold)),
roles AS (
  SELECT f.fold, CASE WHEN c.idx < f.test_start THEN 'train' ELSE 'test' END AS role, c.idx, c.revenue, c.date
  FROM chrono c JOIN folds f ON c.idx < f.test_end)"""


@register("cv_folds", O.with_ctes(*O.clean_stack(), CHRONO_SQL, FOLDS_SQL) + """
SELECT CAST(fold AS BIGINT) AS fold, role, CAST(count(*) AS BIGINT) AS rows, CAST(min(idx) AS BIGINT) AS min_idx,
  CAST(max(idx) AS BIGINT) AS max_idx, min(date) AS min_date, max(date) AS max_date, round(sum(revenue), 2) AS revenue
FROM roles GROUP BY fold, role""")
def q_cv_folds(spark, sf):
    ix = spl.chrono_index(daily.cleaned_daily(spark, sf))
    return spl.cv_assign(ix).groupBy(F.col("fold").cast("bigint").alias("fold"), "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        F.round(F.sum("revenue"), 2).alias("revenue"))


@register("holdout_split", O.with_ctes(*O.clean_stack(), CHRONO_SQL) + """
SELECT role, CAST(count(*) AS BIGINT) AS rows, min(date) AS min_date, max(date) AS max_date,
  round(sum(revenue), 2) AS revenue
FROM (SELECT *, CASE WHEN idx < CAST(floor((SELECT count(*) FROM chrono) * 0.8) AS BIGINT) THEN 'train'
                     ELSE 'valid' END AS role FROM chrono) t
GROUP BY role""")
def q_holdout_split(spark, sf):
    ix = spl.holdout_assign(spl.chrono_index(daily.cleaned_daily(spark, sf)))
    return ix.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("min_date"),
                                  F.max("date").alias("max_date"), F.round(F.sum("revenue"), 2).alias("revenue"))


CVEVAL_SQL = """qlist AS (
  SELECT fold, quantile_cont(revenue, [0.1, 0.5, 0.9]) AS ys FROM roles WHERE role = 'train' GROUP BY fold),
qhat AS (
  SELECT fold, unnest([0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]) AS quantile, unnest(ys) AS yhat FROM qlist),
cveval AS (
  SELECT r.fold, h.quantile,
    avg(CASE WHEN r.revenue - h.yhat >= 0 THEN h.quantile * (r.revenue - h.yhat)
             ELSE (h.quantile - 1) * (r.revenue - h.yhat) END) AS pinball_loss,
    avg(CASE WHEN r.revenue <= h.yhat THEN 1.0 ELSE 0.0 END) AS coverage
  FROM roles r JOIN qhat h ON r.fold = h.fold WHERE r.role = 'test' GROUP BY r.fold, h.quantile)"""


def _cv_eval(spark, sf):
    return me.constant_quantile_cv(spl.chrono_index(daily.cleaned_daily(spark, sf)))


@register("pinball_loss", O.with_ctes(*O.clean_stack(), CHRONO_SQL, FOLDS_SQL, CVEVAL_SQL) + """
SELECT CAST(fold AS BIGINT) AS fold, quantile, round(pinball_loss + 1e-7, 2) AS pinball_loss FROM cveval""")
def q_pinball_loss(spark, sf):
    return present(_cv_eval(spark, sf).select(F.col("fold").cast("bigint").alias("fold"), "quantile", "pinball_loss"),
                   {"pinball_loss": "mean"})


@register("coverage", O.with_ctes(*O.clean_stack(), CHRONO_SQL, FOLDS_SQL, CVEVAL_SQL) + """
SELECT CAST(fold AS BIGINT) AS fold, quantile, round(coverage + 1e-9, 4) AS coverage,
  round(avg(coverage) OVER (PARTITION BY quantile) + 1e-9, 4) AS mean_coverage FROM cveval""")
def q_coverage(spark, sf):
    ev = _cv_eval(spark, sf)
    from pyspark.sql import Window
    out = ev.select(F.col("fold").cast("bigint").alias("fold"), "quantile", "coverage",
                    F.avg("coverage").over(Window.partitionBy("quantile")).alias("mean_coverage"))
    return present(out, {"coverage": "ratio", "mean_coverage": "ratio"})


@register("training_metadata", O.with_ctes(*O.feature_stack()) + """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(37 AS BIGINT) AS n_features, min(date) AS min_date, max(date) AS max_date,
  string_agg(DISTINCT channel, ',' ORDER BY channel) AS channels,
  string_agg(DISTINCT campaign_type, ',' ORDER BY campaign_type) AS campaign_types,
  round(min(revenue), 2) AS target_min, round(max(revenue), 2) AS target_max
FROM features""")
def q_training_metadata(spark, sf):
    from revcast.operators.model import training_metadata
    return training_metadata(daily.feature_daily(spark, sf))




# ---------------------------------------------------------------- model-based (no SQL oracle for the forest itself)
from revcast.operators import importance as imp_ops  # noqa: E402
from revcast.operators import model as mo  # noqa: E402


_MODELS: dict = {}


def _model_key(spark, sf):
    return (spark.sparkContext.applicationId, sf, daily._source_stamp(sf))  # noqa: SLF001


def _trained(spark, sf):
    """All three forests and the dictionary, trained once per session and source version (a model store)."""
    key = ("all", *_model_key(spark, sf))
    if key not in _MODELS:
        _MODELS[key] = mo.train_all(daily.feature_daily(spark, sf))
    return _MODELS[key]


def _campaign_model(spark, sf):
    """The campaign-level forest: taken from the full training when it exists, else trained alone."""
    full = _MODELS.get(("all", *_model_key(spark, sf)))
    if full is not None:
        return full[0]["campaign"]
    key = ("campaign", *_model_key(spark, sf))
    if key not in _MODELS:
        f = daily.feature_daily(spark, sf)
        train, names = mo.granularity_training_set(f, "campaign", en.fit_dictionary(f))
        _MODELS[key] = mo.fit_forest(train, names, "campaign")
    return _MODELS[key]


def _campaign_importances(spark, sf):
    return _campaign_model(spark, sf).importances()


@register("forest_forecast", None)
def q_forest_forecast(spark, sf):
    """Forest-scored forecast at all granularities and horizons (rows-only check)."""
    f = daily.feature_daily(spark, sf)
    models, dictionary = _trained(spark, sf)
    dq = mo.forest_daily_quantiles(f, models, dictionary)
    return present(fc.forecast(f, daily_quantiles=dq, snapshot=daily.landed_snapshot(spark, sf)), FORECAST_SPEC)


@register("feature_importances", None)
def q_feature_importances(spark, sf):
    """M8: importance table (campaign level, 37 features x 3 quantiles)."""
    return _campaign_importances(spark, sf)


#: Rounds of the registered queries' models (early stopping may end them sooner).
BOOSTING_ROUNDS = 20


def _boosted(spark, sf):
    """The boosted models of all granularities and the dictionary, trained once per session and source version."""
    from revcast.operators.boosting import BoostingParams, train_boosted
    key = ("boosted", *_model_key(spark, sf))
    if key not in _MODELS:
        f = daily.feature_daily(spark, sf)
        dictionary = daily.materialize(en.fit_dictionary(f), "dictionary")
        _MODELS[key] = train_boosted(f, dictionary, params=BoostingParams(rounds=BOOSTING_ROUNDS)), dictionary
    return _MODELS[key]


@register("boosted_forecast", None)
def q_boosted_forecast(spark, sf):
    """Forecast by boosted quantile regressions at all granularities and horizons (rows-only check)."""
    f = daily.feature_daily(spark, sf)
    models, dictionary = _boosted(spark, sf)
    dq = mo.forest_daily_quantiles(f, models, dictionary)
    return present(fc.forecast(f, daily_quantiles=dq, snapshot=daily.landed_snapshot(spark, sf)), FORECAST_SPEC)


@register("split_importances", None)
def q_split_importances(spark, sf):
    """M8: split counts by granularity, quantile and feature."""
    return mo.importance_table(_boosted(spark, sf)[0])


# ---------------------------------------------------------------- importances from the data
# A deterministic importance table: each numeric feature's absolute correlation with revenue.
CORR_FEATURES = ["spend", "clicks", "impressions", "daily_budget", *_ROLL_MEANS]
CORR_SQL = ("corrs AS (SELECT feature, importance FROM (SELECT "
            + ", ".join(f"coalesce(round(abs(corr({c}, revenue)), 6), 0.0) AS {c}" for c in CORR_FEATURES)
            + " FROM features) UNPIVOT (importance FOR feature IN (" + ", ".join(CORR_FEATURES) + ")))")
RANKED_SQL = """ranked AS (
  SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank,
    CASE WHEN sum(importance) OVER () > 0 THEN importance / sum(importance) OVER () * 100 ELSE 0.0 END AS pct_of_all FROM corrs)"""
IMP_SPEC = {"rank": "int", "importance": "roll", "pct_of_all": "ratio", "pct_of_top": "ratio"}


def _correlation_importances(spark, sf):
    f = daily.feature_daily(spark, sf)
    one = f.agg(*[F.coalesce(F.round(F.abs(F.corr(F.col(c).cast("double"), F.col("revenue"))), 6), F.lit(0.0)).alias(c) for c in CORR_FEATURES])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in CORR_FEATURES])
    return one.select(F.inline(rows)).select(F.lit("campaign").alias("granularity"), F.lit(0.5).alias("quantile"), "feature", "importance")


def _importance_query(name: str, fn, cols: list[str], body: str):
    sql = O.with_ctes(*O.feature_stack(), CORR_SQL, RANKED_SQL) + f"\nSELECT {sql_select(IMP_SPEC, cols)} FROM ({body}) t"
    REGISTRY[name] = Query(lambda sp, sf: present(fn(_correlation_importances(sp, sf)).select(*cols), IMP_SPEC), sql)


def _top_sql(n: int, explained: str) -> str:
    return f"""SELECT *, importance / sum(importance) OVER () * 100 AS pct_of_top, {explained} AS explanation
      FROM ranked WHERE rank <= {n}"""


_TOP_COLS = ["rank", "feature", "importance", "pct_of_all", "pct_of_top", "explanation"]
_importance_query("importance_rank", imp_ops.ranked, ["rank", "feature", "importance", "pct_of_all"], "SELECT * FROM ranked")
_importance_query("top_features", imp_ops.top_features, _TOP_COLS, _top_sql(10, R.explain_long("feature")))
_importance_query("top_features_15", lambda i: imp_ops.top_features(i, n=15, short=True), _TOP_COLS, _top_sql(15, R.explain_short("feature")))
_importance_query("drivers", imp_ops.drivers, [*_TOP_COLS, "roas_driven", "spend_driven", "rolling_driven"],
                  f"""SELECT *, (SELECT bool_or(feature IN ('roas', 'roas_roll_7d_mean')) FROM ranked WHERE rank <= 3) AS roas_driven,
      (SELECT bool_or(feature = 'spend') FROM ranked WHERE rank <= 3) AS spend_driven,
      (SELECT bool_or(feature LIKE '%roll%') FROM ranked WHERE rank <= 3) AS rolling_driven FROM ({_top_sql(10, R.explain_long("feature"))})""")
_importance_query("feature_explain", lambda i: imp_ops.explain_names(i, "feature").join(i, "feature"), ["feature", "importance", "explanation", "short_explanation"],
                  f"SELECT feature, importance, {R.explain_long('feature')} AS explanation, {R.explain_short('feature')} AS short_explanation FROM corrs")


# ---------------------------------------------------------------- sinks / report
from revcast.operators import report as rep  # noqa: E402
from revcast.sources import sinks as sk  # noqa: E402


@register("json_clean", O.with_ctes(*O.forecast_stack()) + f"""
SELECT {sql_select(FORECAST_SPEC, fc.FORECAST_COLUMNS)} FROM (
  SELECT * REPLACE (
    CASE WHEN isnan(roas_p50) OR isinf(roas_p50) OR roas_p50 IS NULL THEN 0.0 ELSE roas_p50 END AS roas_p50,
    CASE WHEN isnan(revenue_p50) OR isinf(revenue_p50) OR revenue_p50 IS NULL THEN 0.0 ELSE revenue_p50 END AS revenue_p50)
  FROM fcast) t""")
def q_json_clean(spark, sf):
    """S12 on the forecast table (JSON text itself is not compared across engines)."""
    return present(sk.json_clean(_fc(spark, sf)).drop("record_json"), FORECAST_SPEC)


@register("json_records", O.with_ctes(*O.forecast_stack()) + """
SELECT CAST(forecast_horizon AS BIGINT) AS forecast_horizon, granularity, channel, campaign_type, campaign_name,
  CAST(to_json({'forecast_horizon': forecast_horizon, 'granularity': granularity, 'channel': channel, 'campaign_type': campaign_type,
    'campaign_name': campaign_name, 'shaky': shaky, 'days': days}) AS VARCHAR) AS record_json
FROM (SELECT *, CASE channel WHEN 'google' THEN 0.0::DOUBLE WHEN 'bing' THEN 0.0::DOUBLE WHEN 'meta' THEN 0.0::DOUBLE ELSE 0.0::DOUBLE END AS shaky,
        CASE WHEN channel = 'bing' THEN 0 ELSE days_in_window END AS days FROM fcast) t""")
def q_json_records(spark, sf):
    """S12 with its text: a column of NaN, both infinities and NULL, and NULL integers, become 0 in the JSON."""
    f = _fc(spark, sf)
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    shaky = F.when(F.col("channel") == "google", nan).when(F.col("channel") == "bing", inf).when(F.col("granularity") == "channel", -inf)
    rows = f.select(F.col("forecast_horizon").cast("bigint").alias("forecast_horizon"), "granularity", "channel", "campaign_type", "campaign_name",
                    shaky.alias("shaky"), F.when(F.col("channel") != "bing", F.col("days_in_window").cast("bigint")).alias("days"))
    return sk.json_clean(rows).drop("shaky", "days")


# ---------------------------------------------------------------- insights where every branch fires
# The forecast with some slices scaled or zeroed (the same on both sides).
VARIED_SQL = """vcast AS (SELECT * REPLACE (
    CASE WHEN granularity = 'campaign' AND length(campaign_name) % 3 = 0 THEN 0.0 ELSE revenue_p10 END AS revenue_p10,
    CASE WHEN granularity = 'campaign' AND length(campaign_name) % 3 = 0 THEN 0.0 WHEN forecast_horizon = 90 THEN revenue_p50 * 1.3 ELSE revenue_p50 END AS revenue_p50,
    CASE channel WHEN 'google' THEN roas_p50 * 4 WHEN 'bing' THEN roas_p50 * 0.2 ELSE roas_p50 END AS roas_p50,
    CASE channel WHEN 'google' THEN projected_spend * 10 ELSE projected_spend END AS projected_spend,
    CASE channel WHEN 'bing' THEN historical_daily_revenue * 2 WHEN 'meta' THEN historical_daily_revenue * 0.5 ELSE historical_daily_revenue END AS historical_daily_revenue)
  FROM fcast)"""


def _varied(f: DataFrame) -> DataFrame:
    zero = (F.col("granularity") == "campaign") & (F.length("campaign_name") % 3 == 0)
    by = lambda col, google=1.0, bing=1.0, meta=1.0: F.when(F.col("channel") == "google", F.col(col) * google).when(
        F.col("channel") == "bing", F.col(col) * bing).when(F.col("channel") == "meta", F.col(col) * meta).otherwise(F.col(col))
    return f.withColumns({
        "revenue_p10": F.when(zero, F.lit(0.0)).otherwise(F.col("revenue_p10")),
        "revenue_p50": F.when(zero, F.lit(0.0)).when(F.col("forecast_horizon") == 90, F.col("revenue_p50") * 1.3).otherwise(F.col("revenue_p50")),
        "roas_p50": by("roas_p50", google=4.0, bing=0.2), "projected_spend": by("projected_spend", google=10.0),
        "historical_daily_revenue": by("historical_daily_revenue", bing=2.0, meta=0.5)})


for _name, _op in (("zero_revenue", ins.zero_revenue), ("wasted_spend", ins.wasted_spend), ("recommendations", ins.recommendations),
                   ("budget_concentration", ins.budget_concentration), ("channel_analysis", ins.channel_analysis), ("type_analysis", ins.type_analysis),
                   ("horizon_trend", ins.horizon_trend), ("budget_efficiency", ins.budget_efficiency), ("baseline_anomaly", ins.baseline_anomaly),
                   ("high_uncertainty", ins.high_uncertainty)):
    _spec, _cols, _body = BODIES[_name]
    _insight(f"{_name}_varied", (lambda op: lambda sp, sf: op(_varied(_fc(sp, sf))))(_op), _spec, _cols, _body.replace("fcast", "vcast"), (VARIED_SQL,))


@register("budget_multiplier", O.with_ctes(*O.forecast_stack()) + """
SELECT round(sum(projected_spend * CASE channel WHEN 'google' THEN 1.25 WHEN 'bing' THEN 0.5 ELSE 1.0 END) / sum(projected_spend) + 1e-9, 4) AS budget_multiplier
FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30""")
def q_budget_multiplier(spark, sf):
    """The factor of budgets edited by channel (a table) to the base."""
    base = _fc(spark, sf)
    factor = F.when(F.col("channel") == "google", 1.25).when(F.col("channel") == "bing", 0.5).otherwise(1.0)
    edited = ins.rows_at(base, "channel", 30).select("channel", (F.col("projected_spend") * factor).alias("budget"))
    return sc.edited_budgets_multiplier(base, edited).select(F.round(F.col("budget_multiplier") + 1e-9, 4).alias("budget_multiplier"))


_REPORT_BODIES = ("kpis", "channel_analysis", "type_analysis", "best_worst", "horizon_trend", "budget_efficiency", "high_uncertainty", "zero_revenue", "recommendations")


def _report_ctes(source: str = "fcast", *more: str) -> str:
    """The exported forecast, and the importances, as the report reads them."""
    return O.with_ctes(*O.forecast_stack(), O.FEATURES, CORR_SQL, RANKED_SQL, *more, f"rcast AS (SELECT {sql_select(FORECAST_SPEC, fc.FORECAST_COLUMNS)} FROM {source})")


def _report_lines_sql(source: str = "fcast", *more: str) -> str:
    return _report_ctes(source, *more) + "\n" + R.report_lines({n: BODIES[n][2].replace("fcast", "rcast") for n in _REPORT_BODIES})


def _report_inputs(spark, sf, change: Callable[[DataFrame], DataFrame] = lambda f: f):
    """The report reads the exported, rounded forecast, as the insight step does."""
    return present(change(_fc(spark, sf)), FORECAST_SPEC), _correlation_importances(spark, sf), daily.feature_daily(spark, sf)


def _shown(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("section").cast("bigint").alias("section"), "ord", F.round(F.col("num") + 1e-9, 4).alias("num"), "text1", "text2", F.col("k").cast("bigint").alias("k"), "line")


@register("report_lines", _report_lines_sql())
def q_report_lines(spark, sf):
    """The report's lines with their sort keys."""
    return _shown(rep.report_lines(*_report_inputs(spark, sf)))


@register("report_lines_varied", _report_lines_sql("vcast", VARIED_SQL))
def q_report_lines_varied(spark, sf):
    """I14 on the varied forecast: zero revenue, a growing trend, each assessment and outlook, all recommendations."""
    return _shown(rep.report_lines(*_report_inputs(spark, sf, _varied)))


@register("report_context", None)
def q_report_context(spark, sf):
    """One JSON document with the 30-day channel forecasts, top features and training context."""
    return rep.report_context(*_report_inputs(spark, sf))


@register("report_context_read", _report_ctes() + R.REPORT_CONTEXT)
def q_report_context_read(spark, sf):
    """I13 read back from its JSON: the training's row, a row for each channel, a row for each feature."""
    shape = ("training struct<min_date:string,max_date:string,channels:string,campaign_types:string>, "
             "forecasts_30d_channel array<struct<channel:string,campaign_type:string,campaign_name:string,revenue_p10:double,revenue_p50:double,revenue_p90:double>>, "
             "top_features array<struct<feature:string,importance:double>>")
    doc = rep.report_context(*_report_inputs(spark, sf)).select(F.from_json("context_json", shape).alias("d")).select("d.*")
    none, text, t = F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("training")
    row = lambda part, place, name, text, a, b, c: F.struct(
        F.lit(part).alias("part"), place.cast("bigint").alias("place"), name.alias("name"), text.alias("text"), a.alias("a"), b.alias("b"), c.alias("c"))
    return doc.select(F.inline(F.concat(
        F.array(row("training", F.lit(1), F.concat_ws(" ", t.min_date, t.max_date), F.concat_ws(";", t.channels, t.campaign_types), none, none, none)),
        F.transform("forecasts_30d_channel", lambda r, i: row("forecast", i + 1, r.channel, F.concat_ws(";", r.campaign_type, r.campaign_name), r.revenue_p10, r.revenue_p50, r.revenue_p90)),
        F.transform("top_features", lambda r, i: row("feature", i + 1, r.feature, text, F.round(r.importance, 6), none, none)))))


@register("base_budgets", O.with_ctes(*O.forecast_stack()) + """
SELECT channel, round(projected_spend, 0) AS base_budget,
  sum(round(projected_spend, 0)) OVER () AS total_budget
FROM fcast WHERE granularity = 'channel' AND forecast_horizon = 30""")
def q_base_budgets(spark, sf):
    """30-day base budget per channel (whole units) and their total."""
    from pyspark.sql import Window
    b = sc.base_budgets(_fc(spark, sf))
    return b.withColumn("total_budget", F.sum("base_budget").over(Window.partitionBy()))



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v.spark for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v.sql for k, v in REGISTRY.items() if v.sql is not None}
