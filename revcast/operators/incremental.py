"""Daily increments of the engineered table (W1-W4, P8, P11) from a small state.

``State`` holds one row for each (channel, campaign_name) series: the budget carried forward, the first
day, and the last TAIL cleaned rows, all that a new day's windows can reach back to.  ``increment`` reads
the state and the new rows only, and gives the new days' feature rows, the next state, and patches.

A patch settles what only the future can: a series whose rows have had no budget yet is filled backward
once one comes.  Its rows are written with ``budget_open``; ``with_patches`` gives them the value (and the
utilization that follows), or 0 while there is none.  The increments' rows with all patches equal the
table that is computed from all days at once, row for row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from revcast.constants import ROLLING_WINDOWS, UNIFIED_COLUMNS
from revcast.operators.clean import CAMPAIGN_KEYS, CAMPAIGN_ORDER, _running_last, campaign_window, campaign_window_desc, drop_unnamed, zero_activity
from revcast.operators.features import engineer_features, feature_order, ratio_columns

#: Earlier rows that a rolling window can hold.
TAIL = max(ROLLING_WINDOWS) - 1
_ROW = ("date date, channel string, campaign_type string, campaign_name string, campaign_id string, revenue double, spend double, "
        "clicks bigint, impressions bigint, conversions double, daily_budget double")
STATE = f"channel string, campaign_name string, carried double, first_date date, last_date date, tail array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>"


@dataclass
class Increment:
    features: DataFrame     # the new days' rows (41 columns) with budget_open
    state: DataFrame
    patches: DataFrame      # channel, campaign_name, budget


def no_state(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], STATE)


def increment(state: DataFrame, new_rows: DataFrame) -> Increment:
    """Features of ``new_rows`` (unified columns, whole days later than all of the state's).

    A series' windows hold its tail and its new rows.  A new row that isn't later than its series' state
    is an error: its day would have been closed."""
    new = drop_unnamed(new_rows).select(*UNIFIED_COLUMNS)
    old = state.select(*CAMPAIGN_KEYS, "carried", "first_date", "last_date", F.lit(True).alias("known"))
    late = F.col("date") <= F.col("last_date")
    told = F.concat(F.lit("not later than the state: "), F.col("channel"), F.lit(" "), F.col("campaign_name"), F.lit(" "), F.col("date").cast("string"))
    met = new.join(old, CAMPAIGN_KEYS, "left").withColumn("date", F.when(late, F.raise_error(told).cast("date")).otherwise(F.col("date")))

    budget = F.col("daily_budget")
    ahead = F.coalesce(budget, _running_last(budget, campaign_window()), F.col("carried"))
    found = F.coalesce(ahead, _running_last(budget, campaign_window_desc()))
    whole = Window.partitionBy(*CAMPAIGN_KEYS)
    # the series' first and last budget among the new rows, whatever rows hold them
    order = F.struct(*CAMPAIGN_ORDER)
    filled = met.withColumns({
        "_last": F.max_by(F.when(budget.isNotNull(), budget), F.when(budget.isNotNull(), order)).over(whole),
        "_first": F.min_by(F.when(budget.isNotNull(), budget), F.when(budget.isNotNull(), order)).over(whole),
        "budget_open": found.isNull(), "daily_budget": F.coalesce(found, F.lit(0.0))})
    filled = filled.withColumn("carried", F.coalesce("_last", "carried"))
    series = filled.groupBy(*CAMPAIGN_KEYS).agg(F.first("carried").alias("carried_now"), F.first("_first").alias("budget"), F.max("date").alias("seen"),
                                                F.max(F.col("known") & F.col("last_date").isNotNull()).alias("known"), F.min(F.when(~zero_activity(filled), F.col("date"))).alias("began"))

    kept = filled.where(~zero_activity(filled)).select(*UNIFIED_COLUMNS, "budget_open", F.lit(True).alias("_new"))
    tail = state.join(series.select(*CAMPAIGN_KEYS), CAMPAIGN_KEYS, "left_semi").select(F.inline("tail"))
    rows = kept.unionByName(tail.select(*UNIFIED_COLUMNS, F.lit(False).alias("budget_open"), F.lit(False).alias("_new")))
    engineered = engineer_features(rows).join(state.select(*CAMPAIGN_KEYS, "first_date"), CAMPAIGN_KEYS, "left")
    start = F.datediff(F.col("date"), F.least("first_date", F.date_sub("date", F.col("days_since_campaign_start"))))
    features = engineered.where("_new").withColumn("days_since_campaign_start", start).select(*UNIFIED_COLUMNS, *feature_order(), "budget_open")

    newest = Window.partitionBy(*CAMPAIGN_KEYS).orderBy(*[F.desc(c) for c in CAMPAIGN_ORDER])
    ends = (rows.withColumn("_rank", F.row_number().over(newest)).where(F.col("_rank") <= TAIL)
            .groupBy(*CAMPAIGN_KEYS).agg(F.array_sort(F.collect_list(F.struct(F.struct(*CAMPAIGN_ORDER).alias("at"), F.struct(*UNIFIED_COLUMNS).alias("row")))).alias("t"))
            .select(*CAMPAIGN_KEYS, F.transform("t", lambda x: x["row"]).alias("new_tail")))
    moved = state.join(series.drop("known", "budget"), CAMPAIGN_KEYS, "full").join(ends, CAMPAIGN_KEYS, "left")
    next_state = moved.select(*CAMPAIGN_KEYS, F.coalesce("carried_now", "carried").alias("carried"), F.least("first_date", "began").alias("first_date"),
                              F.greatest("last_date", "seen").alias("last_date"), F.coalesce("new_tail", "tail", F.array().cast(f"array<struct<{_ROW.replace(' ', ':').replace(',:', ',')}>>")).alias("tail"))
    unsettled = state.where("carried is null").select(*CAMPAIGN_KEYS)
    patches = series.where("budget is not null").join(unsettled, CAMPAIGN_KEYS, "left_semi").select(*CAMPAIGN_KEYS, "budget")
    return Increment(features, next_state, patches)


def with_patches(features: DataFrame, patches: DataFrame) -> DataFrame:
    """The increments' rows, with the budgets that came later."""
    rows = features.join(patches.withColumnRenamed("budget", "_patch"), CAMPAIGN_KEYS, "left")
    rows = rows.withColumn("daily_budget", F.when(F.col("budget_open"), F.coalesce("_patch", "daily_budget")).otherwise(F.col("daily_budget")))
    settled = rows.withColumn("budget_utilization", F.when(F.col("budget_open"), ratio_columns()["budget_utilization"]).otherwise(F.col("budget_utilization")))
    return settled.select(*[c for c in features.columns if c != "budget_open"])
