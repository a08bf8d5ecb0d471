"""Budget what-if scenarios (J6), base budgets (A22) and the multiplier clamp (P25).

A scenario is a table (scenario_id, channel or NULL for all channels,
budget_multiplier).  Revenue quantiles and projected spend of the stored base
forecast scale linearly with the multiplier (the cap is relative to spend, so
ROAS is unchanged), hence every scenario is computed from the base table in one
job without re-running the model.  Each scenario is spelled out for the
forecast's channels (a vocabulary) and joined on the channel; the number of
scenarios is not limited.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revcast.functions.expr import clamp_multiplier
from revcast.operators.insights import rows_at

SCALED = ["revenue_p10", "revenue_p50", "revenue_p90", "projected_spend"]
SCENARIO_SCHEMA = "scenario_id string, channel string, budget_multiplier double"


def scenario_table(spark, scenarios: list[tuple[str, str | None, float]]) -> DataFrame:
    """A scenario table from literal rows."""
    return spark.createDataFrame([(s, c, float(m)) for s, c, m in scenarios], SCENARIO_SCHEMA)


def apply_scenarios(fc: DataFrame, scenarios: DataFrame | list[tuple[str, str | None, float]]) -> DataFrame:
    """One output row per (scenario, forecast row).  A channel's own multiplier comes before its scenario's general one."""
    if not isinstance(scenarios, DataFrame):
        scenarios = scenario_table(fc.sparkSession, scenarios)
    channels = fc.select(F.collect_set("channel")).scalar()
    general = scenarios.groupBy("scenario_id").agg(F.max(F.when(F.col("channel").isNull(), F.col("budget_multiplier"))).alias("_general"))
    own = scenarios.where(F.col("channel").isNotNull()).groupBy("scenario_id", "channel").agg(F.max("budget_multiplier").alias("_own"))
    grid = (general.select("scenario_id", "_general", F.explode(channels).alias("channel")).join(own, ["scenario_id", "channel"], "left")
            .select("scenario_id", "channel", clamp_multiplier(F.coalesce("_own", "_general", F.lit(1.0))).alias("_m")))
    out = fc.join(grid, "channel").withColumns({c: F.col(c) / F.col("budget_multiplier") * F.col("_m") for c in SCALED})
    return out.withColumn("budget_multiplier", F.col("_m")).select(*fc.columns, "scenario_id")


def base_budgets(fc: DataFrame, horizon: int = 30) -> DataFrame:
    """30-day projected spend per channel (rounded to whole units)."""
    return rows_at(fc, "channel", horizon).select(
        "channel", F.round("projected_spend", 0).alias("base_budget"))


def budgets_to_multiplier(fc: DataFrame, budgets: dict[str, float], horizon: int = 30) -> DataFrame:
    """Dashboard rule: one factor = total edited budgets / total default budget (always vs. the base)."""
    total_new = float(sum(budgets.values()))
    base_total = rows_at(fc, "channel", horizon).select(F.sum("projected_spend")).scalar()
    return fc.sparkSession.range(1).select(
        F.when(base_total > 0, F.lit(total_new) / base_total).otherwise(F.lit(1.0)).alias("budget_multiplier"))


def edited_budgets_multiplier(fc: DataFrame, budgets: DataFrame, horizon: int = 30) -> DataFrame:
    """``budgets_to_multiplier`` for a table (channel, budget)."""
    base_total = rows_at(fc, "channel", horizon).select(F.sum("projected_spend")).scalar()
    return budgets.agg(F.sum("budget").alias("total")).select(
        F.when(base_total > 0, F.col("total") / base_total).otherwise(F.lit(1.0)).alias("budget_multiplier"))
