from pyspark.sql import functions as F

from revcast.operators import report as rep
from revcast.operators.scenarios import apply_scenarios, base_budgets, budgets_to_multiplier
from tests.test_insights import FC_SCHEMA, row


def _imp(spark):
    names = ["roas", "spend", "revenue_roll_7d_mean", "clicks"]
    return spark.createDataFrame([("campaign", 0.5, n, float(10 - i)) for i, n in enumerate(names)],
                                 "granularity string, quantile double, feature string, importance double")


def test_report_zero_revenue_section_ordered(spark, features_small):
    fc = spark.createDataFrame(
        [row("channel", "google", 1.0, 2.0, 3.0, 10.0), row("channel", "bing", 1.0, 2.0, 3.0, 10.0),
         row("campaign_type", "google", 1.0, 2.0, 3.0, 10.0, typ="SEARCH"),
         row("campaign", "meta", 0.0, 0.0, 1.0, 5.0, name="zz", typ="T"),
         row("campaign", "bing", 0.0, 0.0, 1.0, 7.0, name="aa", typ="T"),
         row("campaign", "bing", 0.0, 0.0, 1.0, 9.0, name="bb", typ="T")], FC_SCHEMA)
    lines = [r["line"] for r in rep.report_lines(fc, _imp(spark), features_small)
             .orderBy(*rep.SORT_KEYS).collect()]
    zero = [ln for ln in lines if ln.startswith("    - ") and "Spend=" in ln]
    assert zero == ["    - aa (bing, T): Spend=$7", "    - bb (bing, T): Spend=$9", "    - zz (meta, T): Spend=$5"]
    assert "  ZERO-REVENUE CAMPAIGNS (3 identified):" in lines
    assert any("CAMPAIGN PRUNING: 3 campaigns" in ln for ln in lines)


def test_budget_rules(spark):
    fc = spark.createDataFrame([row("channel", "google", 1.0, 2.0, 3.0, 600.4),
                                row("channel", "bing", 1.0, 2.0, 3.0, 399.6)], FC_SCHEMA)
    assert {r["channel"]: r["base_budget"] for r in base_budgets(fc).collect()} == {"google": 600.0, "bing": 400.0}
    m = budgets_to_multiplier(fc, {"google": 900.0, "bing": 300.0}).first()["budget_multiplier"]
    assert abs(m - 1.2) < 1e-12
    out = apply_scenarios(fc, [("s", None, 9.0), ("t", "bing", 0.01)])
    got = {(r["scenario_id"], r["channel"]): r["budget_multiplier"] for r in out.collect()}
    assert got == {("s", "google"): 3.0, ("s", "bing"): 3.0, ("t", "google"): 1.0, ("t", "bing"): 0.1}
    assert out.where(F.col("roas_p50") != 1.0).count() == 0


def test_report_order_and_texts(spark, features_small):
    fc = spark.createDataFrame([row("channel", "aaa", 1.0, 84.0, 300.0, 100.0), row("channel", "bbb", 1.0, 86.0, 300.0, 100.0),
                                row("campaign_type", "aaa", 0.0, 3.0, 4.0, 2.0, typ="T")], FC_SCHEMA)
    fc = fc.withColumn("roas_p50", F.when(F.col("channel") == "aaa", 0.84).otherwise(0.86))
    lines = [r["line"] for r in rep.report_lines(fc, None, features_small).orderBy(*rep.SORT_KEYS).collect()]
    at = lines.index("## BUDGET EFFICIENCY ANALYSIS")
    names = [ln for ln in lines[at:] if ln in ("  AAA", "  BBB")]
    assert names == ["  BBB", "  AAA"]
    assert lines[at + 1] == "  Channel Efficiency (30-Day Horizon):"
    assert "  No feature importance data available." in lines
    assert "  No campaign-level data available." in lines
    assert any(ln == "    Assessment: MARGINAL — close to break-even" for ln in lines)


def test_empty_report(spark, features_small):
    lines = [r["line"] for r in rep.report_lines(spark.createDataFrame([], FC_SCHEMA), None, features_small).orderBy(*rep.SORT_KEYS).collect()]
    for text in ("  No channel-level data available.", "  No campaign-type data available.", "  No data available.", "  No campaign-level data available."):
        assert text in lines


def test_many_scenarios_as_table(spark):
    fc = spark.createDataFrame([row("channel", "google", 1.0, 2.0, 3.0, 10.0), row("channel", "bing", 1.0, 2.0, 3.0, 10.0)], FC_SCHEMA)
    many = spark.range(12_000).select(F.col("id").cast("string").alias("scenario_id"), F.lit(None).cast("string").alias("channel"), (0.1 + F.col("id") / 10_000).alias("budget_multiplier"))
    assert apply_scenarios(fc, many).count() == 24_000
