"""Report context (I13) and report lines.

Every section is a small DataFrame of (section, ord, line) built from the
insight tables with ``format_string`` / ``format_number``; the report is their
union, ordered by the typed sort keys only at the sink.  The header is printed once
(the original repeats its title line many times by accident).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revcast import constants as K
from revcast.operators import insights as ins
from revcast.operators import importance as imp_ops
from revcast.operators.model import training_metadata

RULE = "=" * 70
SORT_KEYS = ["section", "ord", "num", "text1", "text2", "k"]


def money(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def _lines(df: DataFrame, section: int, ord_: int, texts: list, num: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Each input row yields its lines, with the typed sort keys section, ord, num, text1, text2, k.

    A text is a line, or (condition, line) for one that only some rows have. A
    line with a missing value is marked, not dropped. No window, no numbering
    and no number as text: the sink's distributed sort on the keys puts the lines in place.
    """
    pairs = [t if isinstance(t, tuple) else (F.lit(True), t) for t in texts]
    arr = F.array(*[F.struct(F.lit(i).alias("k"), F.coalesce(c, F.lit(False)).alias("shown"), F.coalesce(t, F.lit("    (not available)")).alias("line"))
                    for i, (c, t) in enumerate(pairs)])
    texts_by = [F.col(c).cast("string") for c in by] + [F.lit("")] * (2 - len(by))
    keyed = df.select(F.lit(section).alias("section"), F.lit(ord_).cast("bigint").alias("ord"), (F.lit(0.0) if num is None else num.cast("double")).alias("num"),
                      texts_by[0].alias("text1"), texts_by[1].alias("text2"), F.inline(arr))
    return keyed.where("shown").select(*SORT_KEYS, "line")


def _by_label(label: str, texts: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in texts.items() for x in kv]), F.col(label))


def _driver_lines(imp: DataFrame | None, one: DataFrame) -> list[DataFrame]:
    """Section 2; without importances its one line says so."""
    if imp is None:
        return [_lines(one, 2, 0, [F.lit(K.REPORT_EMPTY["drivers"])])]
    d = imp_ops.drivers(imp)
    top3 = d.where(F.col("rank") <= 3).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda s: s["feature"]).alias("t3"),
        F.first("roas_driven").alias("roas"), F.first("spend_driven").alias("spend"), F.first("rolling_driven").alias("rolling"))
    some, three = F.size("t3") > 0, F.size("t3") >= 3
    return [
        _lines(top3, 2, 0, [(some, F.lit("  Top 10 features driving revenue predictions:")), (~some, F.lit(K.REPORT_EMPTY["drivers"]))]),
        _lines(d, 2, 1, [F.format_string("    %2d. %-30s (%5.1f%% importance) — %s", "rank", "feature", "pct_of_all", "explanation")], F.col("rank")),
        _lines(top3, 2, 2, [
            (some, F.lit("")), (some, F.lit("  Causal Interpretation:")),
            (three, F.format_string("    Revenue is primarily driven by %s, %s, and %s.", *[F.get("t3", F.lit(i)) for i in range(3)])),
            *[(some & F.col(flag), F.lit(K.DRIVER_TEXT[flag])) for flag in ("roas", "spend", "rolling")]])]


def report_lines(fc: DataFrame, imp: DataFrame | None, features: DataFrame | None, meta: DataFrame | None = None) -> DataFrame:
    """The report. ``meta``: the training's stored metadata; without it that of ``features``."""
    meta = training_metadata(features) if meta is None else meta
    at30 = F.col("forecast_horizon") == 30
    camp = at30 & (F.col("granularity") == "campaign")
    width = ins.uncertainty_pct(F.col("revenue_p10"), F.col("revenue_p50"), F.col("revenue_p90"))
    one = fc.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(at30 & (F.col("granularity") == g)).alias(f"n_{g}") for g in K.GRANULARITIES],
                 F.count_if(camp & (width > K.HIGH_UNCERTAINTY_PCT)).alias("n_high"), F.count_if(camp & (F.col("revenue_p50") == 0)).alias("n_zero"))
    head = meta.select("min_date", "max_date", "channels", one.select("rows").scalar().alias("rows"))
    parts = [
        _lines(head, 0, 0, [
            F.lit(RULE), F.lit(K.REPORT_TITLE), F.lit(RULE),
            F.format_string("Training Data: %s to %s", F.coalesce(F.col("min_date").cast("string"), F.lit("N/A")), F.coalesce(F.col("max_date").cast("string"), F.lit("N/A"))),
            F.concat(F.lit("Channels: "), F.regexp_replace("channels", ",", ", ")),
            F.format_string("Total Forecast Rows: %d", "rows")]),
        *[_lines(one, i, -1, [F.lit(f"## {title}")]) for i, title in enumerate(K.REPORT_SECTIONS, 1)],
        _lines(ins.kpis(fc), 1, 0, [
            F.format_string("  %d-Day Forecast:", "forecast_horizon"),
            F.concat(F.lit("    Expected Revenue (P50): "), money(F.col("revenue_p50"))),
            F.concat(F.lit("    Optimistic Range (P90): "), money(F.col("revenue_p90"))),
            F.concat(F.lit("    Conservative Range (P10): "), money(F.col("revenue_p10"))),
            F.concat(F.lit("    Projected Spend: "), money(F.col("projected_spend"))),
            F.format_string("    Blended ROAS: %.2fx", "blended_roas")], F.col("forecast_horizon")),
        *_driver_lines(imp, one),
        _lines(one, 3, 0, [(F.col("n_channel") == 0, F.lit(K.REPORT_EMPTY["channel"]))]),
        _lines(ins.channel_analysis(fc), 3, 1, [
            F.concat(F.lit("  "), F.upper("channel")),
            F.concat(F.lit("    30-Day P50 Revenue: "), money(F.col("revenue_p50")), F.format_string(" (%.0f%% of total)", "share_pct")),
            F.concat(F.lit("    Revenue Range: "), money(F.col("revenue_p10")), F.lit(" — "), money(F.col("revenue_p90"))),
            F.format_string("    ROAS (P50): %.2fx", "roas_p50"),
            F.concat(F.lit("    Projected Spend: "), money(F.col("projected_spend"))),
            F.format_string("    Forecast Uncertainty: ±%.0f%%", "width_pct"),
            F.concat(F.lit("    Assessment: "), F.col("assessment"), F.lit(" — "), _by_label("assessment", K.ASSESSMENT_TEXT))],
            -F.col("revenue_p50"), ("channel",)),
        _lines(one, 4, 0, [
            (F.col("n_campaign_type") == 0, F.lit(K.REPORT_EMPTY["campaign_type"])),
            (F.col("n_campaign_type") > 0, F.lit("  30-Day Revenue Forecast by Campaign Type:")),
            (F.col("n_campaign_type") > 0, F.format_string("  %-25s %-10s %12s %8s %8s", *map(F.lit, ("Campaign Type", "Channel", "P50 Revenue", "ROAS", "Risk")))),
            (F.col("n_campaign_type") > 0, F.lit("  " + "-" * 65))]),
        _lines(ins.type_analysis(fc), 4, 1, [
            F.format_string("  %-25s %-10s $%10s %7.2fx %7s", "campaign_type", "channel", F.format_number("revenue_p50", 0), "roas_p50", "risk")],
            -F.col("revenue_p50"), ("channel", "campaign_type")),
        _lines(ins.best_worst(fc), 4, 2, [
            (F.col("top_type").isNotNull(), F.concat(F.format_string("  Top Performer: %s (%s) — ", "top_type", "top_type_channel"), money(F.col("top_type_revenue_p50")),
                                                     F.format_string(" revenue, %.2fx ROAS", "top_type_roas_p50"))),
            (F.col("top_type").isNotNull(), F.concat(F.format_string("  Lowest Revenue: %s (%s) — ", "lowest_type", "lowest_type_channel"), money(F.col("lowest_type_revenue_p50")),
                                                     F.format_string(" revenue, %.2fx ROAS", "lowest_type_roas_p50")))]),
        _lines(ins.horizon_trend(fc), 5, 0, [
            F.concat(F.format_string("  %d-Day: Total P50 = ", "forecast_horizon"), money(F.col("total_p50")), F.lit(" (~"), money(F.col("avg_monthly_p50")),
                     F.lit("/month), Spend = "), money(F.col("total_spend"))),
            *[((F.col("forecast_horizon") == 90) & (F.col("trend") == label), F.format_string(text, F.abs("growth_pct")) if "%" in text else F.lit(text))
              for label, text in K.TREND_TEXT.items()]], F.col("forecast_horizon")),
        _lines(one, 6, 0, [(F.col("n_channel") == 0, F.lit(K.REPORT_EMPTY["efficiency"])), (F.col("n_channel") > 0, F.lit("  Channel Efficiency (30-Day Horizon):"))]),
        _lines(ins.budget_efficiency(fc), 6, 1, [
            F.concat(F.lit("  "), F.upper("channel")),
            F.concat(F.lit("    Historical Daily Revenue: "), money(F.col("historical_daily_revenue"))),
            F.concat(F.lit("    Historical Daily Spend: "), money(F.col("historical_daily_spend"))),
            F.format_string("    Historical ROAS: %.2fx", "historical_roas"),
            F.format_string("    Forecast P50 ROAS: %.2fx", "roas_p50"),
            F.concat(F.lit("    Outlook: "), F.col("outlook"), F.lit(" — "), _by_label("outlook", K.OUTLOOK_TEXT))],
            -F.col("roas_p50"), ("channel",)),
        _lines(one, 7, 0, [
            (F.col("n_campaign") == 0, F.lit(K.REPORT_EMPTY["campaign"])),
            (F.col("n_high") > 0, F.format_string("  HIGH UNCERTAINTY CAMPAIGNS (%d identified):", "n_high")),
            ((F.col("n_campaign") > 0) & (F.col("n_high") == 0), F.lit(K.REPORT_EMPTY["uncertainty"]))]),
        _lines(ins.high_uncertainty(fc), 7, 1, [
            F.concat(F.format_string("    - %s (%s): P10=", "campaign_name", "channel"), money(F.col("revenue_p10")), F.lit(", P50="), money(F.col("revenue_p50")),
                     F.lit(", P90="), money(F.col("revenue_p90")), F.format_string(" (±%.0f%%)", "uncertainty_pct"))],
            -F.col("uncertainty_pct"), ("channel", "campaign_name")),
        _lines(one.where("n_zero > 0"), 7, 2, [
            F.lit(""), F.format_string("  ZERO-REVENUE CAMPAIGNS (%d identified):", "n_zero"), F.lit("    These campaigns show zero median revenue forecast:")]),
        _lines(ins.zero_revenue(fc), 7, 3, [
            F.concat(F.format_string("    - %s (%s, %s): Spend=", "campaign_name", "channel", "campaign_type"), money(F.col("projected_spend")))],
            None, ("channel", "campaign_name")),
        _lines(ins.recommendations(fc), 8, 0, [
            F.when(F.col("rule") == "BUDGET REALLOCATION", F.format_string(
                "  %d. BUDGET REALLOCATION: Consider shifting budget from %s (ROAS: %.2fx) to %s (ROAS: %.2fx) "
                "to improve overall portfolio ROAS.", "rec_num", "worst_channel", "worst_channel_roas_p50",
                "best_channel", "best_channel_roas_p50"))
            .when(F.col("rule") == "CAMPAIGN PRUNING", F.concat(F.format_string(
                "  %d. CAMPAIGN PRUNING: %d campaigns have zero median revenue forecast but ", "rec_num",
                "zero_revenue_campaigns"), money(F.col("wasted_spend")),
                F.lit(" in projected spend. Review these campaigns for potential pause or restructuring.")))
            .when(F.col("rule") == "DATA QUALITY", F.format_string(
                "  %d. DATA QUALITY: %d campaigns have forecast uncertainty exceeding 150%%. Collecting more data or "
                "adding conversion tracking may improve prediction confidence.", "rec_num", "data_quality_campaigns"))
            .otherwise(F.format_string(
                "  %d. SCENARIO PLANNING: Run the forecast with budget multipliers 1.2 and 0.8 to model the impact "
                "of ±20%% budget changes on forecasted revenue.", "rec_num"))], F.col("rec_num")),
        _lines(one, 8, 1, [F.lit(""), F.lit(RULE), F.lit("End of Causal Summary Report"), F.lit(RULE)]),
    ]
    return reduce(DataFrame.unionByName, parts)


def report_context(fc: DataFrame, imp: DataFrame, features: DataFrame) -> DataFrame:
    """The 30-day channel rows, the top-10 features and the training context as one JSON document."""
    ch = ins.rows_at(fc, "channel", 30).select("channel", F.struct(*fc.columns).alias("r")) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "r"))), lambda x: x["r"]).alias("forecasts_30d_channel"))     # one row per channel
    top = imp_ops.top_features(imp).select("rank", F.struct("feature", "importance").alias("f")) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "f"))), lambda x: x["f"]).alias("top_features"))                 # ten rows, by rank
    meta = training_metadata(features)
    doc = meta.select(F.struct("min_date", "max_date", "channels", "campaign_types").alias("training"),
                      ch.select("forecasts_30d_channel").scalar().alias("forecasts_30d_channel"),
                      top.select("top_features").scalar().alias("top_features"))
    return doc.select(F.to_json(F.struct("*")).alias("context_json"))
