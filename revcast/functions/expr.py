"""Column expressions (all JVM-side, no Python UDFs).

Every helper returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from revcast import constants as K

__all__ = [
    "lit_map", "nan_to_null", "map_campaign_type", "meta_prefix_type", "safe_ratio",
    "finite_or_zero", "non_negative", "cap_roas", "clamp_multiplier", "roas_label",
    "risk_label", "outlook_label", "trend_label", "anomaly_label", "compact_currency",
    "roas_text", "channel_display", "mean_round",
]


def lit_map(mapping: dict) -> Column:
    """A literal MAP<STRING,STRING> column."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def nan_to_null(c: Column) -> Column:
    """NaN -> NULL, so that comparisons and aggregates skip it like pandas does."""
    return F.nanvl(c, F.lit(None).cast("double"))


def map_campaign_type(raw: Column) -> Column:
    """Vocabulary map, case-sensitive, default OTHER (NULL -> OTHER)."""
    return F.coalesce(F.try_element_at(lit_map(K.CAMPAIGN_TYPE_MAP), raw), F.lit(K.DEFAULT_TYPE))


def meta_prefix_type(name: Column) -> Column:
    """Type from the first '_' token of a campaign name; unknown or NULL -> OTHER."""
    prefix = F.substring_index(name, "_", 1)
    return F.coalesce(F.try_element_at(lit_map(K.META_PREFIX_TYPES), prefix), F.lit(K.DEFAULT_TYPE))


def safe_ratio(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """num/den when den > 0, else ``otherwise`` (NULL den -> otherwise)."""
    return F.when(den > 0, F.try_divide(num, den)).otherwise(F.lit(otherwise))


def finite_or_zero(c: Column) -> Column:
    """NULL, NaN and +-Inf -> 0.0."""
    d = c.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), F.lit(0.0)).otherwise(d)


def non_negative(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


def cap_roas(revenue: Column, spend: Column) -> Column:
    """ROAS capped at MAX_ROAS; 0 when there is no spend."""
    return F.when(spend > 0, F.least(F.try_divide(revenue, spend), F.lit(K.MAX_ROAS))).otherwise(F.lit(0.0))


def clamp_multiplier(m: Column) -> Column:
    return F.least(F.greatest(m.cast("double"), F.lit(K.MULTIPLIER_MIN)), F.lit(K.MULTIPLIER_MAX))


def roas_label(roas: Column) -> Column:
    expr = None
    for bound, label in K.ROAS_LABELS:
        expr = F.when(roas > bound, F.lit(label)) if expr is None else expr.when(roas > bound, F.lit(label))
    return expr.otherwise(F.lit(K.ROAS_LABEL_ELSE))


def risk_label(p10: Column, p50: Column, p90: Column) -> Column:
    ratio = (p90 - p10) / F.greatest(p50, F.lit(1.0))
    return (F.when((p50 > 0) & (ratio > K.RISK_HIGH), F.lit("HIGH"))
             .when((p50 > 0) & (ratio > K.RISK_MED), F.lit("MED"))
             .otherwise(F.lit("LOW")))


def outlook_label(forecast_roas: Column, hist_roas: Column) -> Column:
    return (F.when(forecast_roas > hist_roas * (1 + K.OUTLOOK_BAND), F.lit("IMPROVING"))
             .when(forecast_roas < hist_roas * (1 - K.OUTLOOK_BAND), F.lit("DECLINING"))
             .otherwise(F.lit("STABLE")))


def trend_label(growth_pct: Column) -> Column:
    return (F.when(growth_pct > K.TREND_BAND_PCT, F.lit("GROWING"))
             .when(growth_pct < -K.TREND_BAND_PCT, F.lit("DECLINING"))
             .otherwise(F.lit("STABLE")))


def anomaly_label(change_pct: Column) -> Column:
    return (F.when(change_pct > K.ANOMALY_BAND_PCT, F.lit("UPLIFT"))
             .when(change_pct < -K.ANOMALY_BAND_PCT, F.lit("DECLINE"))
             .otherwise(F.lit("STABLE")))


def compact_currency(v: Column) -> Column:
    """$1.2M / $12k / $950 text."""
    a = F.abs(v)
    return (F.when(a >= 1_000_000, F.format_string("$%.1fM", v / 1_000_000))
             .when(a >= 1_000, F.format_string("$%.0fk", v / 1_000))
             .otherwise(F.format_string("$%.0f", v)))


def roas_text(v: Column) -> Column:
    return F.format_string("%.1fx", v)


def channel_display(channel: Column) -> Column:
    return F.coalesce(F.try_element_at(lit_map(K.CHANNEL_DISPLAY), channel), channel)


def mean_round(c: Column, digits: int = 2) -> Column:
    """Tie-free rounding for comparing means across engines: round(x + 1e-7, d)."""
    return F.round(c + F.lit(1e-7), digits)
